"""Registered queries of outlines, geometry and drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import draw as D
from ..operators import geometry as G
from ..operators import outlines as O
from ..operators import pixelwise as P
from ..operators import stencil as T
from ..sources import rasters as S
from . import sql as Q
from . import sql_shapes as L
from .queries import XYV, _rgba, add, on_emb, one


def _points(r: DataFrame) -> DataFrame:
    """The bright places of each raster as an outline in raster order."""
    return r.where("v > 150").select(F.col("img").alias("grp"), (F.col("y") * 8 + F.col("x")).alias("seq"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


_PT = ("pt", "SELECT img AS grp, y * 8 + x AS seq, x::DOUBLE AS x, y::DOUBLE AS y, lag(x) OVER w AS px, lag(y) OVER w AS py, last_value(x) OVER (PARTITION BY img ORDER BY y * 8 + x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lx, last_value(y) OVER (PARTITION BY img ORDER BY y * 8 + x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ly, count(*) OVER (PARTITION BY img) AS n FROM px WHERE v > 150 WINDOW w AS (PARTITION BY img ORDER BY y * 8 + x)")
on_emb("arc_length", lambda r: G.arc_length(_points(r)).select("grp", E.rounded("length", 6).alias("length")), _PT, ("r", "SELECT grp, round(sum(coalesce(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 0)), 6) AS length FROM pt GROUP BY grp"), columns=None)
on_emb("arc_length_closed", lambda r: G.arc_length(_points(r), True).select("grp", E.rounded("length", 6).alias("length")), _PT, ("r", "SELECT grp, round(sum(CASE WHEN px IS NOT NULL THEN sqrt((x - px) * (x - px) + (y - py) * (y - py)) WHEN n > 2 THEN sqrt((x - lx) * (x - lx) + (y - ly) * (y - ly)) ELSE 0 END), 6) AS length FROM pt GROUP BY grp"), columns=None)
_AREA = "sum(CASE WHEN n < 3 THEN 0 ELSE coalesce(px, lx) * y - x * coalesce(py, ly) END) * 0.5"
on_emb("oriented_contour_area", lambda r: G.oriented_contour_area(_points(r)).select("grp", F.round("area", 3).alias("area")), _PT, ("r", f"SELECT grp, round({_AREA}, 3)::DOUBLE AS area FROM pt GROUP BY grp"), columns=None)
on_emb("contour_area", lambda r: G.contour_area(_points(r)).select("grp", F.round("area", 3).alias("area")), _PT, ("r", f"SELECT grp, round(abs({_AREA}), 3)::DOUBLE AS area FROM pt GROUP BY grp"), columns=None)
on_emb("convex_hull", lambda r: G.convex_hull(_points(r)), _PT, *L.HULL, columns=None)
on_emb("min_area_rect", lambda r: G.min_area_rect(_points(r)), _PT, *L.BOX, columns=None)
on_emb("approximate_polygon_dp", lambda r: G.approximate_polygon(_points(r), 1.0, False), _PT, *L.simplified(1.0), columns=None)
on_emb("find_contours", lambda r: O.find_contours(P.threshold(r, 140, "binary")), columns=None)
on_emb("find_contours_with_threshold", lambda r: O.find_contours(r, 140), columns=None)
on_emb("find_vertical_seam", O.find_vertical_seam, L.gradient(T.SOBEL_H, T.SOBEL_V), *L.seam(), columns=None)
on_emb("remove_vertical_seam", lambda r: O.remove_vertical_seam(r, r.where("x = (img + y) % 8").select("img", "y", "x")), one("SELECT img, CAST(CASE WHEN x > (img + y) % 8 THEN x - 1 ELSE x END AS INTEGER) AS x, y, v FROM px WHERE x <> (img + y) % 8"))
on_emb(
    "shrink_width",
    lambda r: O.shrink_width(r, 6),
    L.gradient(T.SOBEL_H, T.SOBEL_V),
    *L.seam(),
    L.without_seam("px", "seam", "px7"),
    L.gradient(T.SOBEL_H, T.SOBEL_V, "px7", "grad7", 7),
    *L.seam("grad7", "7"),
    L.without_seam("px7", "seam7", "px6"),
)
on_emb("draw_filled_rect", lambda r: D.draw_filled_rect(r, 2, -1, 4, 5, [7]), one("SELECT img, x, y, CASE WHEN x BETWEEN 2 AND 5 AND y BETWEEN -1 AND 3 THEN 7 ELSE v END AS v FROM px"))
on_emb("draw_hollow_rect", lambda r: D.paint(r, D.rect_points(1, 2, 9, 4), [7]), one("SELECT img, x, y, CASE WHEN (x = 1 AND y BETWEEN 2 AND 5) OR (y IN (2, 5) AND x >= 1) THEN 7 ELSE v END AS v FROM px"))
on_emb("draw_cross", lambda r: D.paint(r, D.cross_points(0, 3), [7]), one("SELECT img, x, y, CASE WHEN abs(x) + abs(y - 3) <= 1 THEN 7 ELSE v END AS v FROM px"))
on_emb("draw_line_segment", lambda r: D.draw_line(r, (0, 0), (9, 4), [7]), one("SELECT img, x, y, CASE WHEN y = greatest(0, ceil((2 * x * 4 - 9) / 18.0)) THEN 7 ELSE v END AS v FROM px"))
on_emb("draw_antialiased_line_segment", lambda r: D.paint_weighted(r, D.wu_points((0, 0), (8, 4)), [200], lambda c, old, w: E.clamp_trunc(c * w + old * (1 - w))), one("SELECT img, x, y, CASE WHEN y = x // 2 THEN CAST(trunc(200 * (1 - (x % 2) / 2.0) + v * ((x % 2) / 2.0)) AS INTEGER) WHEN y = x // 2 + 1 THEN CAST(trunc(200 * ((x % 2) / 2.0) + v * (1 - (x % 2) / 2.0)) AS INTEGER) ELSE v END AS v FROM px"))
on_emb("draw_polygon", lambda r: D.draw_polygon(r, [(1, 1), (6, 1), (6, 5), (1, 5)], [7]), one("SELECT img, x, y, CASE WHEN x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 5 THEN 7 ELSE v END AS v FROM px"))
on_emb("draw_hollow_polygon", lambda r: D.paint(r, D.polygon_outline([(1.0, 1.0), (6.0, 1.0), (6.0, 5.0), (1.0, 5.0)]), [7]), one("SELECT img, x, y, CASE WHEN (x IN (1, 6) AND y BETWEEN 1 AND 5) OR (y IN (1, 5) AND x BETWEEN 1 AND 6) THEN 7 ELSE v END AS v FROM px"))
_SMOOTH = [(1, 1), (6, 2), (4, 6)]
add("draw_antialiased_polygon", lambda spark, d: D.draw_antialiased_polygon(S.emb8(spark, d), _SMOOTH, [200], lambda c, old, w: E.clamp_trunc(c * w + old * (1 - w))).select(*XYV), L.smooth_polygon(_SMOOTH, 200))
on_emb("draw_hollow_circle", lambda r: D.paint(r, D.ellipse_points((3, 3), 3, 3), [7]), L.circle(3), L.drawn(3, 3, False, 7))
on_emb("draw_filled_circle", lambda r: D.paint_spans(r, D.ellipse_spans((3, 3), 2, 2), [7]), L.circle(2), L.drawn(3, 3, True, 7))
on_emb("draw_hollow_ellipse", lambda r: D.paint(r, D.ellipse_points((4, 3), 4, 2), [7]), L.ellipse(4, 2), L.drawn(4, 3, False, 7))
on_emb("draw_filled_ellipse", lambda r: D.paint_spans(r, D.ellipse_spans((4, 3), 4, 2), [7]), L.ellipse(4, 2), L.drawn(4, 3, True, 7))
on_emb("draw_cubic_bezier_curve", lambda r: D.paint(r, D.bezier_points((0.0, 0.0), (7.0, 7.0), (7.0, 0.0), (0.0, 7.0)), [7]), L.bezier((0.0, 0.0), (7.0, 7.0), (7.0, 0.0), (0.0, 7.0)), L.segments("seg", "one"), one("SELECT img, x, y, CASE WHEN EXISTS (SELECT 1 FROM mark m WHERE m.x = px.x AND m.y = px.y) THEN 7 ELSE v END AS v FROM px"))


def _sizes(spark, d: str) -> DataFrame:
    """A raster size for each supplier."""
    key = F.col("s_suppkey")
    return spark.read.parquet(f"{d}/supplier.parquet").select(key.alias("img"), (key % 9 + 3).cast("int").alias("w"), (key % 7 + 2).cast("int").alias("h"))


_BENCH = "FROM supplier, range(11) a(x), range(8) b(y) WHERE x < s_suppkey % 9 + 3 AND y < s_suppkey % 7 + 2"
add("gray_bench_image", lambda spark, d: S.gray_benches(_sizes(spark, d)).select(*XYV), f"SELECT s_suppkey AS img, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(x % 7 + y % 6 AS INTEGER) AS v {_BENCH}")
add("rgb_bench_image", lambda spark, d: S.rgb_benches(_sizes(spark, d)).select("c", *XYV), f"SELECT CAST(c AS INTEGER) AS c, s_suppkey AS img, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(CASE c WHEN 0 THEN x % 7 + y % 6 WHEN 1 THEN 255 - (x % 7 + y % 6) ELSE least(x % 7 + y % 6, 255 - (x % 7 + y % 6)) END AS INTEGER) AS v {_BENCH.replace('FROM', 'FROM range(3) k(c),')}")
add("luma32f_bench_image", lambda spark, d: S.float_benches(_sizes(spark, d)).select("img", "x", "y", E.rounded("v", 6).alias("v")), f"SELECT s_suppkey AS img, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, round((x % 7 + y % 6) / 255.0::DOUBLE, 6) AS v {_BENCH}")
add("heat_raster", lambda spark, d: S.heat(spark, d).select("x", "y", "v"), "SELECT CAST(gx AS INTEGER) AS x, CAST(gy AS INTEGER) AS y, CAST(least(255, count(l_quantity)) AS INTEGER) AS v FROM range(50) a(gx) CROSS JOIN range(11) b(gy) LEFT JOIN lineitem ON CAST(l_quantity AS INTEGER) - 1 = gx AND CAST(round(l_discount * 100) AS INTEGER) = gy GROUP BY gx, gy")
on_emb("pack_round_trip", lambda r: S.tall(S.packed(r)), one("SELECT img, x, y, v FROM px"))
on_emb("pixel_diffs", lambda r: P.diffs(r, r.withColumn("v", F.when(F.col("x") == F.col("y"), 0).otherwise(F.col("v")))).select("img", "x", "y", "actual", "expected"), one("SELECT img, x, y, v AS actual, 0 AS expected FROM px WHERE x = y AND v <> 0"), columns=None)
_PLACE = ("img", "'0'", "x", "y")
on_emb("gaussian_noise", lambda r: P.gaussian_noise(r, 5.0, 3.0, 1), one(f"SELECT img, x, y, {Q.clamp('v + sqrt(-2 * ln(' + L.even(2, *_PLACE) + ')) * cos(2 * pi() * ' + L.even(3, *_PLACE) + ') * 3 + 5')} AS v FROM px"))
on_emb("salt_and_pepper_noise", lambda r: P.salt_and_pepper(r, 0.1, 1), one(f"SELECT img, x, y, CASE WHEN s >= 0.1::DOUBLE THEN v WHEN s < 0.05::DOUBLE THEN 0 ELSE 255 END AS v FROM (SELECT *, {L.even(1, 'img', 'x', 'y')} AS s FROM px)"))

# ---- rectangles, lines and drawings of other operators' results ----------------------------------------

add(
    "rect_intersect",
    lambda spark, d: _rects(spark, d).select("id", F.col("both.left").alias("left"), F.col("both.top").alias("top"), F.col("both.width").alias("width"), F.col("both.height").alias("height"), "holds"),
    """SELECT id, CASE WHEN ok THEN l END AS "left", CASE WHEN ok THEN t END AS top, CASE WHEN ok THEN r - l + 1 END AS width, CASE WHEN ok THEN b - t + 1 END AS height,
  CAST(id % 13 BETWEEN al AND al + 5 AND id % 11 BETWEEN a_top AND a_top + 3 AS BOOLEAN) AS holds
FROM (SELECT *, r >= l AND b >= t AS ok FROM (SELECT id, al, a_top, greatest(al, bl) AS l, greatest(a_top, bt) AS t, least(al + 5, bl + 3) AS r, least(a_top + 3, bt + 6) AS b
  FROM (SELECT id, id % 7 AS al, id % 5 AS a_top, id * 3 % 11 AS bl, id * 5 % 9 AS bt FROM (SELECT l_orderkey * 8 + l_linenumber AS id FROM lineitem))))""",
)


def _line_ids(spark, d: str) -> DataFrame:
    """A number for each row of ``lineitem``."""
    return spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))


def _rects(spark, d: str) -> DataFrame:
    i = F.col("id")
    a, b = G.rect(i % 7, i % 5, F.lit(6), F.lit(4)), G.rect(i * 3 % 11, i * 5 % 9, F.lit(4), F.lit(7))
    return _line_ids(spark, d).select("id", G.rect_intersect(a, b).alias("both"), G.rect_contains(a, i % 13, i % 11).alias("holds"))


add(
    "line_distance",
    lambda spark, d: spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", E.rounded(G.line_distance(F.lit(0.0), F.lit(1.0), F.lit(40.0), F.lit(31.0), F.col("l_quantity"), F.col("l_discount") * 100), 6).alias("distance")),
    "SELECT l_orderkey, l_linenumber, round(abs(40.0::DOUBLE * (l_discount * 100 - 1) - 30.0::DOUBLE * l_quantity) / 50.0::DOUBLE, 6) AS distance FROM lineitem",
)
_POLAR = "SELECT id, CAST(id % 180 AS INTEGER) AS angle, id // 180 % 5 * 5 - 8 AS r FROM (SELECT l_orderkey * 8 + l_linenumber AS id FROM lineitem)"
add(
    "intersection_points",
    lambda spark, d: D.intersection_points(_line_ids(spark, d).select(F.col("id").alias("img"), F.lit(12).alias("w"), F.lit(9).alias("h"), (F.floor(F.col("id") / 180) % 5 * 5 - 8).alias("r"), (F.col("id") % 180).cast("int").alias("angle"))).select("img", "angle", *[E.rounded(c, 5).alias(c) for c in ("x0", "y0", "x1", "y1")]),
    f"""WITH l AS (SELECT id, angle, r::DOUBLE AS r, sin(radians(angle)) AS s, cos(radians(angle)) AS c FROM ({_POLAR})),
p AS (SELECT id, angle, CASE
  WHEN angle = 0 THEN [{{'x': r, 'y': 0.0::DOUBLE, 'ok': r BETWEEN 0 AND 12}}, {{'x': r, 'y': 9.0::DOUBLE, 'ok': r BETWEEN 0 AND 12}}]
  WHEN angle = 90 THEN [{{'x': 0.0::DOUBLE, 'y': r, 'ok': r BETWEEN 0 AND 9}}, {{'x': 12.0::DOUBLE, 'y': r, 'ok': r BETWEEN 0 AND 9}}]
  ELSE [{{'x': 12.0::DOUBLE, 'y': (r - 12 * c) / s, 'ok': (r - 12 * c) / s BETWEEN 0 AND 9}}, {{'x': 0.0::DOUBLE, 'y': r / s, 'ok': r / s BETWEEN 0 AND 9}},
        {{'x': (r - 9 * s) / c, 'y': 9.0::DOUBLE, 'ok': (r - 9 * s) / c BETWEEN 0 AND 12}}, {{'x': r / c, 'y': 0.0::DOUBLE, 'ok': r / c BETWEEN 0 AND 12}}] END AS pts FROM l),
k AS (SELECT id, angle, list_filter(pts, lambda z: z.ok) AS f FROM p)
SELECT id AS img, angle, CASE WHEN len(f) > 1 THEN round(f[1].x, 5) END AS x0, CASE WHEN len(f) > 1 THEN round(f[1].y, 5) END AS y0, CASE WHEN len(f) > 1 THEN round(f[2].x, 5) END AS x1, CASE WHEN len(f) > 1 THEN round(f[2].y, 5) END AS y1 FROM k""",
)
on_emb("draw_polar_lines", lambda r: D.draw_polar_lines(r, _two_lines(r), [7]), one("SELECT img, x, y, CASE WHEN x = img % 8 OR y = 2 THEN 7 ELSE v END AS v FROM px"))
on_emb("draw_hough_lines", lambda r: D.draw_polar_lines(r, _detected(r), [7]), *L.lines("v > 180", 4, 2), L.MET, L.segments("met", "img"), one("SELECT px.img, px.x, px.y, CASE WHEN m.img IS NOT NULL THEN 7 ELSE v END AS v FROM px LEFT JOIN mark m ON m.img = px.img AND m.x = px.x AND m.y = px.y"))


def _two_lines(r: DataFrame) -> DataFrame:
    rows = r.select("img").distinct()
    return rows.select("img", (F.col("img") % 8).alias("r"), F.lit(0).alias("angle")).unionByName(rows.select("img", F.lit(2).cast("bigint").alias("r"), F.lit(90).alias("angle")))


def _detected(r: DataFrame) -> DataFrame:
    from ..operators.features import detect_lines

    return detect_lines(P.threshold(r, 180, "binary"), 4, 2)


on_emb("draw_haar_feature", lambda r: D.draw_haar_feature(r, 3, 1, -1, 2, 4, 1, 2), one("SELECT img, x, y, CASE WHEN x BETWEEN 1 AND 6 AND y BETWEEN 2 AND 5 THEN CASE WHEN (x - 1) // 2 % 2 = 1 THEN 255 ELSE 0 END ELSE v END AS v FROM px"))
on_emb("render_hist_grid", lambda r: D.render_hist_grid(_cells(r), 7, 8, False), L.gradient(T.SOBEL_H, T.SOBEL_V), L.cells(8, False, 4), *L.stars(7, 8))


def _cells(r: DataFrame) -> DataFrame:
    from ..operators.features import cell_histograms

    return cell_histograms(r, 8, False, 4)


on_emb(
    "draw_vertical_seams",
    lambda r: O.draw_vertical_seams(r, [r.select("img", "y", ((F.col("img") + k * F.col("y")) % (9 - k)).cast("int").alias("x")).distinct() for k in (1, 2)]),
    one("SELECT img, CAST(c AS INTEGER) AS c, x, y, CASE WHEN x = (img + y) % 8 OR x = (img + 2 * y) % 7 + CASE WHEN (img + y) % 8 < (img + 2 * y) % 7 THEN 1 ELSE 0 END THEN CASE WHEN c = 0 THEN 255 ELSE 0 END ELSE v END AS v FROM px, range(3) t(c)"),
    columns=["img", "c", "x", "y", "v"],
)
on_emb("significant_pixel_diffs", lambda r: P.diffs(r, r.withColumn("v", F.when(F.col("x") == F.col("y"), 90).otherwise(F.col("v") + 3)), lambda a, b: F.abs(a - b) > 20).select("img", "x", "y", "actual", "expected"), one("SELECT img, x, y, v AS actual, 90 AS expected FROM px WHERE x = y AND abs(v - 90) > 20"), columns=None)


# ---- translucent drawing and descriptions of differences ------------------------------------------------

#: shapes that overlap, with their colours: a rectangle, a polygon, an ellipse, and a line twice over its own end
_LAYERS = [
    ([(y, 1, 5) for y in range(1, 6)], [200, 10, 30, 128]),
    (D.polygon_spans([(3, 2), (7, 4), (2, 7)], 8), [20, 220, 60, 90]),
    (sorted(set(D.ellipse_spans((4, 4), 3, 2))), [5, 15, 250, 200]),
    (D.point_spans([*D.line_points((0, 0), (7, 7)), (7, 7)]), [255, 255, 255, 40]),
    ([(3, 0, 7)], [1, 2, 3, 0]),
    ([(4, 2, 4)], [9, 8, 7, 255]),
]
_MARKS = ", ".join(f"({k}, {y}, {a}, {b}, {r}, {g}, {u}, {t})" for k, (y, a, b, (r, g, u, t)) in enumerate((*span, color) for spans, color in _LAYERS for span in spans))
_OVER = "(t / 255.0::DOUBLE + o[4] / 255.0::DOUBLE - t / 255.0::DOUBLE * (o[4] / 255.0::DOUBLE))"
_MIXED = ", ".join(Q.clamp(f"({c} * (t / 255.0::DOUBLE) + o[{i}] * (o[4] / 255.0::DOUBLE) * (1 - t / 255.0::DOUBLE)) / {_OVER}") for i, c in ((1, "r"), (2, "g"), (3, "u")))
add(
    "draw_blended",
    lambda spark, d: D.composite(_rgba(S.emb8(spark, d)), D.mark_rows(spark, _LAYERS)).select("img", "c", "x", "y", "v"),
    f"""WITH RECURSIVE {Q.EMB.strip()},
marks AS (SELECT * FROM (VALUES {_MARKS}) m(k, my, a, b, r, g, u, t)),
over_ AS MATERIALIZED (SELECT px.img, px.x, px.y, row_number() OVER (PARTITION BY px.img, px.x, px.y ORDER BY k) AS n, r, g, u, t FROM px JOIN marks ON px.y = my AND px.x BETWEEN a AND b),
step AS (
  SELECT img, x, y, CAST(0 AS BIGINT) AS n, [v, 255 - v, least(v, 99), (v * 7) % 256] AS o FROM px
  UNION ALL SELECT s.img, s.x, s.y, m.n, CASE WHEN t = 0 THEN o ELSE [{_MIXED}, {Q.clamp(f"{_OVER} * 255")}] END FROM step s JOIN over_ m ON m.img = s.img AND m.x = s.x AND m.y = s.y AND m.n = s.n + 1)
SELECT img, CAST(c AS INTEGER) AS c, x, y, o[c + 1] AS v FROM (SELECT img, x, y, arg_max(o, n) AS o FROM step GROUP BY img, x, y), range(4) z(c)""",
)
on_emb("describe_pixel_diffs", lambda r: P.describe_diffs(r, _changed(r), 2), columns=["img", "left", "top", "right", "bottom", "n", "text"], *(
    ("e", "SELECT img, x, y, v, CASE WHEN x = img % 8 AND (y = 3 OR (y = 7 AND img % 2 = 0) OR (y = 0 AND img % 4 = 0)) THEN (v + 40) % 256 ELSE v + x % 3 END AS w FROM px"),
    ("o", "SELECT * FROM e WHERE abs(v - w) > 2"),
    ("box", 'SELECT img, min(x) AS "left", min(y) AS top, max(x) AS "right", max(y) AS bottom, count(*) AS n FROM o GROUP BY img'),
    ("cell", "SELECT e.img, e.x, e.y, CASE WHEN abs(v - w) > 2 THEN '[' || v || ']' ELSE CAST(v AS VARCHAR) END AS a, CASE WHEN abs(v - w) > 2 THEN '[' || w || ']' ELSE CAST(w AS VARCHAR) END AS b FROM e JOIN box ON e.img = box.img WHERE bottom - top < 6 AND x BETWEEN \"left\" - 2 AND \"right\" + 2 AND y BETWEEN top - 2 AND bottom + 2"),
    ("line", "SELECT img, y, string_agg(a, ' ' ORDER BY x) || '  |  ' || string_agg(b, ' ' ORDER BY x) AS t FROM cell GROUP BY img, y"),
    ("shown", "SELECT img, 'actual  |  expected' || chr(10) || string_agg(t, chr(10) ORDER BY y) AS text FROM line GROUP BY img"),
    ("listed", "SELECT img, string_agg('(' || x || ', ' || y || '): actual ' || v || ', expected ' || w, chr(10) ORDER BY y, x) AS text FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY y, x) AS k FROM o) WHERE k <= 5 AND img IN (SELECT img FROM box WHERE bottom - top >= 6) GROUP BY img"),
    ("r", "SELECT box.*, text FROM box JOIN (SELECT * FROM shown UNION ALL SELECT * FROM listed) t ON box.img = t.img"),
))


def _changed(r: DataFrame) -> DataFrame:
    """One to three places of a column changed much, and all others by 2 at most."""
    i, y = F.col("img"), F.col("y")
    much = (F.col("x") == i % 8) & ((y == 3) | ((y == 7) & (i % 2 == 0)) | ((y == 0) & (i % 4 == 0)))
    return r.withColumn("v", F.when(much, (F.col("v") + 40) % 256).otherwise(F.col("v") + F.col("x") % 3).cast("int"))
