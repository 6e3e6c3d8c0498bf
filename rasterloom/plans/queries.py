"""Registered queries of the raster operators, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import coords as C
from ..operators import pixelwise as P
from ..operators import stats as A
from ..operators import stencil as T
from ..sources import rasters as S
from . import sql as Q
from . import sql_shapes as L

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
XYV = ["img", "x", "y", "v"]


def add(name: str, make: Query, oracle: str | None = None) -> None:
    QUERIES[name] = make
    if oracle is not None:
        ORACLES[name] = oracle


def on_emb(name: str, make: Callable[[DataFrame], DataFrame], *steps: tuple[str, str], columns: list[str] | None = XYV) -> None:
    """A query over the 8x8 rasters."""
    add(name, lambda spark, d: (lambda o: o.select(*columns) if columns else o)(make(S.emb8(spark, d))), Q.chain(*steps) if steps else None)


def on_mosaic(name: str, make: Callable[[DataFrame], DataFrame], *steps: tuple[str, str], columns: list[str] | None = XYV) -> None:
    """A query over the 40x40 rasters."""
    add(name, lambda spark, d: (lambda o: o.select(*columns) if columns else o)(make(S.mosaic(spark, d))), Q.chain(*steps, source=Q.MOSAIC) if steps else None)


def one(q: str) -> tuple[str, str]:
    return ("r", q)


# ---- projections ----------------------------------------------------------------------------

on_emb("map_subpixels", lambda r: P.map_subpixels(r, lambda v: 255 - v), one("SELECT img, x, y, 255 - v AS v FROM px"))
on_emb("map_enumerated_pixels", lambda r: P.map_enumerated(r, lambda x, y, v: v + x * 2 + y), one("SELECT img, x, y, v + x * 2 + y AS v FROM px"))
on_emb("map_pixels_gray_to_rgb", lambda r: P.map_pixels(r, lambda p: [p[0], 255 - p[0], F.least(p[0], 255 - p[0])], 1), one("SELECT img, CAST(c AS INTEGER) AS c, x, y, CASE c WHEN 0 THEN v WHEN 1 THEN 255 - v ELSE least(v, 255 - v) END AS v FROM px, range(3) t(c)"), columns=["img", "c", "x", "y", "v"])
on_emb("map_pixels2_min", lambda r: P.map_pixels2(r, C.flip_horizontal(r), lambda a, b: F.least(a, b)), one("SELECT a.img, a.x, a.y, least(a.v, b.v) AS v FROM px a JOIN px b ON a.img = b.img AND a.y = b.y AND b.x = 7 - a.x"))
for _c, _n in enumerate(("red", "green", "blue")):
    on_emb(f"from_{_n}_channel", lambda r, c=_c: P.from_channel(r, c), one(f"SELECT img, CAST(c AS INTEGER) AS c, x, y, CASE WHEN c = {_c} THEN v ELSE 0 END AS v FROM px, range(3) t(c)"), columns=["img", "c", "x", "y", "v"])
    on_emb(f"into_{_n}_channel", lambda r, c=_c: P.into_channel(P.map_pixels(r, lambda p: [p[0], 255 - p[0], F.least(p[0], F.lit(99))], 1), c), one(f"SELECT img, x, y, {('v', '255 - v', 'least(v, 99)')[_c]} AS v FROM px"))
on_emb("weighted_sum", lambda r: P.blend(r, C.flip_vertical(r), 0.7, 0.8), one(f"SELECT a.img, a.x, a.y, {Q.clamp('a.v * 0.7::DOUBLE + b.v * 0.8::DOUBLE')} AS v FROM px a JOIN px b ON a.img = b.img AND a.x = b.x AND b.y = 7 - a.y"))
on_emb("interpolate_pixels", lambda r: P.map_pixels2(r, C.rotate180(r), lambda a, b: E.interpolate(a, b, 0.25)), one(f"SELECT a.img, a.x, a.y, {Q.clamp('a.v * 0.25::DOUBLE + b.v * 0.75::DOUBLE')} AS v FROM px a JOIN px b ON a.img = b.img AND b.x = 7 - a.x AND b.y = 7 - a.y"))
add("vector_norms", lambda spark, d: spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", E.rounded(E.l1_norm(F.transform("embedding", lambda e: e.cast("double"))), 6).alias("l1"), E.rounded(E.l2_norm(F.transform("embedding", lambda e: e.cast("double"))), 6).alias("l2")), "SELECT vec_id, round(list_sum([abs(e::DOUBLE) for e in embedding]), 6) AS l1, round(sqrt(list_sum([e::DOUBLE * e::DOUBLE for e in embedding])), 6) AS l2 FROM embeddings")
_ALPHA = "(t3 / 255.0::DOUBLE + b3 / 255.0::DOUBLE - t3 / 255.0::DOUBLE * (b3 / 255.0::DOUBLE))"


def _rgba(r: DataFrame) -> DataFrame:
    return P.map_pixels(r, lambda p: [p[0], 255 - p[0], F.least(p[0], F.lit(99)), (p[0] * 7) % 256], 1)


on_emb(
    "overlay",
    lambda r: C.overlay(_rgba(r), _rgba(C.crop(C.flip_horizontal(r), 0, 0, 4, 4)), 2, 3),
    ("p4", "SELECT img, x, y, v AS b0, 255 - v AS b1, least(v, 99) AS b2, (v * 7) % 256 AS b3 FROM px"),
    ("m", "SELECT a.*, b.b0 AS t0, b.b1 AS t1, b.b2 AS t2, b.b3 AS t3 FROM p4 a LEFT JOIN p4 b ON a.img = b.img AND a.x BETWEEN 2 AND 5 AND a.y BETWEEN 3 AND 6 AND b.x = 7 - (a.x - 2) AND b.y = a.y - 3"),
    ("r", "SELECT img, CAST(c AS INTEGER) AS c, x, y, CASE WHEN t3 IS NULL OR t3 = 0 THEN [b0, b1, b2, b3][c + 1] WHEN c = 3 THEN " + Q.clamp(f"{_ALPHA} * 255") + " ELSE " + Q.clamp(f"([t0, t1, t2][c + 1] * (t3 / 255.0::DOUBLE) + [b0, b1, b2][c + 1] * (b3 / 255.0::DOUBLE) * (1 - t3 / 255.0::DOUBLE)) / {_ALPHA}") + " END AS v FROM m, range(4) z(c)"),
    columns=["img", "c", "x", "y", "v"],
)

# ---- geometry of the grid ----------------------------------------------------------------------

on_emb("crop", lambda r: C.crop(r, 2, 1, 4, 5), one("SELECT img, x - 2 AS x, y - 1 AS y, v FROM px WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 5"))
for _n, _f, _s in (("flip_horizontal", C.flip_horizontal, "7 - x AS x, y"), ("flip_vertical", C.flip_vertical, "x, 7 - y AS y"), ("rotate90", C.rotate90, "7 - y AS x, x AS y"), ("rotate180", C.rotate180, "7 - x AS x, 7 - y AS y"), ("rotate270", C.rotate270, "y AS x, 7 - x AS y")):
    on_emb(_n, _f, one(f"SELECT img, {_s}, v FROM px"))
on_emb("replace", lambda r: C.replace(r, C.flip_vertical(r), 5, 6), one("SELECT a.img, a.x, a.y, coalesce(b.v, a.v) AS v FROM px a LEFT JOIN px b ON a.img = b.img AND b.x = a.x - 5 AND 7 - b.y = a.y - 6"))
for _n, _b, _s in (("constant", 9, "coalesce((SELECT b.v FROM px b WHERE b.img = a.img AND b.x = a.x - 3 AND b.y = a.y + 2), 9)"), ("replicate", "replicate", "(SELECT b.v FROM px b WHERE b.img = a.img AND b.x = greatest(0, least(7, a.x - 3)) AND b.y = greatest(0, least(7, a.y + 2)))"), ("wrap", "wrap", "(SELECT b.v FROM px b WHERE b.img = a.img AND b.x = (a.x - 3 + 16) % 8 AND b.y = (a.y + 2 + 16) % 8)")):
    on_emb(f"translate_{_n}", lambda r, b=_b: C.translate(r, 3, -2, b), one(f"SELECT img, x, y, {_s} AS v FROM px a"))
_AFFINE = C.Projection((0.9, 0.2, 0.3, -0.1, 1.1, 0.4, 0.0, 0.0, 1.0))
_INV = _AFFINE.invert().matrix
_MAP = f"{_INV[0]!r}::DOUBLE * x + {_INV[1]!r}::DOUBLE * y + {_INV[2]!r}::DOUBLE AS fx, {_INV[3]!r}::DOUBLE * x + {_INV[4]!r}::DOUBLE * y + {_INV[5]!r}::DOUBLE AS fy"
on_emb("warp_nearest", lambda r: C.warp(r, _AFFINE, "nearest", 0), ("g", f"SELECT img, x, y, {_MAP} FROM px"), ("r", "SELECT g.img, g.x, g.y, coalesce(b.v, 0) AS v FROM g LEFT JOIN px b ON b.img = g.img AND b.x = floor(fx + 0.5) AND b.y = floor(fy + 0.5)"))
#: (x, y) to (x, y) / (1 + 0.07 x), as a matrix and by what becomes of four corners
_TILT = [(0.0, 0.0), (7.0, 0.0), (7.0, 7.0), (0.0, 7.0)]
_TILTED = "SELECT a.img, a.x, a.y, coalesce(b.v, 3) AS v FROM px a LEFT JOIN px b ON b.img = a.img AND b.x = floor(a.x / (1 - 0.07::DOUBLE * a.x) + 0.5) AND b.y = floor(a.y / (1 - 0.07::DOUBLE * a.x) + 0.5)"
on_emb("warp_control_points", lambda r: C.warp(r, C.Projection.from_control_points(_TILT, [(x / (1 + 0.07 * x), y / (1 + 0.07 * x)) for x, y in _TILT]), "nearest", 3), one(_TILTED))
on_emb("warp_from_matrix", lambda r: C.warp(r, C.Projection.from_matrix([2.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.14, 0.0, 2.0]), "nearest", 3), one(_TILTED))
on_emb("warp_translation", lambda r: C.warp(r, C.Projection.translate(2.0, -3.0), "nearest", 3), one("SELECT a.img, a.x, a.y, coalesce(b.v, 3) AS v FROM px a LEFT JOIN px b ON b.img = a.img AND b.x = a.x - 2 AND b.y = a.y + 3"))
_LERP = lambda p, q, k: Q.clamp(f"({p}) * (1.0::DOUBLE - {k}) + ({q}) * {k}")
_TAP = lambda i, j: f"coalesce((SELECT b.v FROM px b WHERE b.img = g.img AND b.x = floor(fx) + {i} AND b.y = floor(fy) + {j}), 0)"
on_emb("warp_bilinear", lambda r: C.warp(r, _AFFINE, "bilinear", 0), ("g", f"SELECT img, x, y, {_MAP} FROM px"), ("t", f"SELECT img, x, y, fx - floor(fx) AS rx, fy - floor(fy) AS ry, {_TAP(0, 0)} AS a, {_TAP(1, 0)} AS b, {_TAP(0, 1)} AS c, {_TAP(1, 1)} AS d FROM g"), ("r", f"SELECT img, x, y, {_LERP(_LERP('a', 'b', 'rx'), _LERP('c', 'd', 'rx'), 'ry')} AS v FROM t"))
_CUBIC = lambda p, k: Q.clamp(f"{p[1]} + 0.5::DOUBLE * {k} * ({p[2]} - {p[0]} + {k} * (2.0::DOUBLE * {p[0]} - 5.0::DOUBLE * {p[1]} + 4.0::DOUBLE * {p[2]} - {p[3]} + {k} * (3.0::DOUBLE * ({p[1]} - {p[2]}) + {p[3]} - {p[0]})))")
on_emb("warp_bicubic", lambda r: C.warp(r, _AFFINE, "bicubic", 0), ("g", f"SELECT img, x, y, {_MAP} FROM px"), ("t", "SELECT img, x, y, fx - floor(fx) AS rx, fy - floor(fy) AS ry, " + ", ".join(f"{_TAP(i - 1, j - 1)} AS t{4 * j + i}" for j in range(4) for i in range(4)) + " FROM g"), ("l", "SELECT img, x, y, ry, " + ", ".join(f"{_CUBIC([f't{4 * j + i}' for i in range(4)], 'rx')} AS l{j}" for j in range(4)) + " FROM t"), ("r", f"SELECT img, x, y, {_CUBIC(['l0', 'l1', 'l2', 'l3'], 'ry')} AS v FROM l"))
on_emb("warp_with", lambda r: C.warp_with(r, lambda x, y: (y / 2.0, x + 1.0), "nearest", "replicate"), one("SELECT a.img, a.x, a.y, b.v FROM px a JOIN px b ON a.img = b.img AND b.x = least(7, floor(a.y / 2.0 + 0.5)) AND b.y = least(7, a.x + 1)"))
on_emb("warp_into", lambda r: C.warp(r, C.Projection.scale(2.0, 2.0), "nearest", 0, F.col("sw") * 2, F.col("sh") * 2), one("SELECT p.img, CAST(gx AS INTEGER) AS x, CAST(gy AS INTEGER) AS y, coalesce(b.v, 0) AS v FROM (SELECT DISTINCT img FROM px) p, range(16) q(gx), range(16) s(gy) LEFT JOIN px b ON b.img = p.img AND b.x = floor(gx * 0.5 + 0.5) AND b.y = floor(gy * 0.5 + 0.5)"))
_TURNED = lambda cx, cy, ox, oy: f"cos(-0.5::DOUBLE) * (x - {ox}) - sin(-0.5::DOUBLE) * (y - {oy}) + {cx} AS fx, sin(-0.5::DOUBLE) * (x - {ox}) + cos(-0.5::DOUBLE) * (y - {oy}) + {cy} AS fy"
_NEAREST = lambda border: f"SELECT g.img, g.x, g.y, coalesce(b.v, {border}) AS v FROM g LEFT JOIN px b ON b.img = g.img AND b.x = floor(fx + 0.5) AND b.y = floor(fy + 0.5)"
on_emb("rotate", lambda r: C.rotate(r, (3.0, 2.0), 0.5, "nearest", 7), ("g", f"SELECT img, x, y, {_TURNED(3, 2, 3, 2)} FROM px"), ("r", _NEAREST(7)))
on_emb("rotate_about_center", lambda r: C.rotate_about_center(r, 0.5, "bilinear", 0), ("g", f"SELECT img, x, y, {_TURNED(4, 4, 4, 4)} FROM px"), ("t", f"SELECT img, x, y, fx - floor(fx) AS rx, fy - floor(fy) AS ry, {_TAP(0, 0)} AS a, {_TAP(1, 0)} AS b, {_TAP(0, 1)} AS c, {_TAP(1, 1)} AS d FROM g"), ("r", f"SELECT img, x, y, {_LERP(_LERP('a', 'b', 'rx'), _LERP('c', 'd', 'rx'), 'ry')} AS v FROM t"))
on_emb("rotate_about_center_no_crop", lambda r: C.rotate_about_center_no_crop(r, 0.5, "nearest", 0), ("g", f"SELECT img, CAST(gx AS INTEGER) AS x, CAST(gy AS INTEGER) AS y, {_TURNED(4, 4, 5.5, 5.5).replace('(x ', '(gx ').replace('(y ', '(gy ')} FROM (SELECT DISTINCT img FROM px) p, range(11) q(gx), range(11) s(gy)"), ("r", _NEAREST(0)))

# ---- neighbourhoods --------------------------------------------------------------------------

_K5 = T.kernel([1, 2, 0, -1, 1, 0, 3, 1, -2, 1, 1, 1, 2, 1, 0, 0, -1, 1, 1, 2, 1, 0, 1, 0, 1], 5, 5)
on_emb("filter_5x5", lambda r: T.filtered(r, _K5, lambda s: s.cast("bigint")), one(Q.filtered(_K5, "CAST(s AS BIGINT)")))
on_emb("filter_clamped", lambda r: T.filter_clamped(r, T.kernel([3, -1, 0, 2], 2, 2), "u8"), one(Q.filtered(T.kernel([3, -1, 0, 2], 2, 2), Q.clamp("s"))))
_H3 = [0.25, 0.5, 0.375]
_HK, _VK = T.kernel(_H3, 3, 1), T.kernel(_H3, 1, 3)
on_emb("horizontal_filter", lambda r: T.horizontal_filter(r, _H3), one(Q.filtered(_HK, Q.clamp("s"))))
on_emb("vertical_filter", lambda r: T.vertical_filter(r, _H3), one(Q.filtered(_VK, Q.clamp("s"))))
on_emb("separable_filter", lambda r: T.separable_filter(r, _H3), ("a", Q.filtered(_HK, Q.clamp("s"))), ("r", Q.filtered(_VK, Q.clamp("s"), "a")))
def _normal(sigma: float) -> tuple[dict, dict]:
    """A Gaussian kernel along x and along y, for SQL."""
    w = [f"CAST({x!r} AS DOUBLE)" for x in T.gaussian_weights(sigma)]
    n = len(w) // 2
    return {(i - n, 0): x for i, x in enumerate(w)}, {(0, i - n): x for i, x in enumerate(w)}


_GX, _GY = _normal(1.0)
on_emb("gaussian_blur", lambda r: T.gaussian_blur(r, 1.0), ("a", Q.filtered(_GX, Q.clamp("s"))), ("r", Q.filtered(_GY, Q.clamp("s"), "a")))
on_emb("laplacian_filter", T.laplacian, one(Q.filtered(T.LAPLACIAN, Q.clamp("s", -32768, 32767))))
on_emb("sharpen3x3", T.sharpen3x3, one(Q.filtered(T.SHARPEN, Q.clamp("s"))))
_SX, _SY = _normal(0.7)
on_emb("sharpen_gaussian", lambda r: T.sharpen_gaussian(r, 0.7, 1.5), ("a", Q.filtered(_SX, "s")), ("g", Q.filtered(_SY, "s", "a")), one(f"SELECT px.img, px.x, px.y, {Q.clamp('px.v * 2.5::DOUBLE - g.v * 1.5::DOUBLE')} AS v FROM px JOIN g ON px.img = g.img AND px.x = g.x AND px.y = g.y"))
_B = lambda n, axis: {((i, 0) if axis == "x" else (0, i)): 1 for i in range(-n, n + 1)}
on_emb("box_filter", lambda r: T.box_filter(r, 2, 1), ("a", Q.filtered(_B(2, "x"), "CAST(s // 5 AS INTEGER)")), ("r", Q.filtered(_B(1, "y"), "CAST(s // 3 AS INTEGER)", "a")))
_SQ = lambda rx, ry: {(x, y): 1 for y in range(-ry, ry + 1) for x in range(-rx, rx + 1)}
on_emb("median_filter", lambda r: T.median_filter(r, 1, 2), one(f"SELECT img, x, y, list_sort(list(v))[8] AS v FROM ({Q.near(_SQ(1, 2))}) GROUP BY img, x, y"))
_BOX = {(dx, dy): 0 for dy in (-1, 0, 1) for dx in (-1, 0, 1)}
_BITS = "greatest(0, CAST(trunc(CAST(12102203.0 AS FLOAT) * CAST((centre - v) * (centre - v) * CAST(-0.00125 AS DOUBLE) AS FLOAT) + CAST(1064866805.0 AS FLOAT)) AS BIGINT))"
on_emb(
    "bilateral_filter",
    lambda r: T.bilateral_filter(r, 1, 2.0, T.gaussian_color(20.0)),
    ("b", f"SELECT *, {_BITS} AS bits FROM ({Q.near(_BOX)})"),
    ("g", "SELECT *, exp(CAST(-0.125 AS DOUBLE) * (dx * dx + dy * dy)) * CASE WHEN bits // 8388608 = 0 THEN 0 ELSE pow(CAST(2 AS DOUBLE), bits // 8388608 - 127) * (1 + CAST(bits % 8388608 AS DOUBLE) / 8388608) END AS k FROM b"),
    one(f"SELECT img, x, y, {Q.clamp('sum(k * v) / sum(k)')} AS v FROM g GROUP BY img, x, y"),
)
for _n, _k in (("horizontal_sobel", T.SOBEL_H), ("vertical_sobel", T.SOBEL_V), ("horizontal_scharr", T.SCHARR_H), ("vertical_scharr", T.SCHARR_V), ("horizontal_prewitt", T.PREWITT_H), ("vertical_prewitt", T.PREWITT_V), ("roberts_horizontal", T.ROBERTS_H), ("roberts_vertical", T.ROBERTS_V)):
    on_emb(_n, lambda r, k=_k: T.filter_clamped(r, k, "i16"), one(Q.filtered(_k, Q.clamp("s", -32768, 32767))))


def _magnitude(h: dict, v: dict) -> str:
    both = {o: (h.get(o, 0), v.get(o, 0)) for o in {*h, *v}}
    k = ", ".join(f"({dx}, {dy}, {a}, {b})" for (dx, dy), (a, b) in both.items())
    return f"SELECT a.img, a.x, a.y, CAST(floor(sqrt(CAST(sum(k.a * b.v) * sum(k.a * b.v) + sum(k.b * b.v) * sum(k.b * b.v) AS DOUBLE))) AS INTEGER) AS v FROM px a CROSS JOIN (VALUES {k}) k(dx, dy, a, b) JOIN px b ON b.img = a.img AND b.x = greatest(0, least(7, a.x + dx)) AND b.y = greatest(0, least(7, a.y + dy)) GROUP BY a.img, a.x, a.y"


on_emb("sobel_gradients", T.sobel_gradients, one(_magnitude(T.SOBEL_H, T.SOBEL_V)))
on_emb("prewitt_gradients", T.prewitt_gradients, one(_magnitude(T.PREWITT_H, T.PREWITT_V)))
on_emb("scharr_gradients", lambda r: T.gradients(r, T.SCHARR_H, T.SCHARR_V), one(_magnitude(T.SCHARR_H, T.SCHARR_V)))
on_emb("sobel_gradient_map", lambda r: P.map_subpixels(T.sobel_gradients(r), lambda v: E.clamp_trunc(v / 4.0)), ("m", _magnitude(T.SOBEL_H, T.SOBEL_V)), ("r", f"SELECT img, x, y, {Q.clamp('v / 4.0::DOUBLE')} AS v FROM m"))
_RING = {o: 1 << i for i, o in enumerate(T.LBP_RING)}
on_emb("local_binary_pattern", T.local_binary_pattern, one(f"SELECT img, x, y, CAST(sum(CASE WHEN v < centre THEN w ELSE 0 END) AS INTEGER) AS v FROM ({Q.near(_RING)}) WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 GROUP BY img, x, y"))
_ROT = "[" + ", ".join(f"CAST((b * {2 ** (8 - i)}) % 256 + b // {2**i} AS INTEGER)" if i else "CAST(b AS INTEGER)" for i in range(8)) + "]"
add("byte_patterns", lambda spark, d: spark.range(256).select(F.col("id").cast("int").alias("b")).select("b", E.min_shift(F.col("b")).alias("least"), E.count_transitions(F.col("b")).alias("changes"), E.uniform_representative(F.col("b")).alias("uniform")), f"SELECT CAST(b AS INTEGER) AS b, list_min({_ROT}) AS least, CAST(bit_count(xor(CAST(b AS INTEGER), CAST((b % 2) * 128 + b // 2 AS INTEGER))) AS INTEGER) AS changes, CASE WHEN bit_count(xor(CAST(b AS INTEGER), CAST((b % 2) * 128 + b // 2 AS INTEGER))) <= 2 THEN list_min({_ROT}) ELSE 170 END AS uniform FROM range(256) t(b)")

for _n, _m in (("disk", T.disk_mask(2)), ("diamond", T.diamond_mask(1)), ("square", T.square_mask(1)), ("asymmetric", [(0, 0), (2, 0), (1, -1)])):
    _mk = {o: 1 for o in _m}
    on_emb(f"grayscale_dilate_{_n}", lambda r, m=_m: T.grayscale_dilate(r, m), one(f"SELECT img, x, y, max(v) AS v FROM ({Q.inside(_mk)}) GROUP BY img, x, y"))
    on_emb(f"grayscale_erode_{_n}", lambda r, m=_m: T.grayscale_erode(r, m), one(f"SELECT img, x, y, min(v) AS v FROM ({Q.inside(_mk)}) GROUP BY img, x, y"))
_D1 = {o: 1 for o in T.diamond_mask(1)}
on_emb("grayscale_open", lambda r: T.grayscale_open(r, T.diamond_mask(1)), ("a", f"SELECT img, x, y, min(v) AS v FROM ({Q.inside(_D1)}) GROUP BY img, x, y"), ("r", f"SELECT img, x, y, max(v) AS v FROM ({Q.inside(_D1, 'a')}) GROUP BY img, x, y"))
on_emb("grayscale_close", lambda r: T.grayscale_close(r, T.diamond_mask(1)), ("a", f"SELECT img, x, y, max(v) AS v FROM ({Q.inside(_D1)}) GROUP BY img, x, y"), ("r", f"SELECT img, x, y, min(v) AS v FROM ({Q.inside(_D1, 'a')}) GROUP BY img, x, y"))

# ---- aggregates, lookups and prefix sums -------------------------------------------------------

_HIST = ("hist", "SELECT p.img, CAST(b.v AS INTEGER) AS v, count(px.v) AS n FROM (SELECT DISTINCT img FROM px) p CROSS JOIN range(256) b(v) LEFT JOIN px ON px.img = p.img AND px.v = b.v GROUP BY p.img, b.v")
_CUM = ("cum", "SELECT img, v, n, CAST(sum(n) OVER (PARTITION BY img ORDER BY v) AS BIGINT) AS below, CAST(sum(n) OVER (PARTITION BY img) AS BIGINT) AS total, CAST(sum(n * v) OVER (PARTITION BY img ORDER BY v) AS BIGINT) AS sb, CAST(sum(n * v) OVER (PARTITION BY img) AS BIGINT) AS st FROM hist")
_HV = ["img", "v", "n"]
on_emb("histogram", A.histogram, _HIST, columns=_HV)
on_emb("cumulative_histogram", A.cumulative_histogram, _HIST, _CUM, ("r", "SELECT img, v, below AS n FROM cum"), columns=_HV)
on_emb("min_max", A.min_max, one("SELECT img, min(v) AS lo, max(v) AS hi FROM px GROUP BY img"), columns=["img", "lo", "hi"])
on_emb("percentile", lambda r: A.percentile(r, 35), _HIST, _CUM, ("r", "SELECT img, min(v) AS v FROM cum WHERE 100 * below // total >= 35 GROUP BY img"), columns=["img", "v"])
on_emb("root_mean_squared_error", lambda r: A.rmse(r, C.flip_horizontal(r)).select("img", E.rounded("rmse", 6).alias("rmse")), one("SELECT a.img, round(sqrt(avg(CAST((a.v - b.v) * (a.v - b.v) AS DOUBLE))), 6) AS rmse FROM px a JOIN px b ON a.img = b.img AND a.y = b.y AND b.x = 7 - a.x GROUP BY a.img"), columns=None)
on_emb("peak_signal_to_noise_ratio", lambda r: A.psnr(r, C.flip_vertical(r)).select("img", E.rounded("psnr", 6).alias("psnr")), one("SELECT a.img, round(20 * log10(255.0::DOUBLE) - 10 * log10(avg(CAST((a.v - b.v) * (a.v - b.v) AS DOUBLE))), 6) AS psnr FROM px a JOIN px b ON a.img = b.img AND a.x = b.x AND b.y = 7 - a.y GROUP BY a.img"), columns=None)
on_emb("find_extremes", A.find_extremes, one("SELECT a.img, a.v AS max_value, a.x AS max_x, a.y AS max_y, b.v AS min_value, b.x AS min_x, b.y AS min_y FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY v DESC, y, x) AS k FROM px) a JOIN (SELECT *, row_number() OVER (PARTITION BY img ORDER BY v, y, x) AS k FROM px) b ON a.img = b.img AND a.k = 1 AND b.k = 1"), columns=None)
_OTSU = ("otsu", "SELECT img, CAST(arg_max(v, (s, -v)) AS INTEGER) AS level FROM (SELECT img, v, CASE WHEN below = 0 OR below = total THEN 0.0 ELSE below * (total - below) * pow(sb / below::DOUBLE - (st - sb) / (total - below)::DOUBLE, 2) END AS s FROM cum) GROUP BY img")
on_emb("otsu_level", A.otsu_level, _HIST, _CUM, _OTSU, columns=["img", "level"])
on_emb("kapur_level", A.kapur_level, _HIST, ("p", "SELECT img, v, n / 64.0::DOUBLE AS p FROM hist"), ("e", "SELECT img, v, sum(p) OVER (PARTITION BY img ORDER BY v) AS P, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) OVER (PARTITION BY img ORDER BY v) AS H, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) OVER (PARTITION BY img) AS T FROM p".replace(" AS P,", " AS q,")), ("r", "SELECT img, CAST(arg_max(v, (s, -v)) AS INTEGER) AS level FROM (SELECT img, v, round(ln(q * (1 - q)) + H / q + (T - H) / (1 - q), 9) AS s FROM e WHERE q * (1 - q) > 1e-12) GROUP BY img"), columns=["img", "level"])
for _n, _s in (("binary", "CASE WHEN v > 100 THEN 255 ELSE 0 END"), ("binary_inverted", "CASE WHEN v > 100 THEN 0 ELSE 255 END"), ("truncate", "least(v, 100)"), ("to_zero", "CASE WHEN v > 100 THEN 0 ELSE v END"), ("to_zero_inverted", "CASE WHEN v > 100 THEN v ELSE 0 END")):
    on_emb(f"threshold_{_n}", lambda r, n=_n: P.threshold(r, 100, n), one(f"SELECT img, x, y, CAST({_s} AS INTEGER) AS v FROM px"))
on_emb("adaptive_threshold", lambda r: A.adaptive_threshold(r, 1, 3), one(f"SELECT img, x, y, CASE WHEN max(centre) >= CAST(sum(v) // count(*) AS BIGINT) - 3 THEN 255 ELSE 0 END AS v FROM ({Q.inside(_SQ(1, 1))}) GROUP BY img, x, y"))
on_emb("equalize_histogram", A.equalize_histogram, _HIST, _CUM, ("r", f"SELECT px.img, x, y, {Q.clamp('below * 255.0::DOUBLE / total')} AS v FROM px JOIN cum ON px.img = cum.img AND px.v = cum.v"))
on_emb("stretch_contrast", lambda r: P.stretch_contrast(r, 80, 180, 10, 240), one("SELECT img, x, y, CAST(CASE WHEN v <= 80 THEN 10 WHEN v >= 180 THEN 240 ELSE (v - 80) * 230 // 100 + 10 END AS INTEGER) AS v FROM px"))
on_emb("match_histogram", lambda r: A.match_histogram(r, P.stretch_contrast(r, 80, 180, 0, 255)), *L.MATCHED)
add("otsu_threshold_counts", lambda spark, d: _otsu_counts(S.emb8(spark, d)), Q.chain(_HIST, _CUM, _OTSU, ("r", "SELECT px.img, level, CAST(sum(CASE WHEN v > level THEN 1 ELSE 0 END) AS BIGINT) AS foreground FROM px JOIN otsu ON px.img = otsu.img GROUP BY px.img, level")))


def _otsu_counts(r: DataFrame) -> DataFrame:
    white = P.threshold(r.join(A.otsu_level(r), ["img", "c"]), F.col("level"), "binary")
    return white.groupBy("img", "level").agg(F.sum((F.col("v") == 255).cast("bigint")).alias("foreground"))


_PAD = "(SELECT img, CAST(gx AS INTEGER) AS x, CAST(gy AS INTEGER) AS y FROM (SELECT DISTINCT img FROM px), range(9) a(gx), range(9) b(gy))"
for _n, _s in (("integral_image", "v"), ("integral_squared_image", "v * v")):
    on_emb(_n, lambda r, q=_n != "integral_image": A.integral_image(r, q), one(f"SELECT g.img, g.x, g.y, CAST(coalesce(sum({_s}), 0) AS BIGINT) AS v FROM {_PAD} g LEFT JOIN px ON px.img = g.img AND px.x < g.x AND px.y < g.y GROUP BY g.img, g.x, g.y"))


def _rects(r: DataFrame) -> DataFrame:
    rows = r.select("img").distinct()
    return rows.select("img", *[(F.pmod(F.col("img") * a, F.lit(4)) + b).cast("int").alias(n) for n, a, b in (("left", 1, 0), ("top", 3, 0), ("right", 5, 4), ("bottom", 7, 4))])


_RECTS = ("rects", 'SELECT DISTINCT img, CAST(img % 4 AS INTEGER) AS "left", CAST(img * 3 % 4 AS INTEGER) AS top, CAST(img * 5 % 4 + 4 AS INTEGER) AS "right", CAST(img * 7 % 4 + 4 AS INTEGER) AS bottom FROM px')
on_emb("sum_image_pixels", lambda r: A.rect_sums(A.integral_image(r), _rects(r)).select("img", "total"), _RECTS, ("r", 'SELECT px.img, CAST(sum(v) AS BIGINT) AS total FROM px JOIN rects q ON px.img = q.img AND x BETWEEN q."left" AND q."right" AND y BETWEEN top AND bottom GROUP BY px.img'), columns=None)
on_emb("variance", lambda r: A.rect_variance(r, _rects(r)).select("img", E.rounded("variance", 6).alias("variance")), _RECTS, ("r", 'SELECT px.img, round(sum(v * v)::DOUBLE / count(*) - pow(sum(v)::DOUBLE / count(*), 2), 6) AS variance FROM px JOIN rects q ON px.img = q.img AND x BETWEEN q."left" AND q."right" AND y BETWEEN top AND bottom GROUP BY px.img'), columns=None)
for _n, _rows in (("row_running_sum", True), ("column_running_sum", False)):
    _l, _i = ("y", "x") if _rows else ("x", "y")
    on_emb(_n, lambda r, rows=_rows: A.running_sums(r, 2, rows), ("pad", f"SELECT img, {_l} AS line, CAST(k AS INTEGER) AS i, v FROM px JOIN range(12) t(k) ON {_i} = greatest(0, least(7, k - 2))"), ("r", "SELECT img, line, i, CAST(sum(v) OVER (PARTITION BY img, line ORDER BY i) AS BIGINT) AS v FROM pad"), columns=["img", "line", "i", "v"])
