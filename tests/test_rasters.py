"""Small literal cases of the raster operators, and properties against brute force."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import expr as E
from rasterloom.operators import coords as C
from rasterloom.operators import draw as D
from rasterloom.operators import features as X
from rasterloom.operators import geometry as G
from rasterloom.operators import outlines as O
from rasterloom.operators import pixelwise as P
from rasterloom.operators import regions as R
from rasterloom.operators import stats as A
from rasterloom.operators import stencil as T
from rasterloom.sources import rasters as S


def grid(text):
    return [[int(v) for v in row.split()] for row in text.split(";")]


def rows(df, name="v"):
    found = {(r.x, r.y): r[name] for r in df.collect()}
    w, h = max(x for x, _ in found) + 1, max(y for _, y in found) + 1
    return [[found[x, y] for x in range(w)] for y in range(h)]


def test_integral_image(spark):
    assert rows(A.integral_image(S.literal(spark, grid("1 2 3; 4 5 6")))) == grid("0 0 0 0; 0 1 3 6; 0 5 12 21")


@pytest.mark.parametrize(
    ("kind", "expected"),
    [("binary", "0 255 0; 0 255 255"), ("truncate", "10 50 20; 50 50 50"), ("to_zero", "10 0 20; 50 0 0"), ("to_zero_inverted", "0 80 0; 0 90 70"), ("binary_inverted", "255 0 255; 255 0 0")],
)
def test_threshold(spark, kind, expected):
    assert rows(P.threshold(S.literal(spark, grid("10 80 20; 50 90 70")), 50, kind)) == grid(expected)


def test_histograms(spark):
    r = S.literal(spark, grid("1 2 3 2 1"))
    assert [x.n for x in A.histogram(r).orderBy("v").limit(4).collect()] == [0, 2, 2, 1]
    assert [x.n for x in A.cumulative_histogram(r).orderBy("v").limit(5).collect()] == [0, 2, 4, 5, 5]


def test_min_max(spark):
    r = S.literal_channels(spark, [[(1, 10, 0), (2, 20, 3), (3, 30, 255), (2, 20, 7), (1, 10, 8)]])
    assert [(x.lo, x.hi) for x in A.min_max(r).orderBy("c").collect()] == [(1, 3), (10, 30), (0, 255)]


@pytest.mark.parametrize(("p", "v"), [(0, 0), (10, 1), (15, 2), (100, 10)])
def test_percentile(spark, p, v):
    assert A.percentile(S.literal(spark, grid("1 2 3 4 5; 6 7 8 9 10")), p).first().v == v


def test_rmse_and_psnr(spark):
    a, b = S.literal(spark, grid("1 2 3; 4 5 6")), S.literal(spark, grid("8 4 7; 6 9 1"))
    assert A.rmse(a, b).first().rmse == pytest.approx(math.sqrt(114 / 6))
    assert A.psnr(a, a).first().psnr == math.inf


def test_find_extremes(spark):
    r = A.find_extremes(S.literal(spark, grid("10 7 8 1; 9 15 4 2"))).first()
    assert (r.max_value, r.max_x, r.max_y, r.min_value, r.min_x, r.min_y) == (15, 1, 1, 1, 3, 0)


def test_template(spark):
    found = X.match_template(S.literal(spark, grid("1 4 2; 2 1 3; 3 3 4")), S.literal(spark, grid("1 2; 3 4")), "sse")
    assert rows(found.withColumnsRenamed({"ox": "x", "oy": "y"}), "score") == [[14, 14], [3, 1]]
    zero = S.literal(spark, [[0] * 5] * 5)
    assert [r.score for r in X.match_template(zero, zero, "sse_normalized").collect()] == [0]


def test_components(spark):
    r = S.literal(spark, grid("1 255 2 1; 255 1 1 255; 255 255 255 255; 255 255 255 1"))
    assert rows(R.connected_components(r, 8, 255)) == grid("1 0 2 1; 0 1 1 0; 0 0 0 0; 0 0 0 3")
    board = S.literal(spark, [[255 * ((x + y) % 2 == 0) for x in range(30)] for y in range(30)])
    assert R.connected_components(board, 8).agg(F.max("v")).first()[0] == 1
    assert R.connected_components(board, 4).agg(F.max("v")).first()[0] == 450


@pytest.mark.parametrize(("norm", "corner"), [("l1", 4), ("l2", 3), ("linf", 2)])
def test_distance(spark, norm, corner):
    r = S.literal(spark, [[int((x, y) == (2, 2)) for x in range(5)] for y in range(5)])
    assert rows(R.distance_transform(r, norm))[0][0] == corner


def test_morphology_without_foreground(spark):
    black = S.literal(spark, [[0] * 3] * 2)
    assert {r.v for r in R.dilate(black, "l1", 5).collect()} == {255}
    assert {r.v for r in R.dilate(black, "l1", 4).collect()} == {0}


def test_lbp(spark):
    assert [(r.x, r.y, r.v) for r in T.local_binary_pattern(S.literal(spark, grid("6 11 14; 9 10 10; 19 0 22"))).collect()] == [(1, 1, 0b11010000)]


FAST = "10 10 0 0 0 10 10; 10 0 10 10 10 0 10; 0 10 10 10 10 10 10; 0 10 10 10 10 10 10; 0 10 10 10 10 10 10; 10 0 10 10 10 10 10; 10 10 0 0 0 10 10"


def test_fast(spark):
    r = S.literal(spark, grid(FAST))
    assert [(c.x, c.y, c.score) for c in X.corners_fast(r, 8, 12).collect()] == [(3, 3, 9)]
    r = S.literal(spark, [*grid(FAST)[:-1], [10] * 7])
    assert [(c.x, c.y, c.score) for c in X.corners_fast(r, 8, 9).collect()] == [(3, 3, 9)]
    assert X.corners_fast(r, 8, 12).count() == 0  # the south tap is missing


def test_haar(spark):
    r = S.literal(spark, grid("1 2 3 4 5; 6 7 8 9 0; 9 8 7 6 5; 4 3 2 1 0; 6 5 4 2 1"))
    f = spark.createDataFrame([("two_horizontal", 1, 2, 3, 1, 1)], "kind string, sign int, block_w int, block_h int, left int, top int")
    assert X.haar_values(r, f).first().value == 14
    sizes = spark.createDataFrame([(w, h) for w in range(5) for h in range(5)], "w int, h int")
    for c in sizes.withColumn("n", X.haar_counts(F.col("w"), F.col("h"))).collect():
        assert X.haar_features(spark, c.w, c.h).count() == c.n


POINTS = {(0, 0): 8, (0, 3): 10, (0, 6): 9, (5, 5): 10, (7, 5): 15, (12, 20): 10, (13, 20): 10, (13, 21): 10}


def test_suppression(spark):
    r = S.literal(spark, [[POINTS.get((x, y), 0) for x in range(25)] for y in range(25)])
    assert {(p.x, p.y) for p in R.suppress_non_maximum(r, 3).where("v > 0").collect()} == {(0, 3), (7, 5), (12, 20)}
    points = spark.createDataFrame([(0, x, y, float(s)) for (x, y), s in POINTS.items()], "img long, x int, y int, score double")
    assert {(p.x, p.y) for p in R.local_maxima(points, 3).collect()} == {(0, 3), (7, 5), (12, 20)}


def test_local_maxima_last_row(spark):
    points = spark.createDataFrame([(0, 0, 5, 1.0), (0, 1, 5, 9.0)], "img long, x int, y int, score double")
    assert R.local_maxima(points, 3).count() == 2


def test_remove_seam(spark):
    r = S.literal(spark, grid("0 1 2 3; 10 11 12 13; 20 21 22 23"))
    seam = spark.createDataFrame([(0, 2, 2), (0, 1, 1), (0, 0, 0)], "img long, y int, x int")
    assert rows(O.remove_vertical_seam(r, seam)) == grid("1 2 3; 10 12 13; 20 21 23")
    marks = O.seam_marks([seam, seam])
    assert {(m.y, m.x) for m in marks.collect()} == {(2, 2), (2, 3), (1, 1), (1, 2), (0, 0), (0, 1)}


def points(spark, xy):
    return spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "grp long, seq int, x double, y double")


def listed(df):
    return [(r.x, r.y) for r in df.orderBy("seq").collect()]


def test_geometry(spark):
    assert G.arc_length(points(spark, [(1, 1), (4, 5), (9, 17)])).first().length == 18
    five = [(100, 20), (140, 30), (130, 60), (80, 55), (60, 25)]
    assert listed(G.min_area_rect(points(spark, five))) == [(60, 16), (141, 24), (137, 61), (57, 53)]
    area = points(spark, [(3, 4), (5, 11), (12, 8), (9, 5), (5, 6)])
    assert G.oriented_contour_area(area).first().area == -30
    assert G.contour_area(area).first().area == 30
    star = [(100, -20), (90, 5), (60, -15), (90, 0), (80, 15), (101, 10), (130, 20), (115, 5), (140, -10), (120, -5)]
    assert listed(G.convex_hull(points(spark, star))) == [(100, -20), (140, -10), (130, 20), (80, 15), (60, -15)]
    bent = points(spark, [(0, 0), (1, 0.1), (2, 0), (3, 5)])
    assert listed(G.approximate_polygon(bent, 1.0, False)) == [(0, 0), (2, 0), (3, 5)]
    ring = points(spark, [(0, 0), (4, 0), (4, 4), (0, 0)])
    assert listed(G.approximate_polygon(ring, 0.5, True)) == [(0, 0)]


def test_flat_fields(spark):
    flat = S.literal(spark, [[15] * 5] * 5)
    for k in ((T.SOBEL_H, T.SOBEL_V), (T.SCHARR_H, T.SCHARR_V), (T.PREWITT_H, T.PREWITT_V)):
        assert {r.v for r in T.gradients(flat, *k).collect()} == {0}
    assert {r.v for r in A.adaptive_threshold(S.literal(spark, [[100] * 3] * 3), 1, 0).collect()} == {255}


def test_drawing(spark):
    r = S.literal(spark, [[1] * 5] * 5)
    drawn = rows(D.draw_line(r, (-3.0, 1.0), (6.0, 1.0), [4]))
    assert drawn[1] == [4] * 5 and drawn[0] == [1] * 5
    assert D.line_points((0, 0), (3, 7))[-1] == (3, 7)
    assert set(D.ellipse_points((0, 0), 1, 1)) == {(0, 1), (1, 0), (0, -1), (-1, 0)}


def test_clamp_trunc(spark):
    values = [(-0.9, 0), (255.9, 255), (1.9, 1), (float("nan"), 255), (300.0, 255), (-5.0, 0)]
    df = spark.createDataFrame([(v,) for v, _ in values], "v double")
    assert [r[0] for r in df.select(E.clamp_trunc(F.col("v"))).collect()] == [e for _, e in values]


def test_contours(spark):
    square = [[255 if 1 <= x <= 3 and 1 <= y <= 3 else 0 for x in range(5)] for y in range(5)]
    square[2][2] = 0
    found = O.find_contours(S.literal(spark, square)).orderBy("contour", "seq").collect()
    kinds = {r.contour: (r.border, r.parent) for r in found}
    assert kinds == {0: ("outer", None), 1: ("hole", 0)}
    assert {(r.x, r.y) for r in found if r.contour == 0} == {(x, y) for x in (1, 2, 3) for y in (1, 2, 3)} - {(2, 2)}
    assert {(r.x, r.y) for r in found if r.contour == 1} == {(2, 1), (1, 2), (3, 2), (2, 3)}
    edge = O.find_contours(S.literal(spark, grid("255 255 0; 255 255 0"))).collect()
    assert {r.border for r in edge} == {"hole"}  # a region in column 0 starts no outer border


@pytest.mark.parametrize("seed", range(3))
def test_random_rasters(spark, seed):
    rng = random.Random(seed)
    w, h = rng.choice([(1, 5), (5, 1), (4, 6), (7, 3)])
    v = np.array([[rng.choice([0, 0, rng.randrange(256)]) for _ in range(w)] for _ in range(h)])
    r = S.literal(spark, v.tolist())
    padded = np.pad(v, 2, mode="edge")
    median = [[int(np.sort(padded[y + 1 : y + 4, x : x + 5].ravel())[7]) for x in range(w)] for y in range(h)]
    assert rows(T.median_filter(r, 2, 1)) == median
    hits = [(x, y) for y in range(h) for x in range(w) if v[y, x]]
    edt = [[min(((x - a) ** 2 + (y - b) ** 2 for a, b in hits), default=math.inf) for x in range(w)] for y in range(h)]
    assert rows(R.squared_distance(r)) == edt


def test_warps(spark):
    r = S.literal(spark, grid("1 2 3; 4 5 6; 7 8 9"))
    assert rows(C.warp(r, C.Projection.translate(1, 0), "nearest", 0)) == grid("0 1 2; 0 4 5; 0 7 8")
    same = C.Projection.from_control_points([(0, 0), (1, 0), (1, 1), (0, 1)], [(0, 0), (1, 0), (1, 1), (0, 1)])
    for how in ("nearest", "bilinear", "bicubic"):
        assert rows(C.warp(r, C.Projection.translate(0, 0), how, "replicate")) == grid("1 2 3; 4 5 6; 7 8 9")
    assert np.allclose(same.matrix, np.eye(3).ravel(), atol=1e-9)
    assert C.Projection.from_matrix([0] * 9) is None
    with pytest.raises(ValueError):
        C.crop(r, 0, 0, 0, 1)


def test_hash_against_numpy(spark):
    v = np.random.default_rng(0).integers(0, 256, (32, 32))
    r = S.literal(spark, v.tolist())
    k, n = np.arange(32), np.arange(32)
    m = np.cos(math.pi / 32 * (n + 0.5)[None, :] * k[:, None])
    block = (m @ v @ m.T)[1:9, 1:9].ravel()
    bits = sum(1 << i for i, b in enumerate(block > block.mean()) if b)
    assert X.phash(r).first().h % (1 << 64) == bits


def test_descriptor_matching(spark):
    rng = random.Random(4)
    base = [[rng.getrandbits(63) for _ in range(4)] for _ in range(40)]
    near = [[base[i][0] ^ 1, *base[i][1:]] for i in range(10)]
    table = lambda rs: spark.createDataFrame(list(enumerate(rs)), "id long, bits array<bigint>")
    found = {r.id_a: (r.id_b, r.distance) for r in X.match_descriptors(table(near), table(base), 10).collect()}
    assert len(found) >= 9 and all(b == a and d == 1 for a, (b, d) in found.items())


def test_empty(spark):
    none = S.literal(spark, [[1]]).where("v > 5")
    for out in (T.median_filter(none, 1, 1), A.histogram(none), R.connected_components(none), A.integral_image(none), X.average_hash(none), R.squared_distance(none)):
        assert out.count() == 0


# ---- lines, stars and seams that other operators found ----------------------------------------------


def test_segment_places_match_the_generator(spark):
    rng = random.Random(3)
    ends = [tuple(rng.choice((rng.randrange(12), rng.random() * 12)) for _ in range(4)) for _ in range(60)] + [(3, 3, 3, 3)]
    rows = spark.createDataFrame([(i, *map(float, e)) for i, e in enumerate(ends)], "img long, x0 double, y0 double, x1 double, y1 double")
    found = {}
    for r in D.segment_places(rows).collect():
        found.setdefault(r.img, []).append((r.x, r.y))
    assert {i: sorted(p) for i, p in found.items()} == {i: sorted(D.line_points(e[:2], e[2:])) for i, e in enumerate(ends)}


@pytest.mark.parametrize(("r", "angle", "points"), [(1.5, 0, (1.5, 0, 1.5, 5)), (-1, 0, None), (4, 90, (0, 4, 10, 4)), (6, 90, None), (5 / math.sqrt(2), 45, (0, 5, 0, 5)), (-2 / math.sqrt(2), 135, (7, 5, 2, 0)), (100, 30, None)])
def test_intersection_points(spark, r, angle, points):
    row = D.intersection_points(spark.createDataFrame([(0, 10, 5, float(r), angle)], "img long, w int, h int, r double, angle int")).first()
    found = (row.x0, row.y0, row.x1, row.y1)
    if points is None:
        assert found == (None,) * 4
    elif angle == 45:  # a corner's two sides meet in one place; rounding decides which two of the three points count
        assert all(min(abs(a - b) for b in (0, 5)) < 1e-6 for a in found)
    else:
        assert found == pytest.approx(points, abs=1e-9)


def test_draw_polar_lines(spark):
    r = S.literal(spark, [[0] * 4] * 3)
    lines = spark.createDataFrame([(0, 2.0, 0), (0, 1.0, 90), (5, 0.0, 0)], "img long, r double, angle int")
    assert rows(D.draw_polar_lines(r, lines, [9])) == grid("0 0 9 0; 9 9 9 9; 0 0 9 0")


def test_draw_haar_feature(spark):
    r = S.literal(spark, [[5] * 5] * 4)
    assert rows(D.draw_haar_feature(r, 2, 2, 1, 2, 1, 1, 1)) == grid("5 5 5 5 5; 5 255 255 0 0; 5 0 0 255 255; 5 5 5 5 5")


def test_render_hist_grid(spark):
    cells = spark.createDataFrame([(0, 0, 0, 0, 300.0), (0, 0, 0, 1, 70.9), (0, 1, 0, 1, 8.0)], "img long, cx int, cy int, bin int, v double")
    found = rows(D.render_hist_grid(cells, 5, 2, False))
    assert len(found) == 5 and len(found[0]) == 10
    assert found[2][2] == 70 and found[0][2] == 255 and found[2][4] == 70 and found[0][0] == 0
    assert found[2][9] == 8 and found[0][7] == 0


def test_draw_vertical_seams(spark):
    r = S.literal(spark, grid("1 2 3 4; 5 6 7 8"))
    seams = [spark.createDataFrame([(0, y, x) for y, x in enumerate(xs)], "img long, y int, x int") for xs in ((1, 2), (1, 1), (0, 1))]
    red = O.draw_vertical_seams(r, seams).where("c = 0")
    assert rows(red) == grid("255 255 3 4; 5 255 255 8")


def test_rectangles(spark):
    row = spark.range(1).select(G.rect_intersect(G.rect(0, 0, 5, 5), G.rect(3, 4, 9, 9)).alias("a"), G.rect_intersect(G.rect(0, 0, 2, 2), G.rect(2, 0, 2, 2)).alias("b"), G.rect_contains(G.rect(1, 1, 2, 2), F.lit(2), F.lit(3)).alias("c")).first()
    assert tuple(row.a) == (3, 4, 2, 1) and row.b is None and not row.c


def test_rasters_of_any_number_and_width(spark):
    """Region labels where rasters are numbered by hashes; seams where widths differ."""
    from rasterloom.operators import outlines, regions
    from rasterloom.sources import rasters

    rows = [[1, 0, 2, 1], [0, 1, 1, 0], [0, 0, 0, 1]]
    one = rasters.literal(spark, rows, img=-(2**62) - 5).unionByName(rasters.literal(spark, rows, img=2**62 + 7))
    found = regions.connected_components(one, 8).collect()
    assert len({r.img for r in found}) == 2 and max(r.v for r in found) == 2 and len(found) == 24
    mixed = rasters.literal(spark, [[3, 1, 4, 1]] * 3, img=1).unionByName(rasters.literal(spark, [[2, 7, 1, 8, 2, 8]] * 3, img=2)).unionByName(rasters.literal(spark, [[5, 6]] * 3, img=3))
    left = {(r.img, r.w, r["count"]) for r in outlines.shrink_width(mixed, 3).groupBy("img", "w").count().collect()}
    assert left == {(1, 3, 9), (2, 3, 9), (3, 2, 6)}


def test_fast_exponential_and_noise(spark):
    import math

    from pyspark.sql import functions as F

    from rasterloom.functions import expr
    from rasterloom.operators import pixelwise
    from rasterloom.sources import rasters

    rows = spark.range(200).select((-F.col("id") / 2.0).alias("x")).withColumn("e", expr.fast_exp_negative(F.col("x"))).collect()
    assert all(abs(r.e - math.exp(r.x)) <= 0.05 * math.exp(r.x) for r in rows if r.x > -85) and rows[-1].e == 0
    flat = rasters.gray_bench(spark, 40, 30).withColumn("v", F.lit(100))
    noisy = [sorted(map(tuple, pixelwise.gaussian_noise(flat.repartition(n), 0.0, 10.0, 3).collect())) for n in (1, 5)]
    values = [r[-1] for r in noisy[0]]
    assert noisy[0] == noisy[1] and abs(sum(values) / len(values) - 99.5) < 1.5 and 20 < max(values) - 100 < 60


def test_components_of_hubs_and_chains(spark, monkeypatch):
    from rasterloom.operators import components

    monkeypatch.setattr(components, "HUB", 5)
    star = [(0, i) for i in range(1, 60)] + [(i, 3) for i in range(60, 90)]
    chain = [(i, i + 1) for i in range(100, 140)] + [(500, 500)]
    edges = spark.createDataFrame(star + chain, "a long, b long")
    found = {r.id: r.label for r in components.component_labels(edges).collect()}
    assert found == {i: 0 for i in range(90)} | {i: 100 for i in range(100, 141)}


def png(path, w, h, colour, data):
    """Writes raw rows as a PNG file; ``colour`` 0 is gray, 2 is RGB."""
    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    n = len(data) // h
    lines = b"".join(b"\0" + data[i * n : (i + 1) * n] for i in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))


@pytest.mark.parametrize(("colour", "channels", "w", "h"), [(0, 1, 16, 16), (2, 3, 16, 16), (2, 3, 5, 3)])
def test_images_from_files(spark, tmp_path, colour, channels, w, h):
    data = bytes((7 * i + i // 256) % 256 for i in range(w * h * channels))
    png(tmp_path / "a.png", w, h, colour, data)
    found = {(r.y, r.x, r.c): r.v for r in S.from_images(spark, str(tmp_path)).collect()}
    assert found == {(i // channels // w, i // channels % w, i % channels): v for i, v in enumerate(data)}


def test_named_pixels():
    assert E.black(2, "u16", alpha=True) == (0, 65535) and E.white(4, "u16") == (65535,) * 4 and E.black() == (0,)
    assert E.black(1) == (0,) and E.black(4, alpha=True) == (0, 0, 0, 255) and E.white(3) == (255, 255, 255)


def test_hog_spec(spark):
    spec = X.HogSpec.of(8, 8, 8, 2, 2, 1)
    r = S.literal(spark, [[(x * y) % 9 for x in range(8)] for y in range(8)])
    found = X.hog(r, 8, True, 2, 2, 1)
    assert spec.descriptor_length() == 3 * 3 * 4 * 8 >= found.count()
    assert found.select("bx", "by").distinct().count() == spec.blocks_wide * spec.blocks_high and found.agg(F.max("bin")).first()[0] < 8
    for bad in ((9, 8, 8, 2, 2, 1), (8, 8, 8, 2, 3, 2), (8, 8, 8, 4, 3, 1)):
        with pytest.raises(ValueError):
            X.HogSpec.of(*bad)


def test_assertions(spark):
    a, b = S.literal(spark, [[1, 2], [3, 4]]), S.literal(spark, [[1, 2], [3, 6]])
    P.assert_pixels_equal(a, a)
    P.assert_pixels_equal(a, b, 2)
    with pytest.raises(AssertionError, match="4, expected 6"):
        P.assert_pixels_equal(a, b, 1)
    with pytest.raises(AssertionError, match="dimensions"):
        P.assert_dimensions_match(a, S.literal(spark, [[1, 2]]))
