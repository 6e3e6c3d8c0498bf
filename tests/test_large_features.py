"""Templates, descriptors, resampling, translucent marks and descriptions of differences against numpy and brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_large_rasters import array, raster

from rasterloom.operators import draw as D
from rasterloom.operators import features as X
from rasterloom.operators import pixelwise as P


def scores(df):
    got = df.toPandas()
    out = np.full((got.oy.max() + 1, got.ox.max() + 1), np.nan)
    out[got.oy, got.ox] = got.score
    return out


def matched(image, template, method, mask=None):
    m2 = np.ones(template.shape) if mask is None else mask.astype(float) ** 2
    near = np.lib.stride_tricks.sliding_window_view(image.astype(float), template.shape)
    it, ii = (near * template * m2).sum((2, 3)), (near**2 * m2).sum((2, 3))
    tt = (template.astype(float) ** 2 * m2).sum()
    score = tt - 2 * it + ii if method.startswith("sse") else it
    return score / np.sqrt(tt * ii) if method.endswith("normalized") else score


@pytest.mark.parametrize(("method", "sent"), [("sse", 8 << 20), ("ccorr_normalized", 0)])
def test_template_of_200(spark, monkeypatch, method, sent):
    """A template of several blocks, sent to the tasks or shuffled; nothing of it is in the plan."""
    monkeypatch.setattr(X, "SENT", sent)
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (230, 250))
    template = image[17:217, 30:230].copy()
    df = X.match_template(raster(spark, image), raster(spark, template), method)
    assert len(df._jdf.queryExecution().analyzed().toString()) < 40_000
    found, expected = scores(df), matched(image, template, method)
    assert found.shape == (31, 51) and np.allclose(found, expected, rtol=1e-12)
    best = np.argmin(found) if method == "sse" else np.argmax(found)
    assert np.unravel_index(best, found.shape) == (17, 30)


@pytest.mark.parametrize("method", ["sse_normalized", "ccorr"])
def test_template_under_a_mask(spark, method):
    rng = np.random.default_rng(4)
    image, template, mask = rng.integers(0, 256, (90, 80)), rng.integers(0, 256, (70, 66)), rng.integers(0, 3, (70, 66))
    found = scores(X.match_template(raster(spark, image), raster(spark, template), method, raster(spark, mask)))
    assert np.allclose(found, matched(image, template, method, mask), rtol=1e-12)


def test_template_larger_than_the_raster(spark):
    assert X.match_template(raster(spark, np.ones((3, 3), int)), raster(spark, np.ones((2, 4), int)), "sse").collect() == []


# ---- descriptors ----------------------------------------------------------------------------


def nearest(asked, base, threshold, apart):
    out = {}
    for q, a in asked:
        best = min(((sum((x ^ y) & (1 << 64) - 1 != 0 and ((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b, strict=True)), d) for d, b in base if not apart or d != q), default=(threshold, 0))
        if best[0] < threshold:
            out[q] = (best[1], best[0])
    return out


@pytest.mark.parametrize(("words", "threshold", "apart"), [(2, 40, True), (2, 9, False), (4, 30, True), (2, 1, True)])
def test_matches_are_exact(spark, words, threshold, apart):
    """Every asked descriptor gets its nearest, with hot groups of equal ones and ties."""
    rng = random.Random(words + threshold)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    seeds = [[rng.getrandbits(64) for _ in range(words)] for _ in range(12)]

    def near(bits, n):
        bits = list(bits)
        for _ in range(n):
            i = rng.randrange(64 * words)
            bits[i // 64] ^= 1 << i % 64
        return [signed(b) for b in bits]

    base = [(i, near(rng.choice(seeds), rng.choice([0, 1, 3, 8, 20, 38]))) for i in range(400)]
    base += [(1000 + i, near(seeds[0], 0)) for i in range(150)]
    asked = base[:60] + base[-3:]
    table = lambda rows: spark.createDataFrame(rows, "id long, bits array<long>")
    found = {r.id_a: (r.id_b, r.distance) for r in X.match_descriptors(table(asked), table(base), threshold, apart).collect()}
    assert found == nearest(asked, base, threshold, apart)


def test_larger_side_first(spark):
    table = lambda rows: spark.createDataFrame(rows, "id long, bits array<long>")
    a, b = [(i, [i, 0]) for i in range(9)], [(50, [3, 0])]
    assert [tuple(r) for r in X.match_descriptors(table(a), table(b), 5).collect()] == [(3, 50, 0)]
    assert X.match_descriptors(table(a), table([]), 5).collect() == []


# ---- resampling ----------------------------------------------------------------------------


def lanczos(values, side):
    """One matrix of normalised taps for each axis."""
    def taps(n):
        ratio = n / side
        d = (np.arange(n)[None, :] + 0.5 - (np.arange(side)[:, None] + 0.5) * ratio) / max(ratio, 1)
        k = np.where(abs(d) < 3, np.sinc(d) * np.sinc(d / 3), 0)
        return k / k.sum(1, keepdims=True)

    return taps(values.shape[0]) @ values @ taps(values.shape[1]).T


@pytest.mark.parametrize(("shape", "side"), [((40, 33), 8), ((5, 100), 8), ((3, 2), 32), ((1, 1), 8), ((64, 64), 64)])
def test_resampling(spark, shape, side):
    values = np.random.default_rng(side).integers(0, 256, shape)
    assert np.allclose(array(X.lanczos_resize(raster(spark, values), side)), lanczos(values, side), atol=1e-6)


# ---- marks and differences -------------------------------------------------------------------


def test_marks_blend_in_order(spark):
    """Later marks lie over earlier ones, a place met twice is blended twice, and each result is 8 bits."""
    rng = random.Random(5)
    back = [[[rng.randrange(256) for _ in range(4)] for _ in range(6)] for _ in range(5)]
    layers = [([(rng.randrange(5), *sorted((rng.randrange(-1, 7), rng.randrange(-1, 7)))) for _ in range(3)], [rng.randrange(256) for _ in range(3)] + [rng.choice([0, 60, 200, 255])]) for _ in range(9)]
    layers.append(([(2, 2, 2)] * 2, [10, 20, 30, 100]))
    data = [(0, 6, 5, c, x, y, back[y][x][c]) for y, x, c in itertools.product(range(5), range(6), range(4))]
    r = spark.createDataFrame(data, "img long, w int, h int, c int, x int, y int, v int")
    for y, a, b, color in ((*s, color) for spans, color in layers for s in spans):
        for x in range(max(0, a), min(5, b) + 1):
            old, fg, bg = back[y][x], color[3] / 255, back[y][x][3] / 255
            alpha = fg + bg - fg * bg
            if color[3]:
                back[y][x] = [int((color[i] * fg + old[i] * bg * (1 - fg)) / alpha) for i in range(3)] + [int(alpha * 255)]
    got = {(p.x, p.y, p.c): p.v for p in D.composite(r, D.mark_rows(spark, layers)).collect()}
    assert got == {(x, y, c): back[y][x][c] for y, x, c in itertools.product(range(5), range(6), range(4))}
    assert D.composite(r, D.mark_rows(spark, [])).exceptAll(r).count() == 0


def test_differences_in_one_and_two_regions(spark):
    one = np.arange(400).reshape(20, 20) % 90
    near, far, slight = one.copy(), one.copy(), one + 1
    near[5, 6] += 9
    near[7, 7] += 9
    far[0, 0] += 50
    far[19, 18] += 50
    actual = raster(spark, one, 0).unionByName(raster(spark, one, 1)).unionByName(raster(spark, one, 2))
    expected = raster(spark, near, 0).unionByName(raster(spark, far, 1)).unionByName(raster(spark, slight, 2))
    rows = {r.img: r for r in P.describe_diffs(actual, expected, 1).collect()}
    assert set(rows) == {0, 1}
    assert (rows[0].left, rows[0].top, rows[0].right, rows[0].bottom, rows[0].n) == (6, 5, 7, 7, 2)
    lines = rows[0].text.splitlines()
    assert len(lines) == 1 + 7 and lines[3] == f"{one[5, 4]} {one[5, 5]} [{one[5, 6]}] {one[5, 7]} {one[5, 8]} {one[5, 9]}  |  {one[5, 4]} {one[5, 5]} [{near[5, 6]}] {one[5, 7]} {one[5, 8]} {one[5, 9]}"
    assert rows[1].text == f"(0, 0): actual {one[0, 0]}, expected {far[0, 0]}\n(18, 19): actual {one[19, 18]}, expected {far[19, 18]}"
    assert P.describe_diffs(actual, expected, 0).where("img = 2").first().n == 400
    assert P.diff_summary(actual, actual) is None and "img 1" in P.diff_summary(actual, expected, tolerance=1)
