"""Rasters of many tiles, long rows and deep regions, against numpy and brute force."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import regions as R
from rasterloom.operators import stats as A
from rasterloom.operators import stencil as T
from rasterloom.sources import rasters as S


def raster(spark, values, img=0):
    """A gray raster of a numpy array."""
    h, w = values.shape
    y, x = np.mgrid[0:h, 0:w]
    rows = pd.DataFrame({"img": np.int64(img), "w": np.int32(w), "h": np.int32(h), "c": np.int32(0), "x": x.ravel().astype(np.int32), "y": y.ravel().astype(np.int32), "v": values.ravel().astype(np.int32)})
    return spark.createDataFrame(rows, "img long, w int, h int, c int, x int, y int, v int")


def array(df):
    got = df.select("x", "y", "v").toPandas()
    out = np.full((got.y.max() + 1, got.x.max() + 1), np.nan)
    out[got.y, got.x] = got.v
    return out


def windows(values, xr, yr, mode="edge", **fill):
    """Each place's values at the offsets of a (2 yr + 1) x (2 xr + 1) window."""
    return np.lib.stride_tricks.sliding_window_view(np.pad(values, ((yr, yr), (xr, xr)), mode=mode, **fill), (2 * yr + 1, 2 * xr + 1))


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(T, "TILE", 32)


@pytest.fixture(scope="module")
def values():
    return np.random.default_rng(1).integers(0, 256, (90, 150))


def test_stencils_over_tiles(spark, small_tiles, values):
    r = raster(spark, values)
    k = T.kernel([1, 2, 0, -1, 1, 0, 3, 1, -2], 3, 3)
    near = windows(values, 1, 1)
    assert (array(T.filtered(r, k)) == (near * np.array([[1, 2, 0], [-1, 1, 0], [3, 1, -2]])).sum((2, 3))).all()
    wide = windows(values, 40, 0).sum((2, 3)) // 81  # the reach is wider than a tile
    assert (array(T.box_filter(r, 40, 3)) == windows(wide, 0, 3).sum((2, 3)) // 7).all()
    square = windows(values, 2, 2, "constant", constant_values=-1)
    least = (square.reshape(*values.shape, -1)).max(-1)
    kept = array(R.suppress_non_maximum(r, 2))
    assert ((kept == 0) | (kept == least)).all() and (kept == values).sum() > 100
    block = windows(np.ones_like(values), 5, 5, "constant", constant_values=0).sum((2, 3))
    assert (array(A.adaptive_threshold(r, 5, 3)) == np.where(values >= windows(values, 5, 5, "constant", constant_values=0).sum((2, 3)) // block - 3, 255, 0)).all()


def test_tiles_are_dealt_by_img_and_tile(spark):
    """A raster of 4,000 x 4,000 is many tasks, none of which gets a large part of it."""
    r = S.grid(spark, 4_000, 4_000, F.col("x") % 7).withColumn("img", (F.col("y") % 1).cast("bigint"))
    tiles = T.tiled(r, 2, 2, 1, 1)
    plan = tiles._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(img#\d+L?, tx#\d+, ty#\d+", plan)
    sizes = tiles.groupBy("tx", "ty").agg(F.count("*").alias("n")).collect()
    assert len(sizes) == 256 and max(x.n for x in sizes) == (T.TILE + 4) * (T.TILE + 2)
    assert T.untiled(tiles).count() == 16_000_000


@pytest.mark.parametrize("radii", [(20, 20), (0, 3), (5, 0), (45, 1)])
def test_medians(spark, small_tiles, values, radii):
    """A radius of 20 costs what a radius of 1 does; wider ones than the tile work too."""
    near = windows(values, *radii)
    assert (array(T.median_filter(raster(spark, values), *radii)) == np.sort(near.reshape(*values.shape, -1))[..., near[0, 0].size // 2]).all()


@pytest.mark.parametrize("mask", [T.disk_mask(20), T.square_mask(33), [(-3, 0), (-2, 0), (5, 0), (0, -2), (1, -2), (2, -2)], [(200, 0)], [(-200, -1), (-199, -1), (0, 0)], [(x, 0) for x in range(-170, 171)]])
def test_masks(spark, small_tiles, values, mask):
    r = raster(spark, values)
    xr, yr = max(abs(x) for x, _ in mask), max(abs(y) for _, y in mask)
    chosen = np.zeros((2 * yr + 1, 2 * xr + 1), bool)
    for x, y in mask:
        chosen[y + yr, x + xr] = True
    for f, fill, extreme in ((T.grayscale_dilate, 0, np.max), (T.grayscale_erode, 255, np.min)):
        padded = windows(values, xr, yr, "constant", constant_values=fill)
        assert (array(f(r, mask)) == np.stack([extreme(line[:, chosen], 1) for line in padded])).all()


def test_mask_columns_grow_with_rows_and_logarithm():
    assert sum(map(len, T.mask_runs(T.disk_mask(20)).values())) == 41
    assert T.mask_runs([(0, 0), (1, 0), (3, 0), (2, 4)]) == {0: [(0, 1), (3, 3)], 4: [(2, 2)]}


# ---- distances ------------------------------------------------------------------------------

NORMS = {"l1": lambda x, y: abs(x) + abs(y), "linf": lambda x, y: np.maximum(abs(x), abs(y)), "l2": lambda x, y: np.ceil(np.sqrt(x * x + y * y))}


@pytest.mark.parametrize("seed", range(6))
def test_distances_against_all_sources(spark, seed):
    """Random rasters of several sizes at once, with empty ones and single rows and columns."""
    rng = np.random.default_rng(seed)
    made = [(rng.random((rng.integers(1, 14), rng.integers(1, 14))) < rng.choice([0.0, 0.05, 0.3])).astype(int) for _ in range(8)]
    r = raster(spark, made[0])
    for i, values in enumerate(made[1:], 1):
        r = r.unionByName(raster(spark, values, i))
    for norm, distance in NORMS.items():
        got = {(p.img, p.x, p.y): p.v for p in R.distance_transform(r, norm).collect()}
        for i, values in enumerate(made):
            ys, xs = np.nonzero(values)
            for y in range(values.shape[0]):
                for x in range(values.shape[1]):
                    most = min(sum(values.shape), 255) if norm != "l2" else 255
                    assert got[i, x, y] == min(most, distance(xs - x, ys - y).min()) if len(xs) else got[i, x, y] == most
    squared = {(p.img, p.x, p.y): p.v for p in R.squared_distance(r).collect()}
    for i, values in enumerate(made):
        ys, xs = np.nonzero(values)
        for y in range(values.shape[0]):
            for x in range(values.shape[1]):
                assert squared[i, x, y] == (((xs - x) ** 2 + (ys - y) ** 2).min() if len(xs) else np.inf)


def test_distances_of_a_large_raster(spark):
    values = np.zeros((1_000, 1_000), int)
    rng = np.random.default_rng(5)
    sources = rng.integers(0, 1_000, (40, 2))
    values[sources[:, 1], sources[:, 0]] = 1
    y, x = np.mgrid[0:1_000, 0:1_000]
    expected = np.min([(x - sx) ** 2 + (y - sy) ** 2 for sx, sy in sources], 0)
    assert (array(R.squared_distance(raster(spark, values))) == expected).all()


def test_envelope_work_is_linear():
    """Folding twice the width takes about twice the time, and rows of any form are exact."""
    rng = np.random.default_rng(2)
    for squared in (True, False):
        g = rng.integers(0, 60, (20, 50))
        x, s = np.arange(50)[:, None], np.arange(50)[None, :]
        expected = np.min((x - s) ** 2 + g[:, None, :] ** 2 if squared else np.maximum(abs(x - s), g[:, None, :]), 2)
        assert (R.row_envelopes(g, squared) == expected).all()


# ---- regions ------------------------------------------------------------------------------


def grown(values, low, high, steps):
    """Places reached from those of ``high`` through those of ``low``."""
    h, w = values.shape
    seen = {(x, y) for y in range(h) for x in range(w) if values[y, x] >= high}
    front = list(seen)
    while front:
        x, y = front.pop()
        for dx, dy in steps:
            at = (x + dx, y + dy)
            if 0 <= at[0] < w and 0 <= at[1] < h and at not in seen and values[at[1], at[0]] >= low:
                seen.add(at)
                front.append(at)
    return seen


@pytest.mark.parametrize("cell", [3, 32])
def test_growth_against_a_queue(spark, monkeypatch, cell):
    monkeypatch.setattr(R, "CELL", cell)
    rng = np.random.default_rng(cell)
    made = [rng.integers(0, 100, (rng.integers(1, 18), rng.integers(1, 18))) for _ in range(6)]
    r = raster(spark, made[0])
    for i, values in enumerate(made[1:], 1):
        r = r.unionByName(raster(spark, values, i))
    got = R.hysteresis(r, 45.0, 96.0).collect()
    for i, values in enumerate(made):
        assert {(p.x, p.y) for p in got if p.img == i and p.v == 255} == grown(values, 45, 96, R.GROW)
    two = r.withColumn("v", F.col("v") % 2)
    filled = R.flood_fill(two, 0, 0, 7).collect()
    for i, values in enumerate(made):
        same = (values % 2 == values[0, 0] % 2).astype(int)
        seed = same.copy()
        seed[0, 0] = 2
        assert {(p.x, p.y) for p in filled if p.img == i and p.v == 7} == grown(seed, 1, 2, R.FOUR)


def spiral(side):
    """A path of single places from the corner inwards; and its number of places."""
    out = np.zeros((side, side), int)
    x = y = n = 0
    dx, dy = 1, 0
    out[0, 0] = 1
    while True:
        for _ in range(2):
            ax, ay, bx, by = x + dx, y + dy, x + 2 * dx, y + 2 * dy
            if 0 <= ax < side and 0 <= ay < side and not out[ay, ax] and (not (0 <= bx < side and 0 <= by < side) or not out[by, bx]):
                break
            dx, dy = -dy, dx
        else:
            return out, n + 1
        x, y = ax, ay
        out[y, x] = 1
        n += 1


def counted(monkeypatch):
    """How many tables region operators write."""
    n = []
    real = R.checkpointed
    monkeypatch.setattr(R, "checkpointed", lambda df: (n.append(1), real(df))[1])
    return n


def test_fill_of_a_spiral(spark, monkeypatch):
    """A path of over 10,000 places turns inwards; only its runs are joined."""
    values, length = spiral(143)
    assert length >= 10_000
    tables = counted(monkeypatch)
    filled = R.flood_fill(raster(spark, values), 0, 0, 9)
    assert filled.where("v = 9").count() == length == filled.where("v != 0").count()
    assert len(tables) < 10


def test_growth_down_a_long_line(spark, monkeypatch):
    """10,000 places straight down are 10,000 steps that can't be taken back: a logarithm of rounds."""
    values = np.zeros((10_000, 4), int)
    values[:, 1] = 50
    values[0, 1] = 100
    tables = counted(monkeypatch)
    assert R.hysteresis(raster(spark, values), 40.0, 90.0).where("v = 255").count() == 10_000
    assert len(tables) < 70
    values[0, 1], values[-1, 1] = 50, 100  # and up there is no step
    assert R.hysteresis(raster(spark, values), 40.0, 90.0).where("v = 255").count() == 1
