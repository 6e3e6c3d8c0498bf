"""Neighbourhood operators.

Rasters are cut into tiles of ``TILE`` x ``TILE`` places, each with a halo as wide as the operator
reaches, and dealt by (img, tile): a raster of any size is many tasks, and a small one a single tile.
The windows below partition by (img, tile, c, row) or (img, tile, c, column), which that one shuffle
already satisfies, so a stencil costs a shuffle and two sorts whatever its size.  A tile's window ends
where the raster does, or beyond what its own places reach, so borders repeat the raster's edge value.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr as E

#: places of a tile's side, without its halo
TILE = 256
RASTER = ["img", "w", "h", "c", "x", "y", "v"]


def ROW():  # noqa: N802
    """A raster's row, by x."""
    return W.partitionBy("img", "c", "y").orderBy("x")


def COL():  # noqa: N802
    """A raster's column, by y."""
    return W.partitionBy("img", "c", "x").orderBy("y")


def TILE_ROW():  # noqa: N802
    """A row of a tile and its halo, by x."""
    return W.partitionBy("img", "tx", "ty", "c", "y").orderBy("x")


def TILE_COL():  # noqa: N802
    """A column of a tile and its halo, by y."""
    return W.partitionBy("img", "tx", "ty", "c", "x").orderBy("y")


Kernel = dict[tuple[int, int], float]


def kernel(data: list[float], width: int, height: int) -> Kernel:
    """Weights by offset from the anchor (width // 2, height // 2)."""
    if width < 1 or height < 1 or len(data) != width * height:
        raise ValueError("a kernel needs width * height weights")
    return {(i % width - width // 2, i // width - height // 2): data[i] for i in range(len(data))}


#: fixed values: the named kernels, row-major
SOBEL_H = kernel([-1, 0, 1, -2, 0, 2, -1, 0, 1], 3, 3)
SOBEL_V = kernel([-1, -2, -1, 0, 0, 0, 1, 2, 1], 3, 3)
SCHARR_H = kernel([-3, 0, 3, -10, 0, 10, -3, 0, 3], 3, 3)
SCHARR_V = kernel([-3, -10, -3, 0, 0, 0, 3, 10, 3], 3, 3)
PREWITT_H = kernel([-1, 0, 1, -1, 0, 1, -1, 0, 1], 3, 3)
PREWITT_V = kernel([-1, -1, -1, 0, 0, 0, 1, 1, 1], 3, 3)
ROBERTS_H = kernel([1, 0, 0, -1], 2, 2)
ROBERTS_V = kernel([0, 1, -1, 0], 2, 2)
LAPLACIAN = kernel([0, 1, 0, 1, -4, 1, 0, 1, 0], 3, 3)
SHARPEN = kernel([0, -1, 0, -1, 5, -1, 0, -1, 0], 3, 3)


def _tiles(at: str, size: str, before: int, after: int) -> Column:
    """Numbers of the tiles that need a place: those with own places from ``after`` before it to ``before`` behind it."""
    last = F.floor((F.col(size) - 1) / TILE)
    lo, hi = F.greatest(F.lit(0), F.floor((F.col(at) - after) / TILE)), F.least(F.floor((F.col(at) + before) / TILE), last)
    return F.explode(F.sequence(lo.cast("int"), hi.cast("int")))


def placed(r: DataFrame, left: int, right: int, up: int, down: int) -> DataFrame:
    """``r`` with tile numbers tx and ty; places that a tile reaches lie in it too."""
    own = lambda at: F.floor(F.col(at) / TILE).cast("int")
    out = r.withColumn("tx", _tiles("x", "w", left, right) if left or right else own("x"))
    return out.withColumn("ty", _tiles("y", "h", up, down) if up or down else own("y"))


def tiled(r: DataFrame, left: int, right: int, up: int, down: int) -> DataFrame:
    """:func:`placed`, dealt by (img, tx, ty)."""
    return placed(r, left, right, up, down).repartition("img", "tx", "ty")


def untiled(r: DataFrame) -> DataFrame:
    """The tiles' own places."""
    return r.where((F.col("tx") == F.floor(F.col("x") / TILE)) & (F.col("ty") == F.floor(F.col("y") / TILE))).drop("tx", "ty")


def whole_groups(batches: Iterator[pa.RecordBatch], key: list[str], least: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of ``least`` rows or more that end where a group of sorted ``batches`` does."""
    held: list[pa.RecordBatch] = []
    n, enough = 0, least
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < enough:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        other = np.flatnonzero(np.any([(line := table.column(k).to_numpy()) != line[-1] for k in key], 0))
        cut = int(other[-1]) + 1 if len(other) else 0  # the last group may go on
        if cut:
            yield table.slice(0, cut)
        held, n = table.slice(cut).to_batches(), table.num_rows - cut
        enough = max(least, 2 * n)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def group_numbers(table: pa.Table, key: list[str]) -> np.ndarray:
    """The number of the group that each row of a sorted table lies in."""
    lines = [table.column(k).to_numpy() for k in key]
    return np.concatenate([[0], np.cumsum(np.any([k[1:] != k[:-1] for k in lines], 0))])


class Places:
    """Numbers of places in groups of rectangles, each as large as the group's own places reach."""

    def __init__(self, group: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        self.x0, self.x1 = np.minimum.reduceat(x, first).astype(np.int64), np.maximum.reduceat(x, first).astype(np.int64)
        self.y0, self.y1 = np.minimum.reduceat(y, first).astype(np.int64), np.maximum.reduceat(y, first).astype(np.int64)
        self.width = self.x1 - self.x0 + 1
        area = self.width * (self.y1 - self.y0 + 1)
        self.offset, self.total = np.cumsum(area) - area, int(area.sum())

    def at(self, group: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The number of each place; -1 outside its group's rectangle."""
        inside = (x >= self.x0[group]) & (x <= self.x1[group]) & (y >= self.y0[group]) & (y <= self.y1[group])
        return np.where(inside, self.offset[group] + (y - self.y0[group]) * self.width[group] + x - self.x0[group], -1)


def on_tiles(r: DataFrame, x_reach: int, y_reach: int, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``f`` of each tile as an array of rows with its halo (edge values repeat); it returns the tile's own places.

    Tasks stream their tiles, one channel of one tile at a time.
    """
    kind = r.schema["v"].dataType.simpleString()
    key = ["img", "c", "tx", "ty"]
    sorted_ = tiled(r.select(*RASTER), x_reach, x_reach, y_reach, y_reach).sortWithinPartitions(*key, "y", "x")

    def computed(tile: pa.Table) -> pa.RecordBatch:
        x, y, v = (tile.column(n).to_numpy() for n in ("x", "y", "v"))
        img, c, w, h, tx, ty = (tile.column(n)[0].as_py() for n in ("img", "c", "w", "h", "tx", "ty"))
        x0, y0 = int(x.min()), int(y.min())
        values = np.zeros((int(y.max()) - y0 + 1, int(x.max()) - x0 + 1), v.dtype)
        values[y - y0, x - x0] = v
        ox, oy, ex, ey = tx * TILE, ty * TILE, min(w, (tx + 1) * TILE), min(h, (ty + 1) * TILE)
        pad = ((y_reach - (oy - y0), y_reach - (y0 + values.shape[0] - ey)), (x_reach - (ox - x0), x_reach - (x0 + values.shape[1] - ex)))
        out = f(np.pad(values, pad, mode="edge"))
        gy, gx = np.mgrid[oy:ey, ox:ex]
        n = out.size
        columns = [np.full(n, img), np.full(n, w, np.int32), np.full(n, h, np.int32), np.full(n, c, np.int32), gx.ravel().astype(np.int32), gy.ravel().astype(np.int32), out.ravel().astype(v.dtype)]
        return pa.RecordBatch.from_arrays([pa.array(k) for k in columns], RASTER)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in key], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and any(held[0].column(k)[0].as_py() != keys[a, i] for i, k in enumerate(key)):
                    yield computed(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield computed(pa.Table.from_batches(held))

    return sorted_.mapInArrow(streamed, f"img bigint, w int, h int, c int, x int, y int, v {kind}")


def _shift(v: str | Column, k: int, window, border: str = "replicate") -> Column:
    """The value ``k`` places on along a window; beyond the edge the edge's value, or null."""
    c = F.col(v) if isinstance(v, str) else v
    if k == 0:
        return c
    moved = F.lag(c, -k).over(window) if k < 0 else F.lead(c, k).over(window)
    if border == "null":
        return moved
    whole = window.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    edge = F.first(c).over(whole) if k < 0 else F.last(c).over(whole)
    return F.coalesce(moved, edge)


def reach_of(offsets: list[tuple[int, int]]) -> tuple[int, int, int, int]:
    """How far offsets go to the left, right, up and down."""
    xs, ys = [dx for dx, _ in offsets] + [0], [dy for _, dy in offsets] + [0]
    return -min(xs), max(xs), -min(ys), max(ys)


def neighbours(r: DataFrame, offsets: list[tuple[int, int]], value: str = "v", border: str = "replicate", prefix: str = "n") -> DataFrame:
    """``r`` with a column ``{prefix}{i}`` for the value at each offset (dx, dy).  Values must not be null."""
    lines = {}
    out = tiled(r, *reach_of(offsets))
    for dx in sorted({dx for dx, _ in offsets}):
        lines[dx] = f"__{prefix}r{dx - min(0, min(d for d, _ in offsets))}"
        out = out.withColumn(lines[dx], _shift(value, dx, TILE_ROW(), border))
    for i, (dx, dy) in enumerate(offsets):
        out = out.withColumn(f"{prefix}{i}", _shift(lines[dx], dy, TILE_COL(), border))
    return untiled(out.drop(*lines.values()))


def filtered(r: DataFrame, k: Kernel, finish: Callable[[Column], Column] = lambda s: s) -> DataFrame:
    """Correlation with a kernel; ``finish`` narrows the sum."""
    used = [(o, w) for o, w in k.items() if w != 0] or [((0, 0), 0)]
    near = neighbours(r, [o for o, _ in used])
    total = sum((F.col(f"n{i}") * F.lit(w) for i, (_, w) in enumerate(used)), F.lit(0))
    return near.select("img", "w", "h", "c", "x", "y", finish(total).alias("v"))


def filter_clamped(r: DataFrame, k: Kernel, kind: str = "i16") -> DataFrame:
    return filtered(r, k, lambda s: E.clamp_trunc(s, kind))


def horizontal_filter(r: DataFrame, weights: list[float], kind: str | None = "u8") -> DataFrame:
    return filtered(r, kernel(list(weights), len(weights), 1), (lambda s: E.clamp_trunc(s, kind)) if kind else (lambda s: s))


def vertical_filter(r: DataFrame, weights: list[float], kind: str | None = "u8") -> DataFrame:
    return filtered(r, kernel(list(weights), 1, len(weights)), (lambda s: E.clamp_trunc(s, kind)) if kind else (lambda s: s))


def separable_filter(r: DataFrame, h: list[float], v: list[float] | None = None, kind: str | None = "u8") -> DataFrame:
    """Rows, then columns; values are narrowed between the passes."""
    v = h if v is None else v
    if len(h) != len(v):
        raise ValueError("the two kernels have one length")
    finish = (lambda s: E.clamp_trunc(settled(s), kind)) if kind else (lambda s: s)
    return filtered(filtered(r, kernel(list(h), len(h), 1), finish), kernel(list(v), 1, len(v)), finish)


def settled(s: Column) -> Column:
    """A sum of weighted values, moved away from zero by less than any value's share, so that one that is whole but for
    the rounding of its terms is not truncated to the number below, whatever their order."""
    return s + F.signum(s) * 1e-9


def gaussian_weights(sigma: float) -> list[float]:
    """Normal densities at -ceil(2 sigma) .. ceil(2 sigma), with sum 1."""
    if sigma <= 0:
        raise ValueError("sigma must be positive")
    n = math.ceil(2 * sigma)
    raw = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-n, n + 1)]
    return [x / sum(raw) for x in raw]


def gaussian_blur(r: DataFrame, sigma: float, kind: str | None = "u8") -> DataFrame:
    return separable_filter(r, gaussian_weights(sigma), kind=kind)


def laplacian(r: DataFrame) -> DataFrame:
    return filter_clamped(r, LAPLACIAN, "i16")


def sharpen3x3(r: DataFrame) -> DataFrame:
    return filter_clamped(r, SHARPEN, "u8")


def sharpen_gaussian(r: DataFrame, sigma: float, amount: float) -> DataFrame:
    """(1 + amount) * value - amount * blur, the blur not narrowed."""
    blur = gaussian_blur(r.withColumn("v", F.col("v").cast("double")), sigma, None).select("img", "c", "x", "y", F.col("v").alias("b"))
    return r.join(blur, ["img", "c", "x", "y"]).select("img", "w", "h", "c", "x", "y", E.clamp_trunc(F.col("v") * (1.0 + amount) - F.col("b") * float(amount)).alias("v"))


def _running(window, before: str, after: str, radius: int) -> Column:
    """Sum over 2 * radius + 1 places, the edge value standing in beyond the edges."""
    whole = window.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    inner = F.sum("v").over(window.rowsBetween(-radius, radius))
    at, size = F.col(before), F.col(after)
    left, right = F.greatest(F.lit(0), radius - at), F.greatest(F.lit(0), at + radius - (size - 1))
    return inner + left * F.first("v").over(whole) + right * F.last("v").over(whole)


def box_filter(r: DataFrame, x_radius: int, y_radius: int) -> DataFrame:
    """Means by rows, then by columns, each an integer division."""
    rows = tiled(r, x_radius, x_radius, y_radius, y_radius).withColumn("v", F.floor(_running(TILE_ROW(), "x", "w", x_radius) / (2 * x_radius + 1)).cast("int"))
    return untiled(rows.withColumn("v", F.floor(_running(TILE_COL(), "y", "h", y_radius) / (2 * y_radius + 1)).cast("int")))


def sliding_median(values: np.ndarray, x_radius: int, y_radius: int) -> np.ndarray:
    """The middle of each full window, by histograms that slide.

    A histogram for each column gains the row that enters a window and loses the one that leaves; running sums over
    the columns give each window's histogram as a difference.  The work of a place doesn't depend on the radii.
    """
    bins, ranks = np.unique(values, return_inverse=True)
    ranks = ranks.reshape(values.shape)
    height, width = values.shape[0] - 2 * y_radius, values.shape[1] - 2 * x_radius
    columns = np.zeros((values.shape[1], len(bins)), np.int32)
    at = np.arange(values.shape[1])
    for row in ranks[: 2 * y_radius + 1]:
        columns[at, row] += 1
    half = (2 * x_radius + 1) * (2 * y_radius + 1) // 2
    out = np.empty((height, width), values.dtype)
    sums = np.zeros((values.shape[1] + 1, len(bins)), np.int32)
    for y in range(height):
        if y:
            columns[at, ranks[y - 1]] -= 1
            columns[at, ranks[y + 2 * y_radius]] += 1
        np.cumsum(columns, 0, out=sums[1:])
        below = np.cumsum(sums[2 * x_radius + 1 :] - sums[:width], 1)
        out[y] = bins[(below > half).argmax(1)]
    return out


def median_filter(r: DataFrame, x_radius: int, y_radius: int) -> DataFrame:
    """The middle of the (2rx+1)(2ry+1) values, edges repeated."""
    return on_tiles(r, x_radius, y_radius, lambda values: sliding_median(values, x_radius, y_radius))


def bilateral_filter(r: DataFrame, radius: int, spatial_sigma: float, color: Callable[[Column, Column], Column]) -> DataFrame:
    """Weighted mean by distance and by ``color(centre, neighbour)``, truncated."""
    offsets = [(dx, dy) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]
    near = neighbours(r, offsets)
    weights = [F.lit(math.exp(-0.5 * (dx * dx + dy * dy) / spatial_sigma**2)) * color(F.col("v"), F.col(f"n{i}")) for i, (dx, dy) in enumerate(offsets)]
    top = sum((w * F.col(f"n{i}") for i, w in enumerate(weights)), F.lit(0.0))
    return near.select("img", "w", "h", "c", "x", "y", E.clamp_trunc(settled(top / sum(weights, F.lit(0.0)))).alias("v"))


def gaussian_color(sigma: float) -> Callable[[Column, Column], Column]:
    """Colour weight exp(-d^2 / 2 sigma^2), by the fast exponential."""
    if sigma <= 0:
        raise ValueError("sigma must be positive")
    return lambda a, b: E.fast_exp_negative((a - b) * (a - b) * F.lit(-0.5 / sigma**2))


def gradients(r: DataFrame, horizontal: Kernel, vertical: Kernel) -> DataFrame:
    """trunc(sqrt(h^2 + v^2)) of the two correlations, each narrowed to i16 first; also gx and gy."""
    offsets = sorted({o for k in (horizontal, vertical) for o, w in k.items() if w})
    near = neighbours(r, offsets)
    total = lambda k: E.clamp_trunc(sum((F.col(f"n{i}") * F.lit(k[o]) for i, o in enumerate(offsets) if k.get(o)), F.lit(0)), "i16")
    out = near.withColumn("gx", total(horizontal)).withColumn("gy", total(vertical))
    size = F.floor(F.sqrt((F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).cast("double"))).cast("int")
    return out.select("img", "w", "h", "c", "x", "y", "gx", "gy", size.alias("v"))


def sobel_gradients(r: DataFrame) -> DataFrame:
    return gradients(r, SOBEL_H, SOBEL_V).drop("gx", "gy")


def prewitt_gradients(r: DataFrame) -> DataFrame:
    return gradients(r, PREWITT_H, PREWITT_V).drop("gx", "gy")


#: fixed values: a pattern's neighbours, bit 0 first
LBP_RING = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]


def local_binary_pattern(r: DataFrame) -> DataFrame:
    """Bit i is set where neighbour i is less than the centre; the border has no pattern."""
    near = neighbours(r, LBP_RING, border="null")
    bits = sum((F.when(F.col(f"n{i}") < F.col("v"), 1 << i).otherwise(0) for i in range(8)), F.lit(0))
    inner = (F.col("x") > 0) & (F.col("y") > 0) & (F.col("x") < F.col("w") - 1) & (F.col("y") < F.col("h") - 1)
    return near.where(inner).select("img", "w", "h", "c", "x", "y", bits.cast("int").alias("v"))


# ---- masks and morphology ----------------------------------------------------------------


def square_mask(radius: int) -> list[tuple[int, int]]:
    return [(x, y) for y in range(-radius, radius + 1) for x in range(-radius, radius + 1)]


def diamond_mask(radius: int) -> list[tuple[int, int]]:
    return [(x, y) for x, y in square_mask(radius) if abs(x) + abs(y) <= radius]


def disk_mask(radius: int) -> list[tuple[int, int]]:
    return [(x, y) for x, y in square_mask(radius) if x * x + y * y <= radius * radius]


def mask_from_rows(rows: list[list[int]], center_x: int, center_y: int) -> list[tuple[int, int]]:
    """Offsets of the non-zero values from the centre."""
    if len(rows) > 511 or any(len(r) > 511 for r in rows):
        raise ValueError("a mask has 511 rows and columns at most")
    return [(x - center_x, y - center_y) for y, row in enumerate(rows) for x, v in enumerate(row) if v]


def mask_runs(mask: list[tuple[int, int]]) -> dict[int, list[tuple[int, int]]]:
    """The mask's rows as runs: dy to pairs of the first and last dx."""
    runs: dict[int, list[tuple[int, int]]] = {}
    for dy, dx in sorted({(dy, dx) for dx, dy in mask}):
        line = runs.setdefault(dy, [])
        if line and line[-1][1] == dx - 1:
            line[-1] = (line[-1][0], dx)
        else:
            line.append((dx, dx))
    return runs


def _masked(r: DataFrame, mask: list[tuple[int, int]], largest: bool) -> DataFrame:
    """The extreme over the mask, by runs of its rows.

    Columns ``d{k}`` and ``e{k}`` hold the extreme of the 2^k values that begin, or end, at a place, each from two of
    the one before; any run is two such spans that overlap.  So columns grow with the mask's distinct rows and the
    logarithm of its width.
    """
    empty = 0 if largest else 255
    if not mask:
        return r.withColumn("v", F.lit(empty))
    pick = F.greatest if largest else F.least  # both skip what lies outside the raster
    of = lambda *values: pick(*values) if len(values) > 1 else values[0]
    runs = mask_runs(mask)
    distinct = sorted({run for line in runs.values() for run in line})
    whole = TILE_ROW().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = tiled(r, *reach_of(mask)).withColumns({"d0": F.col("v"), "e0": F.col("v"), "all": (F.max if largest else F.min)("v").over(whole)})
    for k in range(1, max(b - a + 1 for a, b in distinct).bit_length()):
        half = 1 << (k - 1)
        out = out.withColumns({f"d{k}": of(F.col(f"d{k - 1}"), _shift(f"d{k - 1}", half, TILE_ROW(), "null")), f"e{k}": of(F.col(f"e{k - 1}"), _shift(f"e{k - 1}", -half, TILE_ROW(), "null"))})
    for i, (a, b) in enumerate(distinct):
        k = (b - a + 1).bit_length() - 1
        spans = [_shift(f"d{k}", a, TILE_ROW(), "null"), _shift(f"d{k}", b - (1 << k) + 1, TILE_ROW(), "null")]
        spans += [_shift(f"e{k}", a + (1 << k) - 1, TILE_ROW(), "null"), _shift(f"e{k}", b, TILE_ROW(), "null")]
        both_cut = (F.col("x") + a < 0) & (F.col("x") + b >= F.col("w"))  # then the tile holds the raster's whole row
        out = out.withColumn(f"run{i}", F.when(both_cut, F.col("all")).otherwise(of(*spans)))
    tops = []
    for dy, line in runs.items():
        out = out.withColumn(f"line{len(tops)}", of(*[F.col(f"run{distinct.index(run)}") for run in line]))
        tops.append(_shift(f"line{len(tops)}", dy, TILE_COL(), "null"))
    out = untiled(out.withColumn("best", F.coalesce(of(*tops), F.lit(empty))))
    return out.select("img", "w", "h", "c", "x", "y", F.col("best").alias("v"))


def grayscale_dilate(r: DataFrame, mask: list[tuple[int, int]]) -> DataFrame:
    """The largest value at p + o for offsets o of the mask (not reflected)."""
    return _masked(r, mask, True)


def grayscale_erode(r: DataFrame, mask: list[tuple[int, int]]) -> DataFrame:
    return _masked(r, mask, False)


def grayscale_open(r: DataFrame, mask: list[tuple[int, int]]) -> DataFrame:
    return grayscale_dilate(grayscale_erode(r, mask), mask)


def grayscale_close(r: DataFrame, mask: list[tuple[int, int]]) -> DataFrame:
    return grayscale_erode(grayscale_dilate(r, mask), mask)
