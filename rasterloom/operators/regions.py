"""Distances, connectivity and growth over all rasters at once: folds along rows, and classes of runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr as E
from . import stencil as T
from .components import checkpointed, component_labels

FOUR = [(1, 0), (0, 1), (-1, 0), (0, -1)]
EIGHT = [*FOUR, (1, 1), (-1, 1), (1, -1), (-1, -1)]


def _column_distance(r: DataFrame, foreground: bool) -> DataFrame:
    """``r`` with ``g``, the distance to the nearest hit in the column: running maxima down and up; null where there is none."""
    hit = F.col("v") != 0 if foreground else F.col("v") == 0
    before = F.last(F.when(hit, F.col("y")), ignorenulls=True).over(T.COL().rowsBetween(W.unboundedPreceding, 0))
    after = F.first(F.when(hit, F.col("y")), ignorenulls=True).over(T.COL().rowsBetween(0, W.unboundedFollowing))
    return r.withColumn("g", F.least(F.col("y") - before, after - F.col("y")))


def row_envelopes(g: np.ndarray, squared: bool) -> np.ndarray:
    """For each row and place x, the least over s of (x - s)^2 + g(s)^2, or of max(|x - s|, g(s)).

    Each row keeps the lower envelope of its curves as a stack of sources and the places where they take over; a
    curve is pushed once and popped at most once, and a second pass reads the envelope from its end.  All rows take a
    step together, so the work is linear in the places.
    """
    n, width = g.shape
    cost = (lambda x, s: (x - s) ** 2 + g[rows, s] ** 2) if squared else (lambda x, s: np.maximum(np.abs(x - s), g[rows, s]))

    def takes_over(i: np.ndarray, u: int, rows: np.ndarray) -> np.ndarray:
        """The last place where source i, left of u, is no worse than u."""
        gi, gu = g[rows, i], g[rows, u]
        if squared:
            return (u * u - i * i + gu * gu - gi * gi) // (2 * (u - i))
        return np.where(gi <= gu, np.maximum(i + gu, (i + u) // 2), np.minimum(u - gi, (i + u) // 2))

    source, start, top = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64), np.zeros(n, np.int64)
    for u in range(1, width):
        rows = np.arange(n)
        while len(rows):  # pop what u beats where it begins
            s, at = source[rows, top[rows]], start[rows, top[rows]]
            rows = rows[cost(at, s) > cost(at, u)]
            top[rows] -= 1
            rows = rows[top[rows] >= 0]
        rows = np.flatnonzero(top < 0)
        top[rows], source[rows, 0], start[rows, 0] = 0, u, 0
        rows = np.flatnonzero(source[np.arange(n), top] != u)
        begins = 1 + takes_over(source[rows, top[rows]], u, rows)
        rows, begins = rows[begins < width], begins[begins < width]
        top[rows] += 1
        source[rows, top[rows]], start[rows, top[rows]] = u, begins
    out = np.empty((n, width), np.int64)
    rows = np.arange(n)
    for x in range(width - 1, -1, -1):
        out[:, x] = cost(x, source[rows, top])
        top -= start[rows, top] == x
    return out


#: places whose rows are folded together
FOLDED = 1 << 20


def _folded_rows(columns: DataFrame, squared: bool) -> DataFrame:
    """``columns`` (with g) with ``d``, the least cost along each row; -1 where the raster's column distances are all missing.

    Rows are dealt by line and streamed; lines of one width are folded together.
    """
    fed = columns.select(F.col("img").cast("long").alias("img"), *[F.col(k).cast("int").alias(k) for k in ("w", "h", "c", "x", "y")], F.coalesce("g", F.lit(-1)).cast("long").alias("g"))
    fed = fed.repartition("img", "c", "y").sortWithinPartitions("img", "c", "y", "x")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= FOLDED:
                table = pa.Table.from_batches(held).combine_chunks()
                line = np.stack([table.column(k).to_numpy() for k in ("img", "c", "y")], 1)
                same = (line == line[-1]).all(1)
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last line may go on
                if cut:
                    yield from _fold(table.slice(0, cut), squared)
                held = table.slice(cut).to_batches()
                n = table.num_rows - cut
        if n:
            yield from _fold(pa.Table.from_batches(held).combine_chunks(), squared)

    return fed.mapInArrow(folded, "img bigint, w int, h int, c int, x int, y int, d bigint")


def _fold(table: pa.Table, squared: bool) -> Iterator[pa.RecordBatch]:
    img, w, h, c, x, y, g = (table.column(k).to_numpy() for k in ("img", "w", "h", "c", "x", "y", "g"))
    new = np.concatenate([[True], (img[1:] != img[:-1]) | (c[1:] != c[:-1]) | (y[1:] != y[:-1])])
    line = np.cumsum(new) - 1
    out = np.empty(len(g), np.int64)
    for width, height in {*zip(w[new].tolist(), h[new].tolist(), strict=True)}:
        here = (w == width) & (h == height)
        numbers, row = np.unique(line[here], return_inverse=True)
        far = width + height  # beyond any distance in the raster
        costs = np.full((len(numbers), width), far, np.int64)
        costs[row, x[here]] = np.where(g[here] < 0, far, g[here])
        found = row_envelopes(costs, squared)[row, x[here]]
        out[here] = np.where(found >= (far * far if squared else far), -1, found)
    yield pa.RecordBatch.from_arrays([*(table.column(k).combine_chunks() for k in ("img", "w", "h", "c", "x", "y")), pa.array(out)], ["img", "w", "h", "c", "x", "y", "d"])


def squared_distance(r: DataFrame, foreground: bool = True) -> DataFrame:
    """Exact squared Euclidean distance to the nearest non-zero (or zero) place; infinite where there is none.

    Columns first (running maxima), then one fold along each row: linear in the places.
    """
    rows = _folded_rows(_column_distance(r, foreground), True)
    return rows.select("img", "w", "h", "c", "x", "y", F.when(F.col("d") < 0, float("inf")).otherwise(F.col("d").cast("double")).alias("v"))


def _city_distance(r: DataFrame, norm: str, foreground: bool) -> DataFrame:
    """L1 or LInf distance, saturating at min(w + h, 255); L1 is two running minima along each row."""
    columns = _column_distance(r, foreground)
    if norm == "l1":
        before = F.min(F.col("g") - F.col("x")).over(T.ROW().rowsBetween(W.unboundedPreceding, 0)) + F.col("x")
        after = F.min(F.col("g") + F.col("x")).over(T.ROW().rowsBetween(0, W.unboundedFollowing)) - F.col("x")
        rows = columns.withColumn("d", F.least(before, after))
    else:
        rows = _folded_rows(columns, False).withColumn("d", F.when(F.col("d") >= 0, F.col("d")))
    most = F.least(F.col("w") + F.col("h"), F.lit(255))
    return rows.select("img", "w", "h", "c", "x", "y", F.least(F.coalesce("d", most), most).cast("int").alias("v"))


def distance_transform(r: DataFrame, norm: str, foreground: bool = True) -> DataFrame:
    """Distance to the nearest non-zero place as 8 bits; ``norm`` is l1, l2 (rounded up) or linf."""
    if norm in ("l1", "linf"):
        return _city_distance(r, norm, foreground)
    if norm != "l2":
        raise ValueError(f"no norm {norm}")
    return squared_distance(r, foreground).withColumn("v", F.when(F.col("v") >= 255.0 * 255.0, 255).otherwise(F.ceil(F.sqrt(F.least(F.col("v"), F.lit(65025.0))))).cast("int"))


def dilate(r: DataFrame, norm: str, k: int) -> DataFrame:
    """White where a non-zero place is within ``k``."""
    return distance_transform(r, norm).withColumn("v", F.when(F.col("v") <= k, 255).otherwise(0))


def erode(r: DataFrame, norm: str, k: int) -> DataFrame:
    """Black where a zero place of the raster is within ``k``."""
    return distance_transform(r, norm, foreground=False).withColumn("v", F.when(F.col("v") <= k, 0).otherwise(255))


def open_(r: DataFrame, norm: str, k: int) -> DataFrame:
    return dilate(erode(r, norm, k), norm, k)


def close(r: DataFrame, norm: str, k: int) -> DataFrame:
    return erode(dilate(r, norm, k), norm, k)


# ---- runs ----------------------------------------------------------------------------------

#: places of the cells that two rows' runs meet in
CELL = 32


def row_runs(r: DataFrame) -> DataFrame:
    """``r`` with ``n``, the number of the run of one value that a place lies in: y * w + the run's first x."""
    new = F.coalesce(F.col("v") != F.lag("v").over(T.ROW()), F.lit(True)) | F.coalesce(F.col("x") - F.lag("x").over(T.ROW()) > 1, F.lit(True))
    start = F.last(F.when(F.col("new"), F.col("x")), ignorenulls=True).over(T.ROW().rowsBetween(W.unboundedPreceding, 0))
    return r.withColumn("new", new).withColumn("n", F.col("y").cast("long") * F.col("w") + start).drop("new")


def run_spans(places: DataFrame) -> DataFrame:
    """(img, y, n, v, a, b) of each run, with its first and last x."""
    return places.groupBy("img", "y", "n", "v").agg(F.min("x").alias("a"), F.max("x").alias("b"))


def touching(spans: DataFrame, reach: int) -> DataFrame:
    """(img, n, v, a, b, m, v2, a2, b2): each run with those of the next row that it meets, or ``reach`` further at either end.

    Runs meet in cells of ``CELL`` columns, so a row's runs don't all meet all of the next row's.
    """
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / CELL), F.floor(hi / CELL)))
    upper = spans.select("img", (F.col("y") + 1).alias("y"), "n", "v", "a", "b", cells(F.col("a") - reach, F.col("b") + reach).alias("cell"))
    lower = spans.select("img", "y", F.col("n").alias("m"), F.col("v").alias("v2"), F.col("a").alias("a2"), F.col("b").alias("b2"), cells(F.col("a"), F.col("b")).alias("cell"))
    first = F.greatest(F.floor((F.col("a") - reach) / CELL), F.floor(F.col("a2") / CELL))
    met = upper.join(lower, ["img", "y", "cell"]).where((F.col("cell") == first) & (F.col("a") <= F.col("b2") + reach) & (F.col("a2") <= F.col("b") + reach))
    return met.drop("cell", "y")


def _key(n: str) -> Column:
    return F.struct(F.col("img"), F.col(n).alias("n"))  # one id over all rasters, whatever their numbers


#: a raster that is one tile, and one that is several
ONE_TILE, SEVERAL = f"w <= {T.TILE} AND h <= {T.TILE}", f"w > {T.TILE} OR h > {T.TILE}"


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that edges (a, b) lead to from each of 0 .. n - 1."""
    label = np.arange(n)
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while ((further := label[label]) != label).any():
            label = further


class _Grid:
    """The rows of whole tiles by place."""

    def __init__(self, table: pa.Table, key: list[str]) -> None:
        self.group = T.group_numbers(table, key)
        self.x, self.y = table.column("x").to_numpy(), table.column("y").to_numpy()
        self.places = T.Places(self.group, self.x, self.y)
        self.rows = np.full(self.places.total, -1)
        self.rows[self.places.at(self.group, self.x, self.y)] = np.arange(len(self.x))

    def step(self, rows: np.ndarray, dx: int, dy: int) -> np.ndarray:
        """The rows that lie a step from ``rows`` in their tiles; -1 where there is none."""
        at = self.places.at(self.group[rows], self.x[rows] + dx, self.y[rows] + dy)
        return np.where(at < 0, -1, self.rows[at])


TILE_KEY = ["img", "c", "tx", "ty"]


def _tile_rows(r: DataFrame) -> DataFrame:
    """``r`` by tiles, in raster order within each."""
    rows = T.tiled(r.select(F.col("img").cast("long").alias("img"), *[F.col(k).cast("int").alias(k) for k in ("w", "h", "c", "x", "y")], "v"), 0, 0, 0, 0)
    return rows.sortWithinPartitions(*TILE_KEY, "y", "x")


def tile_regions(r: DataFrame, connectivity: int, background: int | None = None) -> DataFrame:
    """``r`` with ``root``, y * w + x of the first place of a place's region within its tile, and ``k``, the region's number there from 1.

    Both are null for the background.
    """
    steps = [(1, 0), (0, 1)] + [(1, 1), (-1, 1)] * (connectivity == 8)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in T.whole_groups(batches, TILE_KEY):
            grid = _Grid(table, TILE_KEY)
            v, w = table.column("v").to_numpy(), table.column("w").to_numpy()
            fore = np.flatnonzero(v != background) if background is not None else np.arange(len(v))
            ends = [(fore, grid.step(fore, dx, dy)) for dx, dy in steps]
            ends = [(i[ok], j[ok]) for i, j in ends if (ok := (j >= 0) & (v[i] == v[j])) is not None]
            label = least_labels(len(v), *(np.concatenate(side) for side in zip(*ends, strict=True)))
            hidden = np.ones(len(v), bool)
            hidden[fore] = False
            first = (label == np.arange(len(v))) & ~hidden
            upto = np.cumsum(first)
            number = upto[label] - (upto - first)[np.searchsorted(grid.group, grid.group)]
            root = grid.y[label].astype(np.int64) * w + grid.x[label]
            columns = [*(table.column(n).combine_chunks() for n in T.RASTER), pa.array(root, mask=hidden), pa.array(number.astype(np.int32), mask=hidden)]
            yield pa.RecordBatch.from_arrays(columns, [*T.RASTER, "root", "k"])

    kind = r.schema["v"].dataType.simpleString()
    return _tile_rows(r).mapInArrow(labelled, f"img bigint, w int, h int, c int, x int, y int, v {kind}, root bigint, k int")


def joined_regions(r: DataFrame, connectivity: int, background: int | None = None) -> DataFrame:
    """``r`` with ``root`` of the whole region of each place: regions of tiles, joined over the tiles' borders.

    The edge table has the pairs of regions that touch along borders, not places.
    """
    places = checkpointed(tile_regions(r, connectivity, background).drop("k"))
    steps = [(1, 0), (0, 1)] + [(1, 1), (-1, 1)] * (connectivity == 8)
    spread = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps]))
    leaves = lambda at: F.floor(F.col(at) / T.TILE) != F.floor((F.col(at) + F.col(f"o.d{at}")) / T.TILE)
    edge = ((F.col("x") % T.TILE).isin(0, T.TILE - 1)) | ((F.col("y") % T.TILE).isin(0, T.TILE - 1))
    rim = places.where(edge & F.col("root").isNotNull())
    out = rim.withColumn("o", spread).where(leaves("x") | leaves("y")).select("img", "c", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), "v", F.col("root").alias("n"))
    met = out.join(rim.select("img", "c", "x", "y", "v", F.col("root").alias("m")), ["img", "c", "x", "y", "v"])
    labels = component_labels(met.select(_key("n").alias("a"), _key("m").alias("b")))
    names = labels.select(F.col("id.img").alias("img"), F.col("id.n").alias("root"), F.col("label.n").alias("whole"))
    return places.join(names, ["img", "root"], "left").select(*T.RASTER, F.coalesce("whole", "root").alias("root"))


def split_by_tiles(r: DataFrame, one: Callable[[DataFrame], DataFrame], several: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``one`` of the rasters that are one tile and ``several`` of the others, where there are any."""
    large = r.where(SEVERAL)
    found = one(r.where(ONE_TILE))
    return found.unionByName(several(large)) if large.limit(1).count() else found


def connected_components(r: DataFrame, connectivity: int = 8, background: int = 0) -> DataFrame:
    """Labels of regions of one value, from 1 in raster order of their first place; background 0.

    Tiles label their regions; those of rasters of several tiles are joined over the borders.
    """
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    named = lambda rows: rows.select("img", "w", "h", "c", "x", "y", F.coalesce("k", F.lit(0)).cast("int").alias("v"))

    def several(large: DataFrame) -> DataFrame:
        places = checkpointed(joined_regions(large, connectivity, background))
        firsts = places.where(F.col("root") == F.col("y").cast("long") * F.col("w") + F.col("x")).select("img", "root").distinct()
        order = firsts.withColumn("k", F.row_number().over(W.partitionBy("img").orderBy("root")))
        return named(places.join(order, ["img", "root"], "left"))

    return split_by_tiles(r, lambda small: named(tile_regions(small, connectivity, background)), several)


def disjoint_sets(n: int, edges: DataFrame) -> DataFrame:
    """(id, root) for ids 0 .. n - 1 joined by ``edges(a, b)``; the root is the least id of the tree."""
    spark = edges.sparkSession
    return spark.range(n).join(component_labels(edges), "id", "left").select("id", F.coalesce("label", "id").alias("root"))


def trees(sets: DataFrame) -> DataFrame:
    """(root, members) of a :func:`disjoint_sets` table."""
    return sets.groupBy("root").agg(F.array_sort(F.collect_list("id")).alias("members"))


def flood_fill(r: DataFrame, x: int, y: int, value: int) -> DataFrame:
    """Fills the 4-connected region of the seed's value in each gray raster; its own value changes nothing.

    The region is the one of the seed's root.
    """
    filled = lambda hit: F.when(hit, value).otherwise(F.col("v")).alias("v")
    own = (F.col("x") == x) & (F.col("y") == y)

    def one(small: DataFrame) -> DataFrame:
        seed = F.max(F.when(own, F.col("root"))).over(W.partitionBy("img"))
        return tile_regions(small, 4).withColumn("seed", seed).select("img", "w", "h", "c", "x", "y", filled(F.col("root") == F.col("seed")))

    def several(large: DataFrame) -> DataFrame:
        places = checkpointed(joined_regions(large, 4)).withColumn("row", F.col("y") % DEALT)  # a region's rows are dealt, so that none lands in one task
        seeds = places.where(own).select("img", "root", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("row"), F.lit(True).alias("hit"))
        return places.join(seeds, ["img", "root", "row"], "left").select("img", "w", "h", "c", "x", "y", filled(F.col("hit")))

    return split_by_tiles(r, one, several)


#: keys that a region's rows are dealt to
DEALT = 64


def reachable(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of the ``sources(id)`` and of all that directed ``edges(a, b)`` lead to from them.

    Each round takes all edges of what is new, and the jumps of nodes with one edge, which double: a chain of n
    such nodes takes log n rounds, so rounds grow with the branchings along a path and not with its length.
    """
    edges = checkpointed(edges.where("a != b").distinct())
    ones = checkpointed(edges.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b")).where("n = 1").select("a", "b"))
    seen = checkpointed(sources.select("id").distinct())
    jumps = ones
    while True:
        step = lambda over: seen.join(over, seen.id == over.a).select(F.col("b").alias("id"))  # noqa: B023, E731
        fresh = checkpointed(step(edges).unionByName(step(jumps)).distinct().join(seen, "id", "left_anti"))
        if not fresh.limit(1).count():
            return seen
        seen = checkpointed(seen.unionByName(fresh))
        longer = checkpointed(jumps.join(jumps.select(F.col("a").alias("b"), F.col("b").alias("to")), "b").select("a", F.col("to").alias("b")))
        jumps = longer if longer.limit(1).count() else ones


#: fixed values: the six steps of edge growth (north and north-east are absent)
GROW = [(1, 0), (1, 1), (0, 1), (-1, -1), (-1, 0), (-1, 1)]


def thin_edges(r: DataFrame) -> DataFrame:
    """Sobel magnitude, kept where it is no less than both neighbours along the gradient; the border is 0."""
    g = T.gradients(r, T.SOBEL_H, T.SOBEL_V).withColumn("v", F.sqrt((F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).cast("double")))
    around = [(-1, 0), (1, 0), (-1, -1), (1, 1), (0, -1), (0, 1), (1, -1), (-1, 1)]
    near = T.neighbours(g, around)
    angle = F.degrees(F.atan2(F.col("gy").cast("double"), F.col("gx").cast("double")))
    angle = F.when(angle < 0, angle + 180.0).otherwise(angle)
    pair = lambda i, j: (F.col("v") >= F.col(f"n{i}")) & (F.col("v") >= F.col(f"n{j}"))
    keep = F.when((angle >= 157.5) | (angle < 22.5), pair(0, 1)).when(angle < 67.5, pair(2, 3)).when(angle < 112.5, pair(4, 5)).otherwise(pair(6, 7))
    inner = (F.col("x") > 0) & (F.col("y") > 0) & (F.col("x") < F.col("w") - 1) & (F.col("y") < F.col("h") - 1)
    return near.select("img", "w", "h", "c", "x", "y", F.when(inner & keep, F.col("v")).otherwise(0.0).alias("v"))


def hysteresis(r: DataFrame, low: float, high: float) -> DataFrame:
    """255 at places of ``high`` or more, and at those of ``low`` or more that growth reaches from them.

    A raster of one tile grows there; larger ones grow by runs (:func:`_grown_runs`).
    """
    return split_by_tiles(r, lambda small: _grown_tiles(small, low, high), lambda large: _grown_runs(large, low, high))


def _grown_tiles(r: DataFrame, low: float, high: float) -> DataFrame:
    """:func:`hysteresis` of rasters of one tile: each round takes the steps of all tiles from the places reached last."""
    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in T.whole_groups(batches, TILE_KEY):
            grid = _Grid(table, TILE_KEY)
            v = table.column("v").to_numpy()
            weak = v >= low
            kept = weak & (v >= high)
            fresh = np.flatnonzero(kept)
            while len(fresh):
                ahead = np.concatenate([grid.step(fresh, dx, dy) for dx, dy in GROW])
                ahead = ahead[ahead >= 0]
                fresh = np.unique(ahead[weak[ahead] & ~kept[ahead]])
                kept[fresh] = True
            columns = [*(table.column(n).combine_chunks() for n in T.RASTER[:-1]), pa.array(np.where(kept, 255, 0).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, T.RASTER)

    return _tile_rows(r).mapInArrow(grown, "img bigint, w int, h int, c int, x int, y int, v int")


def _grown_runs(r: DataFrame, low: float, high: float) -> DataFrame:
    """:func:`hysteresis` of rasters of any size.

    Growth takes the steps of ``GROW`` through places of ``low`` or more.  A run of such places along a row is reached
    as a whole.  Down, it reaches all runs that it touches; up, only those that hold the place before one of its
    own.  Runs that reach each other are one class, and classes are joined by the remaining steps down.
    """
    weak = r.where(F.col("v") >= low).withColumn("strong", F.col("v") >= high).withColumn("v", F.lit(1))
    runs = checkpointed(row_runs(weak))
    met = checkpointed(touching(run_spans(runs), 1).withColumn("back", (F.col("a2") - 1 <= F.col("b")) & (F.col("a") <= F.col("b2") - 1)))
    pairs = lambda rows: rows.select(_key("n").alias("a"), _key("m").alias("b"))
    classes = component_labels(pairs(met.where("back")))
    of = lambda rows, name: rows.join(classes.select(F.col("id").alias(name), "label"), name, "left").withColumn(name, F.coalesce("label", name)).drop("label")
    steps = of(of(pairs(met.where("not back")), "a"), "b")
    strong = of(runs.where("strong").select(_key("n").alias("id")).distinct(), "id")
    named = of(runs.select("img", "c", "x", "y", _key("n").alias("id")), "id")
    kept = named.join(reachable(strong, steps), "id", "left_semi").select("img", "c", "x", "y", F.lit(True).alias("kept"))
    return r.join(kept, ["img", "c", "x", "y"], "left").select("img", "w", "h", "c", "x", "y", F.when(F.col("kept"), 255).otherwise(0).alias("v"))


def canny(r: DataFrame, low: float, high: float) -> DataFrame:
    """Blur (1.4), Sobel, thinning, hysteresis."""
    if not 0 <= low <= high:
        raise ValueError("thresholds must ascend")
    return hysteresis(thin_edges(T.gaussian_blur(r, 1.4)), low, high)


# ---- suppression ---------------------------------------------------------------------------


def suppress_non_maximum(r: DataFrame, radius: int) -> DataFrame:
    """Keeps a value that is the largest of its block (ties: least (x, y)), zero elsewhere."""
    key = F.struct("v", (-F.col("x")).alias("a"), (-F.col("y")).alias("b"))
    rows = T.tiled(r, radius, radius, radius, radius).withColumn("m", F.max(key).over(T.TILE_ROW().rowsBetween(-radius, radius)))
    top = F.max("m").over(T.TILE_COL().rowsBetween(-radius, radius))
    return T.untiled(rows.withColumn("t", top)).select("img", "w", "h", "c", "x", "y", F.when((F.col("t.a") == -F.col("x")) & (F.col("t.b") == -F.col("y")), F.col("v")).otherwise(0).alias("v"))


def unbeaten(points: DataFrame, rivals: DataFrame, radius: int, beats: Column) -> DataFrame:
    """``points(img, x, y, score)`` that no rival (img, x2, y2, s2) within ``radius`` beats.

    Cells of side ``radius`` are the join's key, so the range condition meets nine cells, not all pairs.
    """
    cell = max(1, radius)
    at = lambda v: F.floor(F.col(v) / cell).cast("int")
    rows = points.withColumn("cx", at("x")).withColumn("cy", at("y"))
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    others = rivals.withColumn("s", steps).select("img", (at("x2") + F.col("s.i")).alias("cx"), (at("y2") + F.col("s.j")).alias("cy"), "x2", "y2", "s2")
    near = (F.abs(F.col("x") - F.col("x2")) <= radius) & (F.abs(F.col("y") - F.col("y2")) <= radius)
    a, b = rows.alias("a"), others.alias("b")
    on = (F.col("a.img") == F.col("b.img")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & near & beats
    return a.join(b, on, "left_anti").select("img", "x", "y", "score")


def higher(*tie: str) -> Column:
    """A rival with a higher score, or an equal one and a lesser place, compared in the order of ``tie``."""
    lesser = F.struct(*[F.col(f"{t}2") for t in tie]) < F.struct(*[F.col(t) for t in tie])
    return (F.col("s2") > F.col("score")) | ((F.col("s2") == F.col("score")) & lesser)


def local_maxima(points: DataFrame, radius: int) -> DataFrame:
    """Points (img, x, y, score) that no other within ``radius`` beats (ties: least (y, x)).

    Points of the last occupied row beat nobody.
    """
    rivals = points.withColumn("last", F.max("y").over(W.partitionBy("img"))).where("y < last")
    return unbeaten(points, rivals.select("img", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("score").alias("s2")), radius, higher("y", "x"))
