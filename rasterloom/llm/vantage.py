"""Exact searches by inner product through vantage-point trees, and hard negatives from them.

A vector x of squared length n becomes (x, sqrt(M - n)) where M is the table's largest n, and an anchor q
becomes (q, 0), so that their squared distance is ``q.q + M - 2 q.x``: higher scores are nearer, and a window
of scores is an annulus of distances around the anchor.

1. A tree over a sample of at most ``SAMPLE`` rows (those whose numbers have the least hashes) gives every row a
   leaf; a leaf of more than ``SHARD`` rows is dealt to several shards by hash, whatever its rows are.
2. Anchors go to the shards whose leaves their annuli can meet.  A task builds the shard's own tree once and
   streams the anchors through it in blocks, so neither side is ever gathered whole.
3. In a shard each window visits leaves nearest first, inside its annulus, until its ``k``-th best is nearer than
   any leaf left.  Bounds come from the distances to all vantage points above a leaf.
4. The shards' firsts meet in one window per asked window: ``k`` rows from a shard at most.

Scores are exact: integer components are multiplied as doubles where no sum can reach 2^53, else as 64-bit or
unbounded integers; a score beyond 64 bits is an error.

Defined results of :func:`hard_negatives`: rows with a null label, vector or id, or any null or non-finite
component, take no part; nor do columns other than those named.  Repeated rows are rows of their own, so one can
be the other's positive, and each row with an anchor's id asks for itself.  Missing components of a shorter vector
are zero; an empty vector scores zero.  A negative positive score has an empty window.  Ties go by smaller vec_id.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import written

#: rows that the dealing tree is fitted on, at most
SAMPLE = 8_192
#: rows of a shard that one task holds
SHARD = 8_192
#: leaves of the dealing tree at most; crowded ones are dealt by hash
LEAVES = 1_024
#: rows of a leaf of a shard's tree
LEAF = 256
#: anchors that go through a shard's tree together
ANCHORS = 256

_ROW = "row long, vec_id long, label long, vector array<long>"
_FOUND = "anchor long, w int, row long, vec_id long, score long"


# ---- trees -------------------------------------------------------------------------------


@dataclasses.dataclass
class Tree:
    """Vantage points with, for each leaf, the least and largest distance of its rows to those above it."""

    vantage: np.ndarray
    low: np.ndarray
    high: np.ndarray
    members: list[np.ndarray]
    splits: list[tuple[int, float, int, int]]  # vantage point, radius, inner and outer child; a child below 0 is leaf ~child

    @staticmethod
    def over(points: np.ndarray, leaf: int) -> Tree:
        """Splits at the median distance to a row until ``leaf`` rows or equal distances are left."""
        rng = np.random.default_rng(7)
        vantage: list[np.ndarray] = []
        splits: list[tuple[int, float, int, int]] = []
        leaves: list[tuple[np.ndarray, dict[int, tuple[float, float]]]] = []

        def leaf_of(rows: np.ndarray, bounds: dict) -> int:
            leaves.append((rows, bounds))
            return ~(len(leaves) - 1)

        def grow(rows: np.ndarray, bounds: dict) -> int:
            if len(rows) <= leaf:
                return leaf_of(rows, bounds)
            v = points[rows[rng.integers(len(rows))]]
            far = np.sqrt(((points[rows] - v) ** 2).sum(1))
            radius = float(np.median(far))
            inner = far <= radius
            if inner.all():  # ties at the median: all within it
                inner = far < radius
            if not inner.any():
                return leaf_of(rows, bounds)  # equal distances to a row of theirs: equal rows
            me = len(vantage)
            vantage.append(v)
            splits.append((me, radius, 0, 0))
            kids = [grow(rows[side], bounds | {me: (float(far[side].min()), float(far[side].max()))}) for side in (inner, ~inner)]
            splits[me] = (me, float(far[inner].max()), *kids)
            return me

        root = grow(np.arange(len(points)), {})
        assert root in (0, ~0)
        low, high = np.zeros((len(leaves), len(vantage))), np.full((len(leaves), len(vantage)), np.inf)
        for i, (_, bounds) in enumerate(leaves):
            for v, (a, b) in bounds.items():
                low[i, v], high[i, v] = a, b
        return Tree(np.array(vantage).reshape(len(vantage), points.shape[1]), low, high, [r for r, _ in leaves], splits)

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each point is dealt to."""
        at = np.zeros(len(points), np.int64) if self.splits else np.full(len(points), -1)
        while (at >= 0).any():
            for me in np.unique(at[at >= 0]):
                v, radius, inner, outer = self.splits[me]
                here = np.flatnonzero(at == me)
                far = np.sqrt(((points[here] - self.vantage[v]) ** 2).sum(1))
                at[here] = np.where(far <= radius, inner, outer)
        return ~at

    def as_dealer(self) -> Tree:
        """The same splits with the bounds that hold for any point dealt by them."""
        low, high = np.zeros_like(self.low), np.full_like(self.high, np.inf)

        def walk(at: int, bounds: dict) -> None:
            if at < 0:
                for v, (a, b) in bounds.items():
                    low[~at, v], high[~at, v] = a, b
                return
            v, radius, inner, outer = self.splits[at]
            walk(inner, bounds | {v: (0.0, radius)})
            walk(outer, bounds | {v: (radius, np.inf)})

        if self.splits:
            walk(0, {})
        return Tree(self.vantage, low, high, [], self.splits)

    def reach(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible distances of ``points`` to the rows of each leaf."""
        nearest, farthest = np.zeros((len(points), len(self.low))), np.full((len(points), len(self.low)), np.inf)
        for v in range(len(self.vantage)):
            d = np.sqrt(((points - self.vantage[v]) ** 2).sum(1))[:, None]
            np.maximum(nearest, np.maximum(d - self.high[:, v], self.low[:, v] - d), out=nearest)
            np.minimum(farthest, d + self.high[:, v], out=farthest)
        return nearest, farthest


def augmented(vectors: np.ndarray, most: float) -> np.ndarray:
    """Rows with the coordinate that gives all of them the squared length ``most``."""
    x = vectors.astype(float)
    return np.concatenate([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(1)))[:, None]], 1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer tables."""
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if top < 1 << 63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    if exact.size and max(abs(int(x)) for x in exact.flat) >= 1 << 63:
        raise OverflowError("a score doesn't fit 64 bits")
    return exact.astype(np.int64)


def radii(norms: np.ndarray, most: float, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The annulus of each window of scores: (near, far), widened by what rounding can cost."""
    total = norms + most
    slack = 1e-6 * np.sqrt(total) + 1e-9
    return np.sqrt(np.maximum(0.0, total - 2 * high)) - slack, np.sqrt(np.maximum(0.0, total - 2 * low)) + slack


# ---- searches ----------------------------------------------------------------------------


class Shard:
    """A shard's rows in its own tree."""

    def __init__(self, row: np.ndarray, vec_id: np.ndarray, label: np.ndarray, vectors: np.ndarray, most: float):
        self.most = most
        self.tree = Tree.over(augmented(vectors, most), LEAF)
        self.leaves = [(row[m], vec_id[m], label[m], vectors[m]) for m in self.tree.members]

    def search(self, anchor: np.ndarray, label: np.ndarray, vectors: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, ...]:
        """(window, row, vec_id, score) of the first ``k`` rows of each window; ``of`` is the window's anchor."""
        x = vectors.astype(float)
        norms = (x * x).sum(1)
        nearest, farthest = self.tree.reach(np.concatenate([x, np.zeros((len(x), 1))], 1))
        near, far = radii(norms[of], self.most, low.astype(float), high.astype(float))
        nearest, farthest = nearest[of], farthest[of]
        order = np.argsort(nearest, 1, kind="stable")
        meets = (nearest <= far[:, None]) & (farthest >= near[:, None]) & (low <= high)[:, None]
        found = (np.zeros(0, np.int64),) * 4
        worst = np.full(len(of), np.iinfo(np.int64).min)  # the k-th score so far
        asking = np.arange(len(of))
        for step in range(order.shape[1]):
            _, limit = radii(norms[of], self.most, np.maximum(worst, low).astype(float), high.astype(float))
            asking = asking[nearest[asking, order[asking, step]] <= limit[asking]]
            if not len(asking):
                break
            leaf = order[asking, step]
            visits = meets[asking, leaf]
            fresh = [found]
            for at in np.unique(leaf[visits]):
                fresh.append(self._scan(at, asking[visits & (leaf == at)], anchor, label, vectors, of, low, high, worst, same))
            if len(fresh) > 1:
                found, worst = _firsts(fresh, k, worst)
        return found

    def _scan(self, at: int, windows: np.ndarray, anchor: np.ndarray, label: np.ndarray, vectors: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, worst: np.ndarray, same: bool) -> tuple[np.ndarray, ...]:
        row, vec_id, labels, members = self.leaves[at]
        asked, which = np.unique(of[windows], return_inverse=True)
        scores = products(vectors[asked], members)
        fits = (labels[None, :] == label[asked][:, None]) == same
        fits &= row[None, :] != anchor[asked][:, None]
        scores, fits = scores[which], fits[which]
        fits &= (scores >= np.maximum(worst, low)[windows][:, None]) & (scores <= high[windows][:, None])
        w, r = np.nonzero(fits)
        return windows[w], row[r], vec_id[r], scores[w, r]


def _firsts(parts: list[tuple[np.ndarray, ...]], k: int, worst: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """The first ``k`` rows of each window (score down, then vec_id), and each full window's last score."""
    w, row, vec_id, score = (np.concatenate(c) for c in zip(*parts, strict=True))
    by = np.lexsort((row, vec_id, ~score, w))  # ~ turns the order round without overflow
    w, row, vec_id, score = (c[by] for c in (w, row, vec_id, score))
    place = np.arange(len(w)) - np.searchsorted(w, w)
    worst = worst.copy()
    worst[w[place == k - 1]] = score[place == k - 1]
    kept = place < k
    return tuple(c[kept] for c in (w, row, vec_id, score)), worst


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors padded with zeros to one width."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    if len(flat) == width * len(column) and (np.diff(ends, prepend=0) == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    lengths = np.diff(ends, prepend=0)
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(ends - lengths, lengths)] = flat
    return out


class Index:
    """Rows ``(row, vec_id, label, vector)`` dealt to shards by a vantage-point tree."""

    def __init__(self, rows: DataFrame):
        square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        facts = rows.agg(F.count("*").alias("n"), F.max(square).alias("most"), F.max(F.size("vector")).alias("width")).first()
        self.n, self.most, self.width = facts.n, (facts.most or 0.0) * (1 + 1e-12), facts.width or 0
        sample = rows.select(F.xxhash64("row").alias("h"), "vector").orderBy("h").limit(SAMPLE).select("vector").toArrow()  # bounded, and documented
        vectors = _matrix(pa.array(sample.column("vector").to_pylist(), pa.list_(pa.int64())), self.width)
        wanted = min(LEAVES, math.ceil(self.n / SHARD)) or 1
        self.tree = Tree.over(augmented(vectors, self.most), max(8, math.ceil(len(vectors) / wanted))).as_dealer()
        tree, most, width = self.tree, self.most, self.width

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf = tree.place(augmented(_matrix(batch.column("vector"), width), most))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))], [*batch.schema.names, "leaf"])

        dealt = written(rows.select("row", "vec_id", "label", "vector").mapInArrow(placed, _ROW + ", leaf int"), "placed")
        sizes = dealt.groupBy("leaf").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
        self.shards = sizes  # LEAVES rows at most
        salt = F.pmod(F.xxhash64("row"), F.col("shards")).cast("int")
        self.rows = written(dealt.join(F.broadcast(sizes), "leaf").select("row", "vec_id", "label", "vector", "leaf", salt.alias("salt")), "shards")

    def search(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """(anchor, w, row, vec_id, score, rank): the first ``k`` rows in each window of each anchor.

        ``anchors`` has (row, label, vector, windows), windows an array of (low, high) scores, both included;
        ``w`` counts it from 0.  ``same`` asks for rows of the anchor's label, else for all others; never for itself.
        """
        tree, most, width = self.tree, self.most, self.width

        def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                of, low, high = _windows(batch.column("windows"))
                x = _matrix(batch.column("vector"), width).astype(float)
                nearest, farthest = tree.reach(np.concatenate([x, np.zeros((len(x), 1))], 1))
                near, far = radii((x * x).sum(1)[of], most, low.astype(float), high.astype(float))
                each = (nearest[of] <= far[:, None]) & (farthest[of] >= near[:, None]) & (low <= high)[:, None]
                meets = np.zeros((len(x), each.shape[1]), bool)
                np.logical_or.at(meets, of, each)
                leaves = pa.array([np.flatnonzero(m).astype(np.int32) for m in meets], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, leaves], [*batch.schema.names, "leaves"])

        asked = anchors.select("row", "label", "vector", "windows")
        schema = "row long, label long, vector array<long>, windows array<struct<low: long, high: long>>"
        asked = asked.mapInArrow(met, schema + ", leaves array<int>").withColumn("leaf", F.explode("leaves")).join(F.broadcast(self.shards), "leaf")
        asked = asked.select("row", "label", "vector", "windows", "leaf", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("salt"))
        none = F.lit(None).cast("array<struct<low: long, high: long>>")
        both = self.rows.select("leaf", "salt", F.lit(0).alias("kind"), "row", "vec_id", "label", "vector", none.alias("windows"))
        both = both.unionByName(asked.select("leaf", "salt", F.lit(1).alias("kind"), "row", F.lit(0).cast("long").alias("vec_id"), "label", "vector", "windows"))

        def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here, own, shard = None, [], None
            for batch in batches:
                key = batch.column("leaf").to_numpy().astype(np.int64) << 32 | batch.column("salt").to_numpy()
                kind = batch.column("kind").to_numpy()
                cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (kind[1:] != kind[:-1])) + 1), len(key)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if a == b:
                        continue
                    if key[a] != here:
                        here, own, shard = key[a], [], None
                    if kind[a] == 0:
                        own.append(_rows(batch.slice(a, b - a), width))
                        continue
                    if shard is None:
                        shard = Shard(*(np.concatenate(c) for c in zip(*own, strict=True)), most) if own else None
                    if shard is None:
                        continue
                    for at in range(a, b, ANCHORS):
                        part = batch.slice(at, min(ANCHORS, b - at))
                        row, _, label, vectors = _rows(part, width)
                        of, low, high = _windows(part.column("windows"))
                        w, rows, ids, scores = shard.search(row, label, vectors, of, low, high, same, k)
                        number = np.arange(len(of)) - np.searchsorted(of, of)
                        yield pa.RecordBatch.from_arrays([pa.array(row[of[w]]), pa.array(number[w].astype(np.int32)), pa.array(rows), pa.array(ids), pa.array(scores)], ["anchor", "w", "row", "vec_id", "score"])

        found = both.repartition("leaf", "salt").sortWithinPartitions("leaf", "salt", "kind").mapInArrow(searched, _FOUND)
        rank = F.row_number().over(W.partitionBy("anchor", "w").orderBy(F.desc("score"), "vec_id", "row"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _rows(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    return *(batch.column(c).to_numpy().astype(np.int64) for c in ("row", "vec_id", "label")), _matrix(batch.column("vector"), width)


def _windows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's place in the batch, low, high) of each window."""
    of = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
    flat = column.flatten()
    return of, *(flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))


# ---- hard negatives ----------------------------------------------------------------------


def vectors_of(embeddings: DataFrame) -> DataFrame:
    """(row, vec_id, label, vector): rows that take part, numbered, with integer components."""
    fine = F.coalesce(F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))), F.lit(False))
    whole = F.transform("embedding", lambda e: F.floor(e.cast("double") * 256).cast("long"))
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(label + 1, F.lit(10))).otherwise(label)
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine)
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), whole.alias("vector"))


def score_window(positive: Column) -> Column:
    """Scores s with 30 p <= 100 s <= 90 p; empty where p is below 0."""
    exact = positive.cast("decimal(20,0)")
    low, high = F.ceil(exact * 30 / 100).cast("long"), F.floor(exact * 90 / 100).cast("long")
    return F.struct(F.when(positive >= 0, low).otherwise(F.lit(1)).alias("low"), F.when(positive >= 0, high).otherwise(F.lit(0)).alias("high"))


def hard_negatives(embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); see the module's docstring.

    Anchors are the rows whose vec_id ``every`` divides.
    """
    rows = written(vectors_of(embeddings), "vectors")
    index = Index(rows)
    anchors = rows.where(F.col("vec_id") % every == 0)
    all_scores = F.array(F.struct(F.lit(-(1 << 62)).alias("low"), F.lit(1 << 62).alias("high")))
    near = index.search(anchors.withColumn("windows", all_scores), True, positives)
    near = written(near.select("anchor", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    window = near.select("anchor", F.struct("rank", score_window(F.col("positive_score")).alias("window")).alias("w")).groupBy("anchor").agg(F.array_sort(F.collect_list("w")).alias("w"))  # ``positives`` at most
    asked = anchors.join(window.withColumnRenamed("anchor", "row"), "row").withColumn("windows", F.transform("w", lambda w: w["window"]))
    far = index.search(asked, False, negatives).select("anchor", (F.col("w") + 1).alias("of"), F.col("rank").alias("place"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    joined = far.join(near.withColumnRenamed("rank", "of"), ["anchor", "of"]).join(ids, "anchor")
    return joined.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
