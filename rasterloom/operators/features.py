"""Corners, descriptors, hashes, lines and templates."""

from __future__ import annotations

import dataclasses
import itertools
import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr as E
from . import stats as A
from . import stencil as T
from .regions import higher, unbeaten

#: fixed values: the circle of radius 3, clockwise from north
CIRCLE = [(0, -3), (1, -3), (2, -2), (3, -1), (3, 0), (3, 1), (2, 2), (1, 3), (0, 3), (-1, 3), (-2, 2), (-3, 1), (-3, 0), (-3, -1), (-2, -2), (-1, -3)]


def _arc(taps: list[Column], length: int) -> Column:
    """The largest over all arcs of ``length`` taps of the arc's least value."""
    ring = taps + taps[: length - 1]
    return F.greatest(*[F.least(*ring[i : i + length]) for i in range(16)])


def corners_fast(r: DataFrame, threshold: int, length: int = 9) -> DataFrame:
    """(img, x, y, score) of FAST corners: an arc of ``length`` taps (9 or 12) beyond the centre by more than the threshold.

    The score is the largest threshold that leaves the place a corner.  The 12-tap form
    also asks for both the north and the south tap and one of east and west.
    """
    if length not in (9, 12):
        raise ValueError("arcs of 9 or 12")
    near = T.neighbours(r, CIRCLE, border="null")
    v = F.col("v")
    brighter = [F.col(f"n{i}") - v for i in range(16)]
    darker = [v - F.col(f"n{i}") for i in range(16)]
    best = []
    for taps in (brighter, darker):
        own = _arc(taps, length)
        if length == 12:
            own = F.least(own, taps[0], taps[8], F.greatest(taps[4], taps[12]))
        best.append(own)
    score = F.greatest(*best) - 1  # the difference must exceed the threshold
    inner = (F.col("x") >= 3) & (F.col("y") >= 3) & (F.col("x") < F.col("w") - 3) & (F.col("y") < F.col("h") - 3)
    return near.where(inner).select("img", "x", "y", score.alias("score")).where(F.col("score") >= threshold)


def top_corners(corners: DataFrame, n: int) -> DataFrame:
    """The ``n`` best corners of each raster (ties: raster order)."""
    rank = F.row_number().over(W.partitionBy("img").orderBy(F.desc("score"), "y", "x"))
    return corners.withColumn("k", rank).where(F.col("k") <= n).drop("k")


def orientations(r: DataFrame, corners: DataFrame, radius: int = 15) -> DataFrame:
    """``corners`` with the angle of the intensity centroid of the patch around each.

    Weights count from -radius at the patch's (clipped) first row and column.  The patches' sums of values, and of values
    times x and y, come from windows over all places; only the corners' own places are joined.
    """
    v, reach = F.col("v").cast("double"), (-radius, radius)
    rows = T.tiled(r, radius, radius, radius, radius)
    for name, value in (("s", v), ("sx", v * F.col("x")), ("sy", v * F.col("y"))):
        rows = rows.withColumn(name, F.sum(value).over(T.TILE_ROW().rowsBetween(*reach)))
    for name in ("s", "sx", "sy"):
        rows = rows.withColumn(name, F.sum(name).over(T.TILE_COL().rowsBetween(*reach)))
    first = lambda at: F.greatest(F.col(at) - radius, F.lit(0)) + radius
    mx, my = F.col("sx") - first("x") * F.col("s"), F.col("sy") - first("y") * F.col("s")
    turned = T.untiled(rows).select("img", "x", "y", (-F.atan2(my, mx)).alias("orientation"))
    return corners.join(turned, ["img", "x", "y"])


def oriented_fast(r: DataFrame, threshold: int, n: int, edge: int) -> DataFrame:
    """The best FAST-9 corners at least ``edge`` from the border, with orientations."""
    sizes = r.select("img", "w", "h").distinct()
    found = corners_fast(r, threshold, 9).join(sizes, "img").where((F.col("x") >= edge) & (F.col("y") >= edge) & (F.col("x") < F.col("w") - edge) & (F.col("y") < F.col("h") - edge)).drop("w", "h")
    return orientations(r, top_corners(found, n))


# ---- binary descriptors ----------------------------------------------------------------------


def brief_pairs(length: int, seed: int, radius: int = 15) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Random pairs of offsets in the patch."""
    if length % 128:
        raise ValueError("a descriptor has a multiple of 128 bits")
    rng = random.Random(seed)
    point = lambda: (rng.randint(-radius, radius), rng.randint(-radius, radius))
    return [(point(), point()) for _ in range(length)]


def brief(r: DataFrame, keypoints: DataFrame, pairs: list[tuple[tuple[int, int], tuple[int, int]]], box: int = 2) -> DataFrame:
    """(img, x, y, bits): for each pair, whether the first box mean is less than the second.

    Bits fill 64-bit words, two for 128; of each 128 the first test is not kept and the
    last bit is 0.  Tiles hold all places that their keypoints ask, so means and tests are lookups in a tile, after one shuffle.
    """
    if len(pairs) % 128:
        raise ValueError("a descriptor has a multiple of 128 bits")
    offsets = [o for pair in pairs for o in pair]
    tile = lambda at: F.floor(F.col(at) / T.TILE).cast("int")
    asked = keypoints.select(F.col("img").cast("long").alias("img"), tile("x").alias("tx"), tile("y").alias("ty"), F.lit(None).cast(r.schema["v"].dataType).alias("v"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    rows = T.placed(r, *(k + box for k in T.reach_of(offsets))).select(F.col("img").cast("long").alias("img"), "tx", "ty", "v", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).unionByName(asked)
    key = ["img", "tx", "ty"]
    rows = rows.repartition(*key).sortWithinPartitions(*key, "y", "x")
    dx, dy = (np.array([o[i] for o in offsets]) for i in (0, 1))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in T.whole_groups(batches, key):
            group = T.group_numbers(table, key)
            img, x, y = (table.column(n).to_numpy() for n in ("img", "x", "y"))
            ask = table.column("v").is_null().to_numpy()
            tiles = T.Places(group, x, y)
            own = (group[~ask], x[~ask], y[~ask])
            at, places = tiles.at(*own), (tiles.total,)
            total, area = np.zeros(places), np.zeros(places)
            total[at], area[at] = table.column("v").drop_null().to_numpy(), 1
            for ox, oy in ((1, 0), (0, 1)):  # rows, then columns
                near = [tiles.at(own[0], own[1] + k * ox, own[2] + k * oy) for k in range(-box, box + 1)]
                summed = [np.zeros(places), np.zeros(places)]
                for k in near:
                    for out, value in zip(summed, (total, area), strict=True):
                        out[at] += np.where(k < 0, 0, value[k])
                total, area = summed
            values = np.full(places, np.iinfo(np.int64).min)
            values[at] = np.floor(total[at] / area[at]).astype(np.int64)  # those that a keypoint can ask have their whole box here
            chosen = np.flatnonzero(ask)
            same = (group[chosen[1:]] == group[chosen[:-1]]) & (x[chosen[1:]] == x[chosen[:-1]]) & (y[chosen[1:]] == y[chosen[:-1]])
            chosen = chosen[np.r_[True, ~same]] if len(chosen) else chosen
            for some in np.array_split(chosen, len(chosen) // 4096 + 1):
                asks = tiles.at(group[some][:, None], x[some][:, None] + dx, y[some][:, None] + dy)
                m = np.where(asks < 0, np.iinfo(np.int64).min, values[asks])
                ok = (m > np.iinfo(np.int64).min).all(1)
                less = (m[ok, 0::2] < m[ok, 1::2]).reshape(-1, len(pairs) // 128, 128)
                less = np.concatenate([less[:, :, 1:], np.zeros_like(less[:, :, :1])], 2)  # most significant first
                words = np.packbits(less.reshape(len(less), -1), axis=1).view(">i8").astype(np.int64)
                bits = pa.ListArray.from_arrays(np.arange(len(words) + 1, dtype=np.int32) * (len(pairs) // 64), words.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(img[some][ok]), pa.array(x[some][ok]), pa.array(y[some][ok]), bits], ["img", "x", "y", "bits"])

    return rows.mapInArrow(described, "img bigint, x int, y int, bits array<bigint>")


#: bits of the substrings that descriptors are indexed by
PIECE = 16


def _flips(n: int) -> list[int]:
    """The words of ``PIECE`` bits of which ``n`` are set."""
    return [sum(1 << b for b in chosen) for chosen in itertools.combinations(range(PIECE), n)]


def match_descriptors(a: DataFrame, b: DataFrame, threshold: int, apart: bool = False) -> DataFrame:
    """(id_a, id_b, distance): the nearest descriptor below ``threshold`` bits (ties: least id), exactly.

    ``a`` and ``b`` have (id, bits) and are read twice, so they should be written tables; the smaller side asks, and
    ``apart`` keeps an id from matching itself.

    Equal descriptors are one row, with their two least ids.  Tasks hold a part of those that ask and stream a block of the
    others past them (:func:`_compared`), so no pair becomes a row.
    """
    a, b = a.select("id", "bits"), b.select("id", "bits")
    na, nb = a.count(), b.count()
    swap = na > nb
    ask, base = (b, a) if swap else (a, b)
    if not min(na, nb):
        return ask.sparkSession.createDataFrame([], "id_a long, id_b long, distance int")
    least = base.withColumn("k", F.row_number().over(W.partitionBy("bits").orderBy("id"))).where("k <= 2")
    distinct = least.groupBy("bits").agg(F.min("id").alias("d"), F.max("id").alias("d2"))
    met = _compared(ask.select(F.col("id").alias("q"), F.col("bits").alias("qb")), min(na, nb), distinct, threshold, apart)
    best = met.groupBy("q").agg(F.min(F.struct("distance", "d")).alias("b")).select("q", "b.distance", "b.d")
    first, second = (F.col("d"), F.col("q")) if swap else (F.col("q"), F.col("d"))
    return best.select(first.alias("id_a"), second.alias("id_b"), "distance")


#: rounds of descriptors' substrings before the rest are compared
ROUNDS = 1
#: most descriptors that a task holds to ask, and those of its block that it compares them with at a time
ASKED, HELD = 1 << 19, 1 << 19
#: parts of those that ask, at least, and blocks of the others
PARTS, BLOCKS = 1, 12
#: numbers of set bits of the first word that descriptors are sorted by together
STRIP = 8
#: descriptors compared at once, so that they stay in a core's cache
CACHED = 1 << 15


def _compared(asking: DataFrame, asked: int, distinct: DataFrame, threshold: int, apart: bool) -> DataFrame:
    """(q, distance, d): the nearest below ``threshold`` in each block of ``distinct(bits, d, d2)`` to each of ``asking(q, qb)``.

    A task compares a part of ``asking`` with a block: work is the product of the two tables, spread over the tasks.  What is
    shuffled is ``distinct`` for each part (``PARTS``, or as many as hold ``ASKED`` each) and ``BLOCKS`` times those that ask;
    memory is ``ASKED`` and ``HELD`` descriptors.
    """
    parts = max(PARTS, -(-asked // ASKED))
    dealt = lambda by, n: F.pmod(F.xxhash64(by), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = distinct.select(dealt("d", BLOCKS).alias("block"), copies(parts).alias("part"), F.lit(1).alias("held"), F.col("d").alias("id"), F.col("d2").alias("second"), "bits")
    rows = rows.unionByName(asking.select(copies(BLOCKS).alias("block"), dealt("q", parts).alias("part"), F.lit(0).alias("held"), F.col("q").alias("id"), F.col("q").alias("second"), F.col("qb").alias("bits")))
    key = ["block", "part", "held"]
    rows = rows.repartitionById(parts * BLOCKS, F.col("block") * parts + F.col("part")).sortWithinPartitions(*key)
    flips = [_flips(t) for t in range(ROUNDS)]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ask = None, None
        waiting: list[tuple] = []

        def drained(least: int) -> None:
            """The waiting rows become those that ask, or meet them if they are ``least`` or more."""
            nonlocal ask, waiting
            if not waiting or sum(len(ids) for ids, *_ in waiting) < least:
                return
            ids, second, words = (np.concatenate(k) for k in zip(*waiting, strict=True))
            waiting = []
            if group[2] == 0:
                ask = Asked(ids, words, threshold, apart, flips)
            elif ask is not None:
                ask.meet(ids, second, words)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(n).to_numpy() for n in key], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
            ids, second = (batch.column(n).to_numpy() for n in ("id", "second"))
            words = batch.column("bits").flatten().to_numpy().reshape(len(ids), -1).view(np.uint64)
            for lo, hi in itertools.pairwise(cuts):
                if group != (now := tuple(keys[lo].tolist())):
                    drained(1)
                    if ask is not None and now[:2] != group[:2]:
                        yield ask.found()
                        ask = None
                    group = now
                waiting.append((ids[lo:hi], second[lo:hi], words[lo:hi]))
                if group[2]:
                    drained(HELD)
        drained(1)
        if ask is not None:
            yield ask.found()

    return rows.mapInArrow(compared, "q bigint, distance int, d bigint")


class Asked:
    """Descriptors that ask, each with its nearest so far: the least distance below a threshold, then the least id."""

    def __init__(self, ids: np.ndarray, words: np.ndarray, threshold: int, apart: bool, flips: list[list[int]]) -> None:
        self.ids, self.words, self.apart, self.flips = ids.tolist(), words, apart, flips
        self.best, self.owner = [threshold - 1] * len(ids), [None] * len(ids)

    def found(self) -> pa.RecordBatch:
        some = [i for i, name in enumerate(self.owner) if name is not None]
        columns = [[k[i] for i in some] for k in (self.ids, self.best, self.owner)]
        return pa.RecordBatch.from_arrays([pa.array(k, t) for k, t in zip(columns, (pa.int64(), pa.int32(), pa.int64()), strict=True)], ["q", "distance", "d"])

    def meet(self, ids: np.ndarray, second: np.ndarray, words: np.ndarray) -> None:
        """Compares with held descriptors, no two of them equal, whose two least ids are ``ids`` and ``second``.

        Multi-index hashing first: of m substrings, some one differs in at most d / m bits where the whole differs in d.
        Round t meets those of which a substring differs from the asked one in t bits, so after it all that are
        nearer than m (t + 1) bits have been met; whoever has one is answered.  The others go on to those whose numbers of
        set bits, in the first word and in the rest, differ from theirs by no more than their best distance, as it is less in no other.
        """
        count = self.words.shape[1] * 64 // PIECE
        for t in range(count):
            word, shift = t * PIECE // 64, np.uint64(t * PIECE % 64)
            piece = lambda w: ((w[:, word] >> shift) & np.uint64((1 << PIECE) - 1)).astype(np.uint16)  # noqa: B023, E731
            keys = piece(words)
            order = np.argsort(keys, kind="stable")
            starts = np.r_[0, np.cumsum(np.bincount(keys, minlength=1 << PIECE))].tolist()
            held = [np.ascontiguousarray(k[order]) for k in (ids, second, *words.T)]
            for i, own in enumerate(piece(self.words).tolist()):
                for flip in itertools.chain(*self.flips):
                    if starts[own ^ flip] < starts[(own ^ flip) + 1]:
                        self._compare(i, held, starts[own ^ flip], starts[(own ^ flip) + 1])
        left = [i for i, (far, name) in enumerate(zip(self.best, self.owner, strict=True)) if name is None or far >= count * len(self.flips)]
        if not left:
            return
        wide = 64 * (words.shape[1] - 1) + 1
        ones = lambda w: (np.bitwise_count(w[:, 0]).astype(np.int64), np.bitwise_count(w[:, 1:]).sum(1, dtype=np.int64))
        first, rest = ones(words)
        cell = first // STRIP * wide + rest
        order = np.argsort(cell, kind="stable")
        starts = np.r_[0, np.cumsum(np.bincount(cell, minlength=(64 // STRIP + 1) * wide))].tolist()
        held = [np.ascontiguousarray(k[order]) for k in (ids, second, *words.T)]
        first, rest = (k.tolist() for k in ones(self.words))
        for i in left:
            for step in range(64 // STRIP + 1):
                strips = [k for k in {first[i] // STRIP - step, first[i] // STRIP + step} if 0 <= k <= 64 // STRIP]
                gaps = [max(0, k * STRIP - first[i], first[i] - k * STRIP - STRIP + 1) for k in strips]
                if not strips or min(gaps) > self.best[i]:
                    break  # the next are farther
                for k, gap in zip(strips, gaps, strict=True):
                    room = self.best[i] - gap
                    if room >= 0:
                        lo, hi = starts[k * wide + max(0, rest[i] - room)], starts[k * wide + min(wide - 1, rest[i] + room) + 1]
                        if lo < hi:
                            self._compare(i, held, lo, hi)

    def _compare(self, i: int, held: list[np.ndarray], start: int, end: int) -> None:
        ids, second, *words = held
        own = self.words[i]
        for lo in range(start, end, CACHED):
            hi = min(end, lo + CACHED)
            far = np.bitwise_count(words[0][lo:hi] ^ own[0])
            if len(words) > 3:
                far = far.astype(np.int32)
            for word, mine in zip(words[1:], own[1:], strict=True):
                far += np.bitwise_count(word[lo:hi] ^ mine)
            least = int(far.min())
            if least > self.best[i]:
                continue
            if self.apart and least == 0 and int(ids[at := lo + int(far.argmin())]) == self.ids[i]:  # equal descriptors are one row
                if second[at] != ids[at]:
                    self.best[i], self.owner[i] = 0, int(second[at])
                    return
                if hi - lo == 1:
                    continue
                far[at - lo] = 255 if len(words) < 4 else 1 << 30
                if (least := int(far.min())) > self.best[i]:
                    continue
            name = int(ids[lo:hi][far == least].min())
            if least < self.best[i] or self.owner[i] is None or name < self.owner[i]:
                self.best[i], self.owner[i] = least, name


# ---- Haar features ---------------------------------------------------------------------------

#: fixed values: columns and rows of blocks of each shape, and the blocks' signs
HAAR = {"two_horizontal": (2, 1, [1, -1]), "three_horizontal": (3, 1, [1, -1, 1]), "two_vertical": (1, 2, [1, -1]), "three_vertical": (1, 3, [1, -1, 1]), "four": (2, 2, [1, -1, -1, 1])}


def haar_features(spark, width: int, height: int) -> DataFrame:
    """(kind, sign, block_w, block_h, left, top) of all features that fit a frame."""
    out = None
    for kind, (nx, ny, _) in HAAR.items():
        if width // nx < 1 or height // ny < 1:
            continue
        rows = spark.range(1).select(F.lit(kind).alias("kind"), F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign"))
        rows = rows.withColumn("block_w", F.explode(F.sequence(F.lit(1), F.lit(width // nx)))).withColumn("block_h", F.explode(F.sequence(F.lit(1), F.lit(height // ny))))
        rows = rows.withColumn("left", F.explode(F.sequence(F.lit(0), width - F.col("block_w") * nx))).withColumn("top", F.explode(F.sequence(F.lit(0), height - F.col("block_h") * ny)))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "kind string, sign int, block_w int, block_h int, left int, top int")


def haar_counts(width: Column, height: Column) -> Column:
    """How many features fit a frame, in closed form.

    Blocks that number n along a side of s places are of 1 to s div n places, and one of k places has s - n k + 1 of them to begin at.
    """
    def along(side: Column, n: int) -> Column:
        m = F.floor(side / n)
        return m * (side + 1) - n * m * (m + 1) / 2

    return sum((2 * along(width, nx) * along(height, ny) for nx, ny, _ in HAAR.values()), F.lit(0)).cast("long")


def haar_values(r: DataFrame, features: DataFrame) -> DataFrame:
    """(img, feature columns, value): signed block sums through the integral image.

    A raster's sums in the features' frame are one row, and each feature looks its corners up there.
    """
    shape = F.create_map(*[x for k, (nx, _, _) in HAAR.items() for x in (F.lit(k), F.lit(nx))])
    signs = F.create_map(*[x for k, (_, _, s) in HAAR.items() for x in (F.lit(k), F.array(*map(F.lit, s)))])
    names = ["kind", "sign", "block_w", "block_h", "left", "top"]
    blocks = features.select(*names, F.posexplode(F.element_at(signs, F.col("kind"))).alias("i", "s")).withColumn("nx", F.element_at(shape, F.col("kind")))
    bx, by = F.col("i") % F.col("nx"), F.floor(F.col("i") / F.col("nx")).cast("int")
    l, t = F.col("left") + bx * F.col("block_w"), F.col("top") + by * F.col("block_h")
    corners = F.explode(F.array(*[F.struct(x.alias("x"), y.alias("y"), F.lit(z).alias("z")) for x, y, z in ((l + F.col("block_w"), t + F.col("block_h"), 1), (l + F.col("block_w"), t, -1), (l, t + F.col("block_h"), -1), (l, t, 1))]))
    asked = blocks.select(*names, "s", corners.alias("k")).select(*names, (F.col("s") * F.col("k.z") * F.col("sign")).alias("weight"), F.col("k.x").alias("x"), F.col("k.y").alias("y"))
    frame = asked.agg(F.max("x").alias("x"), F.max("y").alias("y")).first()
    if frame.x is None:
        return r.sparkSession.createDataFrame([], "img long, kind string, sign int, block_w int, block_h int, left int, top int, value long")
    place = lambda x, y: F.col(y) * (frame.x + 1) + F.col(x)
    at = asked.groupBy(*names, "x", "y").agg(F.sum("weight").alias("weight")).groupBy(*names).agg(F.collect_list(F.struct((place("x", "y") + 1).cast("int").alias("at"), F.col("weight").cast("long").alias("weight"))).alias("corners"))
    sums = A.integral_image(r).where((F.col("x") <= frame.x) & (F.col("y") <= frame.y))
    held = sums.groupBy("img").agg(F.transform(F.array_sort(F.collect_list(F.struct(place("x", "y").alias("k"), "v"))), lambda p: p["v"]).alias("sums"))
    held = held.where(F.size("sums") == (frame.x + 1) * (frame.y + 1))  # the features lie inside
    value = F.aggregate("corners", F.lit(0).cast("long"), lambda total, k: total + k["weight"] * F.element_at(F.col("sums"), k["at"]))
    return held.crossJoin(F.broadcast(at)).select("img", *names, value.alias("value"))


# ---- gradients, lines, templates, hashes --------------------------------------------------------


def cell_histograms(r: DataFrame, orientations_: int, signed: bool, cell: int) -> DataFrame:
    """(img, cx, cy, bin, v): trilinear votes of Sobel magnitudes over the cell's area; range 2 pi if ``signed``."""
    g = T.gradients(r, T.SOBEL_H, T.SOBEL_V)
    size = F.sqrt((F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).cast("double"))
    full = 2 * math.pi if signed else math.pi
    angle = F.atan2(F.col("gy").cast("double"), F.col("gx").cast("double"))
    angle = F.when(angle < 0, angle + 2 * math.pi).otherwise(angle)
    angle = angle if signed else F.when(angle >= math.pi, angle - math.pi).otherwise(angle)
    o = angle / (full / orientations_) - 0.5
    o = F.when(o < 0, o + orientations_).otherwise(o)
    cx, cy = (F.col("x") + 0.5) / cell - 0.5, (F.col("y") + 0.5) / cell - 0.5
    rows = g.select("img", "w", "h", size.alias("m"), o.alias("o"), cx.alias("px"), cy.alias("py"))
    part = lambda v, k: (F.floor(v) + k, (v - F.floor(v)) if k else 1 - (v - F.floor(v)))
    votes = []
    for i in (0, 1):
        for j in (0, 1):
            for k in (0, 1):
                (a, wa), (b, wb), (d, wd) = part(F.col("px"), i), part(F.col("py"), j), part(F.col("o"), k)
                votes.append(F.struct(a.cast("int").alias("cx"), b.cast("int").alias("cy"), F.pmod(d, F.lit(orientations_)).cast("int").alias("bin"), (wa * wb * wd * F.col("m") / (cell * cell)).alias("v")))
    spread = rows.select("img", "w", "h", F.explode(F.array(*votes)).alias("t")).select("img", "w", "h", "t.*")
    inside = (F.col("cx") >= 0) & (F.col("cy") >= 0) & (F.col("cx") < F.floor(F.col("w") / cell)) & (F.col("cy") < F.floor(F.col("h") / cell))
    return spread.where(inside).groupBy("img", "cx", "cy", "bin").agg(F.sum("v").alias("v"))


@dataclasses.dataclass(frozen=True)
class HogSpec:
    """The grid that HoG options give a raster size."""

    orientations: int
    block: int
    blocks_wide: int
    blocks_high: int

    @staticmethod
    def of(width: int, height: int, orientations_: int, cell: int, block: int, stride: int) -> HogSpec:
        """Cells must tile the raster, and blocks at the stride the cells."""
        if width % cell or height % cell:
            raise ValueError(f"cells of {cell} don't tile a raster of {width}x{height}")
        wide, high = width // cell - block, height // cell - block
        if min(wide, high) < 0 or wide % stride or high % stride:
            raise ValueError(f"blocks of {block} cells at stride {stride} don't cover {width // cell}x{height // cell} cells")
        return HogSpec(orientations_, block, wide // stride + 1, high // stride + 1)

    def descriptor_length(self) -> int:
        """Values of one raster's descriptor; :func:`hog` leaves out the bins without votes."""
        return self.blocks_wide * self.blocks_high * self.block * self.block * self.orientations


def hog(r: DataFrame, orientations_: int, signed: bool, cell: int, block: int, stride: int) -> DataFrame:
    """(img, bx, by, cx, cy, bin, v): blocks of cell histograms, each of L2 norm 1 (or 0).

    A raster that the options don't fit is an error, by the rule of :class:`HogSpec`.
    """
    cells = cell_histograms(r, orientations_, signed, cell)
    nw, nh = F.floor(F.max("w") / cell).cast("int"), F.floor(F.max("h") / cell).cast("int")
    untiled = (F.max("w") % cell != 0) | (F.max("h") % cell != 0)
    uncovered = (nw < block) | (nh < block) | ((nw - block) % stride != 0) | ((nh - block) % stride != 0)
    checked = F.when(untiled | uncovered, F.raise_error(F.concat(F.lit(f"cells of {cell}, or blocks of {block} at stride {stride}, don't cover a raster of "), F.max("w"), F.lit("x"), F.max("h")))).otherwise(nw)
    side = r.groupBy("img").agg(checked.cast("int").alias("nw"), nh.alias("nh"))
    offsets = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(block) for j in range(block)]))
    rows = cells.join(side, "img").withColumn("o", offsets)
    left, top = F.col("cx") - F.col("o.i"), F.col("cy") - F.col("o.j")
    ok = (left >= 0) & (top >= 0) & (left + block <= F.col("nw")) & (top + block <= F.col("nh")) & (left % stride == 0) & (top % stride == 0)
    placed = rows.where(ok).select("img", (left / stride).cast("int").alias("bx"), (top / stride).cast("int").alias("by"), F.col("o.i").alias("cx"), F.col("o.j").alias("cy"), "bin", "v")
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy("img", "bx", "by")))
    return placed.withColumn("norm", norm).select("img", "bx", "by", "cx", "cy", "bin", F.when(F.col("norm") > 0, F.col("v") / F.col("norm")).otherwise(0.0).alias("v"))


def detect_lines(r: DataFrame, vote_threshold: int, radius: int) -> DataFrame:
    """(img, r, angle, votes): Hough lines of the non-zero places; 180 angles of a degree, r truncated toward zero."""
    place = r.where(F.col("v") != 0).select("img", "w", "h", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(179))).alias("angle"))
    rho = E.trunc(F.col("x") * F.cos(F.radians("angle")) + F.col("y") * F.sin(F.radians("angle"))).cast("int")
    votes = place.groupBy("img", rho.alias("r"), "angle").agg(F.count("*").cast("int").alias("votes"))
    lines = votes.where(F.col("votes") >= vote_threshold).select("img", F.col("r").alias("x"), F.col("angle").alias("y"), F.col("votes").alias("score"))
    rivals = lines.select("img", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("score").alias("s2"))
    kept = unbeaten(lines, rivals, radius, higher("x", "y"))  # the vote table is a raster with r across and the angle down
    return kept.select("img", F.col("x").alias("r"), F.col("y").alias("angle"), F.col("score").alias("votes"))


#: places of the side of the blocks that rasters and templates are cut into for correlations
BLOCK = 64
#: bytes of a template's blocks that are sent to all tasks; larger ones are shuffled to the rasters' blocks
SENT = 8 << 20


def _blocks(r: DataFrame, keys: list[str]) -> DataFrame:
    """``r(x, y, v)`` as blocks: bx, by, and the values v at k = 64 y + x within the block."""
    inside = (F.col("y") % BLOCK) * BLOCK + F.col("x") % BLOCK
    cut = r.select(*keys, F.floor(F.col("x") / BLOCK).cast("int").alias("bx"), F.floor(F.col("y") / BLOCK).cast("int").alias("by"), F.struct(inside.cast("int").alias("k"), F.col("v").cast("double").alias("v")).alias("p"))
    return cut.groupBy(*keys, "bx", "by").agg(F.collect_list("p").alias("p")).select(*keys, "bx", "by", F.transform("p", lambda p: p["k"]).alias("k"), F.transform("p", lambda p: p["v"]).alias("v"))


def _dense(k: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = np.zeros((int(k.max()) // BLOCK + 1, int((k % BLOCK).max()) + 1))
    out[k // BLOCK, k % BLOCK] = v
    return out


def block_correlation(image: np.ndarray, template: np.ndarray) -> np.ndarray:
    """The sum of image[y + t, x + s] template[t, s] for all (y, x) from (1 - template rows, 1 - template columns) on.

    Each image row's windows meet all template rows in one matrix product.
    """
    rows, columns = template.shape
    padded = np.pad(image, ((rows - 1, rows - 1), (columns - 1, columns - 1)))
    lines = np.lib.stride_tricks.sliding_window_view(padded, columns, 1) @ template.T  # (row, x, template row)
    height = image.shape[0] + rows - 1
    return sum(lines[t : t + height, :, t] for t in range(rows))


def correlation(r: DataFrame, template: DataFrame, width: int, height: int) -> DataFrame:
    """(img, ox, oy, s): the sum of raster times template at each offset where the template lies inside.

    Rasters and the template are cut into blocks; each pair of blocks is one task's matrix product, and the sums
    of the pairs meet by offset.  The template stays a table, sent to all tasks only where it is small.
    """
    across, down = -(-width // BLOCK), -(-height // BLOCK)
    parts = _blocks(template, []).select((F.col("by") * across + F.col("bx")).alias("part"), F.col("k").alias("tk"), F.col("v").alias("tv"))
    if 12 * width * height <= SENT:
        parts = F.broadcast(parts)
    image = _blocks(r, ["img", "w", "h"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(across * down - 1))))

    def correlated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            img, w, h, bx, by, part = (batch.column(n).to_numpy() for n in ("img", "w", "h", "bx", "by", "part"))
            k, v, tk, tv = (batch.column(n) for n in ("k", "v", "tk", "tv"))
            for i in range(batch.num_rows):
                t = _dense(tk[i].values.to_numpy(), tv[i].values.to_numpy())
                left, top = bx[i] * BLOCK - (part[i] % across) * BLOCK - t.shape[1] + 1, by[i] * BLOCK - (part[i] // across) * BLOCK - t.shape[0] + 1
                sums = block_correlation(_dense(k[i].values.to_numpy(), v[i].values.to_numpy()), t)
                y0, y1, x0, x1 = max(0, -top), min(sums.shape[0], h[i] - height + 1 - top), max(0, -left), min(sums.shape[1], w[i] - width + 1 - left)
                if y0 >= y1 or x0 >= x1:
                    continue
                oy, ox = np.mgrid[top + y0 : top + y1, left + x0 : left + x1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(ox.size, img[i])), pa.array(ox.ravel().astype(np.int32)), pa.array(oy.ravel().astype(np.int32)), pa.array(sums[y0:y1, x0:x1].ravel())], ["img", "ox", "oy", "s"])

    met = image.join(parts, "part").select("img", "w", "h", "bx", "by", "part", "k", "v", "tk", "tv")
    return met.mapInArrow(correlated, "img bigint, ox int, oy int, s double").groupBy("img", "ox", "oy").agg(F.sum("s").alias("s"))


def match_template(r: DataFrame, template: DataFrame, method: str, mask: DataFrame | None = None, divide: bool = False) -> DataFrame:
    """(img, ox, oy, score) at each offset where the template (x, y, v) lies inside.

    ``method``: sse, sse_normalized, ccorr or ccorr_normalized.  Products come from :func:`correlation`; the squares of
    the raster under the template from its summed squares (four lookups an offset), or, under a mask, from a correlation too.
    Where the norm is 0 a normalized score stays as it is, or, with ``divide``, is what division gives: NaN or infinite.
    """
    if method not in ("sse", "sse_normalized", "ccorr", "ccorr_normalized"):
        raise ValueError(f"no method {method}")
    t = template.select("x", "y", F.col("v").cast("double").alias("v"))
    t = t.join(mask.select("x", "y", F.col("v").cast("double").alias("m")), ["x", "y"]) if mask is not None else t.withColumn("m", F.lit(1.0))
    facts = t.agg(F.max("x").alias("x"), F.max("y").alias("y"), F.sum(F.col("v") * F.col("v") * F.col("m") * F.col("m")).alias("tt")).first()
    width, height, tt = facts.x + 1, facts.y + 1, facts.tt
    square = F.col("m") * F.col("m")
    places = r.select("img", "w", "h", "c", "x", "y", F.col("v").cast("double").alias("v"))
    products = correlation(places, t.select("x", "y", (F.col("v") * square).alias("v")), width, height).withColumnRenamed("s", "it")
    if mask is not None:
        squares = correlation(places.withColumn("v", F.col("v") * F.col("v")), t.select("x", "y", square.alias("v")), width, height).withColumnRenamed("s", "ii")
    elif method != "ccorr":
        sums = A.integral_image(r, True, None if r.schema["v"].dataType.typeName() in ("integer", "long") else "double").select("img", "w", "h", "x", "y", F.col("v").cast("double").alias("v"))
        corners = F.explode(F.array(*[F.struct(F.lit(dx).alias("x"), F.lit(dy).alias("y"), F.lit(sign).alias("s")) for dx, dy, sign in ((0, 0, 1), (width, 0, -1), (0, height, -1), (width, height, 1))]))
        asked = sums.withColumn("k", corners).select("img", "w", "h", (F.col("x") - F.col("k.x")).alias("ox"), (F.col("y") - F.col("k.y")).alias("oy"), (F.col("v") * F.col("k.s")).alias("s"))
        squares = asked.where((F.col("ox") >= 0) & (F.col("oy") >= 0) & (F.col("ox") <= F.col("w") - 1 - width) & (F.col("oy") <= F.col("h") - 1 - height)).groupBy("img", "ox", "oy").agg(F.sum("s").alias("ii"))
    both = products.join(squares, ["img", "ox", "oy"]) if method != "ccorr" else products
    score = F.lit(tt) - 2 * F.col("it") + F.col("ii") if method.startswith("sse") else F.col("it")
    if method.endswith("_normalized"):
        norm = F.sqrt(F.lit(tt) * F.col("ii"))
        flat = F.when(score > 0, float("inf")).otherwise(float("nan")) if divide else score
        score = F.when(norm > 0, score / F.when(norm > 0, norm).otherwise(1.0)).otherwise(flat)
    return both.select("img", "ox", "oy", score.alias("score"))


#: fixed value: the lobes of the resampling window on either side
LOBES = 3


def _sinc(x: Column) -> Column:
    return F.when(x == 0, 1.0).otherwise(F.sin(x * math.pi) / F.when(x == 0, 1.0).otherwise(x * math.pi))


def _resampled(r: DataFrame, side: int, axis: str, size: str) -> DataFrame:
    """One axis to ``side`` places: windowed-sinc taps around each new place's centre, normalised to sum 1."""
    ratio = F.col(size) / float(side)
    scale = F.greatest(ratio, F.lit(1.0))
    at = F.col(axis) + 0.5
    first = F.greatest(F.lit(0), F.ceil((at - LOBES * scale) / ratio - 0.5)).cast("int")
    last = F.least(F.lit(side - 1), F.floor((at + LOBES * scale) / ratio - 0.5)).cast("int")
    spread = r.withColumn("o", F.explode(F.sequence(first, last)))  # each place lies in some window
    d = (at - (F.col("o") + 0.5) * ratio) / scale
    weight = F.when(F.abs(d) < LOBES, _sinc(d) * _sinc(d / LOBES)).otherwise(0.0)
    other = [k for k in ("img", "w", "h", "c", "x", "y") if k != axis]
    return spread.groupBy(*other, F.col("o").alias(axis)).agg((F.sum(F.col("v") * weight) / F.sum(weight)).alias("v"))


def lanczos_resize(r: DataFrame, side: int) -> DataFrame:
    """``side`` x ``side`` rasters by separable Lanczos-3 resampling: columns, then rows.

    Values aren't narrowed; they are rounded at six places so that sums in any order agree.
    """
    out = _resampled(_resampled(r, side, "y", "h"), side, "x", "w")
    return out.select("img", F.lit(side).alias("w"), F.lit(side).alias("h"), "c", "x", "y", E.rounded("v", 6).alias("v"))


def _above_mean(r: DataFrame) -> DataFrame:
    rows = r.groupBy("img").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda s: s["v"]).alias("d"))
    mean = E.rounded(F.aggregate("d", F.lit(0.0), lambda a, x: a + x) / F.size("d"), 6)
    return rows.withColumn("mean", mean).select("img", E.pack_bits(F.transform("d", lambda v: v > F.col("mean"))).alias("h"))


def average_hash(r: DataFrame) -> DataFrame:
    """(img, h): 64 bits, raster order from bit 0, set where the 8x8 raster is above its mean."""
    return _above_mean(lanczos_resize(r, 8))


def dct2d(r: DataFrame, side: int) -> DataFrame:
    """Unnormalised DCT-II of square rasters: two passes of a cosine table of side^2 rows."""
    def along(rows: DataFrame, axis: str) -> DataFrame:
        k = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
        spread = rows.withColumn("k", k).withColumn("v", F.col("v") * F.cos(math.pi / side * (F.col(axis) + 0.5) * F.col("k")))
        other = "y" if axis == "x" else "x"
        return spread.groupBy("img", other, F.col("k").alias(axis)).agg(F.sum("v").alias("v"))

    return along(along(r.select("img", "x", "y", "v"), "y"), "x")


def phash(r: DataFrame) -> DataFrame:
    """(img, h): the 8x8 block at (1, 1) of the 32x32 DCT against its mean."""
    freq = dct2d(lanczos_resize(r, 32), 32).where("x between 1 and 8 and y between 1 and 8").withColumn("v", E.rounded("v", 3))
    return _above_mean(freq)
