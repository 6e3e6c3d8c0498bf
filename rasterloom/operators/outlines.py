"""Contours, as cycles of steps over all rasters at once, and seams, which are sequential within a raster."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import stencil as T
from .components import checkpointed, component_labels
from .regions import split_by_tiles

#: directions clockwise from west, as (dx, dy)
RING = np.array([(-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1)])
EAST = 4


def _array(frame: pd.DataFrame) -> np.ndarray:
    out = np.zeros((int(frame["h"].iloc[0]), int(frame["w"].iloc[0])), np.int64)
    out[frame["y"], frame["x"]] = frame["v"]
    return out


CONTOURS = "img long, contour int, seq int, x int, y int, border string, parent int"


def _turns() -> list[tuple[int, int, int, bool, bool]]:
    """(mask, back, ahead, west, east) for each set of white neighbours, a bit for each of ``RING``.

    Coming from direction ``back``, a border turns back from it until it meets white, ``ahead``; west and east tell if it
    passed black there.  Only turns past a black place beside this one belong to borders.  A place alone has
    one turn, 8, of its own.
    """
    rows = [(0, 8, 8, True, True)]
    for mask in range(1, 256):
        for back in range(8):
            if mask >> back & 1:
                passed = []
                while not mask >> (ahead := (back - 1 - len(passed)) % 8) & 1:
                    passed.append(ahead)
                if any(d % 2 == 0 for d in passed):
                    rows.append((mask, back, ahead, 0 in passed, EAST in passed))
    return rows


def _border_steps(r: DataFrame, threshold: int) -> DataFrame:
    """(img, w, h, x, y, pix, n, next, west, east): each place of a border with the way it is passed, and the step that follows."""
    white = r.select("img", "w", "h", "c", "x", "y", (F.col("v") > threshold).cast("int").alias("v"))
    near = T.neighbours(white, [tuple(map(int, d)) for d in RING], border="null").where("v = 1")
    mask = sum((F.when(F.col(f"n{i}") == 1, 1 << i).otherwise(0) for i in range(8)), F.lit(0))
    turns = r.sparkSession.createDataFrame(_turns(), "mask int, back int, ahead int, west boolean, east boolean")  # of one size, whatever the rasters
    steps = near.select("img", "w", "h", "x", "y", mask.alias("mask")).join(F.broadcast(turns), "mask")
    move = lambda axis: F.element_at(F.array(*[F.lit(int(d[axis])) for d in RING], F.lit(0)), F.col("ahead") + 1)
    pix = F.col("y").cast("long") * F.col("w") + F.col("x")
    back = F.when(F.col("ahead") == 8, 8).otherwise((F.col("ahead") + 4) % 8)
    return steps.select("img", "w", "h", "x", "y", pix.alias("pix"), (pix * 9 + F.col("back")).alias("n"), ((pix + move(1) * F.col("w") + move(0)) * 9 + back).alias("next"), "west", "east")


def _border_starts(steps: DataFrame) -> DataFrame:
    """(img, cycle, start, pos): where each border begins, ``start`` being twice the place's number, and one more for a hole.

    Scanning by rows, a border begins at a place with black before it (not in the first column) that no border has
    passed yet, or else at one with black behind it (not in the last column).  Of the two a place begins one at most, so
    a border whose first place begins another one waits for its next.
    """
    begins = F.array(F.when(F.col("west") & (F.col("x") > 0), 2 * F.col("pix")), F.when(F.col("east") & (F.col("x") + 1 < F.col("w")), 2 * F.col("pix") + 1))
    events = checkpointed(steps.select("img", "cycle", "pix", "pos", F.explode(begins).alias("at")).where("at is not null"))
    passed = checkpointed(steps.select("img", "cycle", "pix").distinct())
    holes = events.where("at % 2 = 1")
    starts = checkpointed(holes.groupBy("img", "cycle").agg(F.min("at").alias("start")))
    taken = None
    while True:
        other = passed.join(starts, ["img", "cycle"]).select("img", "pix", F.col("cycle").alias("other"), "start")
        outer = events.where("at % 2 = 0").join(other, ["img", "pix"], "left").groupBy("img", "cycle", "pos", "at").agg(F.max((F.col("other") != F.col("cycle")) & (F.col("start") < F.col("at"))).alias("late"))
        fresh = outer.where("not coalesce(late, false)").select("img", "cycle", "pos", "at")
        open_ = holes if taken is None else holes.join(taken, ["img", "at"], "left_anti")
        found = checkpointed(fresh.unionByName(open_.select("img", "cycle", "pos", "at")).groupBy("img", "cycle").agg(F.min(F.struct("at", "pos")).alias("e")).select("img", "cycle", F.col("e.at").alias("start"), F.col("e.pos").alias("pos")))
        firsts = found.where("start % 2 = 0").select("img", (F.col("start") + 1).alias("start"))
        lost = checkpointed(found.join(firsts, ["img", "start"], "left_semi").select("img", F.col("start").alias("at")))
        if not lost.limit(1).count():
            return found
        starts = found.select("img", "cycle", "start")
        taken = lost if taken is None else checkpointed(taken.unionByName(lost))


def _parents(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """(img, start, up): the border that each border lies in, by its start; null if none.

    The border met last before a start, along its row, is the parent if it is of the other kind, else it has the same parent.
    A place shows the border that has passed black behind it, else the first that passed it; one of the last column the last.
    """
    at = steps.groupBy("img", "cycle", "w", "x", "y", "pix").agg(F.max("east").alias("east")).join(starts.select("img", "cycle", "start"), ["img", "cycle"]).where(F.col("start") <= 2 * F.col("pix") + 1)
    last_column = F.col("x") + 1 == F.col("w")
    shown = F.coalesce(F.max(F.when(last_column, F.col("start"))), F.max(F.when(F.col("east"), F.col("start"))), F.min("start"))
    places = at.groupBy("img", "y", "x", "pix").agg(shown.alias("shown"), F.min(F.when(F.col("start") < 2 * F.col("pix"), F.col("start"))).alias("before"))
    places = places.withColumn("left", F.last("shown", ignorenulls=True).over(W.partitionBy("img", "y").orderBy("x").rowsBetween(W.unboundedPreceding, -1)))
    met = starts.select("img", "start", F.floor(F.col("start") / 2).alias("pix")).join(places.select("img", "pix", "left", "before"), ["img", "pix"])
    rows = checkpointed(met.select("img", "start", F.when(F.col("start") % 2 == 1, F.coalesce("before", "left")).otherwise(F.col("left")).alias("up")))
    while True:  # borders of one kind point on to where the met one points, twice as far each round
        same = (F.col("up") - F.col("start")) % 2 == 0
        if not rows.where(same).limit(1).count():
            return rows
        beyond = rows.select("img", F.col("start").alias("up"), F.col("up").alias("further"))
        rows = checkpointed(rows.where(F.coalesce(~same, F.lit(True))).unionByName(rows.where(same).join(beyond, ["img", "up"]).select("img", "start", F.col("further").alias("up"))))


def find_contours(r: DataFrame, threshold: int = 0) -> DataFrame:
    """Borders of the places above ``threshold`` of gray rasters, with their kind and parent, in scan order.

    A border is a cycle of steps from place to place, told and numbered by :func:`_cycles`; its places are
    numbered on from where it starts.
    """
    steps = checkpointed(_cycles(_border_steps(r, threshold)))
    starts = checkpointed(_border_starts(steps))
    parents = _parents(steps, starts)
    order = starts.select("img", "start", (F.row_number().over(W.partitionBy("img").orderBy("start")) - 1).alias("contour"))
    named = starts.join(order, ["img", "start"]).join(parents, ["img", "start"])
    named = named.join(order.select("img", F.col("start").alias("up"), F.col("contour").alias("parent")), ["img", "up"], "left")
    named = checkpointed(named.select("img", "cycle", F.col("pos").alias("first"), "contour", "parent", F.when(F.col("start") % 2 == 0, "outer").otherwise("hole").alias("border")))
    points = steps.select("img", "pos", "length", "x", "y", "cycle").join(named, ["img", "cycle"])
    seq = F.pmod(F.col("pos") - F.col("first"), F.col("length"))
    return points.select("img", "contour", seq.cast("int").alias("seq"), "x", "y", "border", "parent")


STEP = ["img", "w", "x", "y", "pix", "n", "next", "west", "east"]


def _cycles(steps: DataFrame) -> DataFrame:
    """``steps`` with ``cycle``, the least n of a step's cycle, ``pos``, the steps from there, and ``length``, the cycle's steps.

    Rasters of one tile tell their cycles where they are.  For others classes of linked steps are the cycles, and
    pointers that double number them, so that no task needs a whole raster or border.
    """
    return split_by_tiles(steps, _tile_cycles, _linked_cycles)


def ranked_cycles(ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least number of the cycle, steps from it, the cycle's length) for each number of the permutation ``ahead``."""
    own = np.arange(len(ahead))
    least, far, reach = own, ahead, 1
    while reach < len(ahead):
        nearer = np.minimum(least, least[far])
        if reach > 1 and (nearer == least).all():
            break
        least, far, reach = nearer, far[far], 2 * reach
    to, more = np.where(own == least, own, ahead), (own != least).astype(np.int64)
    while (to != least).any():
        more, to = more + more[to], to[to]
    length = np.bincount(least, minlength=len(ahead))[least]
    return least, (length - more) % length, length


def _tile_cycles(steps: DataFrame) -> DataFrame:
    rows = steps.select(*STEP).repartition("img").sortWithinPartitions("img", "n")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in T.whole_groups(batches, ["img"]):
            group = T.group_numbers(table, ["img"]).astype(np.int64)
            n, ahead = table.column("n").to_numpy(), table.column("next").to_numpy()
            many = int(max(n.max(), ahead.max())) + 1
            cycle, pos, length = ranked_cycles(np.searchsorted(group * many + n, group * many + ahead))
            yield pa.RecordBatch.from_arrays([*(table.column(k).combine_chunks() for k in STEP), pa.array(n[cycle]), pa.array(pos), pa.array(length)], [*STEP, "cycle", "pos", "length"])

    return rows.mapInArrow(told, "img bigint, w int, x int, y int, pix bigint, n bigint, next bigint, west boolean, east boolean, cycle bigint, pos bigint, length bigint")


def _linked_cycles(steps: DataFrame) -> DataFrame:
    steps = checkpointed(steps.select(*STEP))
    key = lambda n: F.struct(F.col("img"), F.col(n).alias("n"))
    labels = component_labels(steps.select(key("n").alias("a"), key("next").alias("b")))
    cycles = labels.select(F.col("id.img").alias("img"), F.col("id.n").alias("n"), F.col("label.n").alias("cycle"))
    steps = checkpointed(steps.join(cycles, ["img", "n"], "left").withColumn("cycle", F.coalesce("cycle", "n")))
    links = steps.where("next != cycle").select("img", F.col("next").alias("n"), F.col("n").alias("before"))
    ranked = checkpointed(steps.join(links, ["img", "n"], "left").select("img", "n", "before", F.when(F.col("before").isNull(), 0).otherwise(1).alias("pos")))
    while ranked.where("before is not null").limit(1).count():
        far = ranked.select("img", F.col("n").alias("before"), F.col("before").alias("further"), F.col("pos").alias("more"))
        ranked = checkpointed(ranked.join(far, ["img", "before"], "left").select("img", "n", F.col("further").alias("before"), (F.col("pos") + F.coalesce("more", F.lit(0))).alias("pos")))
    sizes = steps.groupBy("img", "cycle").agg(F.count("*").alias("length"))
    told = steps.join(ranked.select("img", "n", F.col("pos").cast("long").alias("pos")), ["img", "n"]).join(sizes, ["img", "cycle"])
    return told.select(*STEP, "cycle", "pos", "length")


def _seam(energy: np.ndarray) -> list[int]:
    """x per row from the bottom; the step compares the right neighbour with the least value seen so far."""
    cost = energy.astype(np.int64)
    for y in range(1, len(cost)):
        wide = np.pad(cost[y - 1], 1, constant_values=np.iinfo(np.int64).max)
        cost[y] += np.minimum(np.minimum(wide[:-2], wide[2:]), cost[y - 1])
    x = int(cost[-1].argmin())
    seam, held, column = [x], cost[-1, x], x
    for row in cost[-2::-1]:
        if column > 0 and row[column - 1] < row[column]:
            x, held = column - 1, row[column - 1]
        if column + 1 < len(row) and row[column + 1] < held:
            x, held = column + 1, row[column + 1]
        column = x
        seam.append(x)
    return seam


def find_vertical_seam(r: DataFrame) -> DataFrame:
    """(img, y, x): a seam of low Sobel magnitude through each gray raster."""
    def each(frame: pd.DataFrame) -> pd.DataFrame:
        seam = _seam(_array(frame))
        h = len(seam)
        return pd.DataFrame({"img": frame["img"].iloc[0], "y": [h - 1 - i for i in range(h)], "x": seam})

    return T.sobel_gradients(r).where(F.col("w") >= 2).groupBy("img").applyInPandas(each, "img long, y int, x int")


def remove_vertical_seam(r: DataFrame, seam: DataFrame) -> DataFrame:
    """Drops the seam's place in each row; what is right of it moves left."""
    cut = seam.select("img", "y", F.col("x").alias("sx"))
    return r.join(cut, ["img", "y"]).where("x != sx").select("img", (F.col("w") - 1).alias("w"), "h", "c", F.when(F.col("x") > F.col("sx"), F.col("x") - 1).otherwise(F.col("x")).alias("x"), "y", "v")


def _sobel(values: np.ndarray) -> np.ndarray:
    """Sobel magnitudes as :func:`stencil.sobel_gradients` gives them."""
    wide = np.pad(values, 1, mode="edge")
    h, w = values.shape
    total = lambda k: np.clip(sum(wide[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] * weight for (dx, dy), weight in k.items()), -32768, 32767)
    return np.floor(np.sqrt((total(T.SOBEL_H) ** 2 + total(T.SOBEL_V) ** 2).astype(np.float64))).astype(np.int64)


def shrunk(values: np.ndarray, target: int) -> np.ndarray:
    """A raster without one seam after the other, until it is ``target`` wide."""
    while values.shape[1] > target:
        seam = np.array(_seam(_sobel(values))[::-1])
        kept = np.arange(values.shape[1]) != seam[:, None]
        values = values[kept].reshape(len(values), -1)
    return values


def shrink_width(r: DataFrame, target: int) -> DataFrame:
    """Removes seams of gray rasters until none is wider than ``target`` (one of 2 at least has a seam); each stops by itself.

    Seams follow from each other, so a raster's are one task's, which holds that raster.
    """
    key = ["img", "w", "h", "c"]
    wide = r.where((F.col("w") > target) & (F.col("w") >= 2)).select(F.col("img").cast("long").alias("img"), *[F.col(k).cast("int").alias(k) for k in ("w", "h", "c", "x", "y")], F.col("v"))
    rows = wide.repartition("img").sortWithinPartitions(*key, "y", "x")
    least = max(target, 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in T.whole_groups(batches, key):
            group = T.group_numbers(table, key)
            v = table.column("v").to_numpy()
            for lo, hi in zip(at := np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), [*at[1:], len(v)], strict=True):
                img, w, h, c = (table.column(k)[int(lo)].as_py() for k in key)
                values = shrunk(v[lo:hi].reshape(h, w), least)
                if target < 1:  # what is one wide has no seam, and no place in a narrower raster
                    continue
                y, x = np.divmod(np.arange(values.size, dtype=np.int32), target)
                columns = [np.full(values.size, img), *(np.full(values.size, k, np.int32) for k in (target, h, c)), x, y, values.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(k) for k in columns], T.RASTER)

    kind = r.schema["v"].dataType.simpleString()
    narrow = rows.mapInArrow(cut, f"img bigint, w int, h int, c int, x int, y int, v {kind}")
    return r.where(F.col("w") <= target).select(*T.RASTER).unionByName(narrow)


def _marked(seams: list[DataFrame], moved: Callable[[Column], Column]) -> DataFrame:
    out = None
    for seam in seams:
        place = seam.select("img", "y", "x")
        if out is not None:
            earlier = out.groupBy("img", "y").agg(F.array_sort(F.collect_list("x")).alias("gone"))
            place = place.join(earlier, ["img", "y"]).select("img", "y", moved(F.col("gone")).alias("x"))
            place = out.unionByName(place)
        out = place
    return out


def seam_marks(seams: list[DataFrame]) -> DataFrame:
    """(img, y, x): places in the original raster of seams found one after the other."""
    # earlier seams, ascending, push the place to the right
    return _marked(seams, lambda gone: F.aggregate(gone, F.col("x"), lambda a, g: F.when(g <= a, a + 1).otherwise(a)))


def draw_vertical_seams(r: DataFrame, seams: list[DataFrame]) -> DataFrame:
    """A gray raster as RGB with its seams in red.

    A drawn place moves right by the number of earlier drawn ones left of where it was found, so
    seams found at one place are drawn over each other, unlike the places of :func:`seam_marks`.
    """
    rgb = r.select("img", "w", "h", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("c"), "x", "y", "v")
    if not seams:
        return rgb
    marks = _marked(seams, lambda gone: F.col("x") + F.size(F.filter(gone, lambda g: g < F.col("x")))).distinct().withColumn("red", F.lit(True))
    value = F.when(F.col("red"), F.when(F.col("c") == 0, 255).otherwise(0)).otherwise(F.col("v"))
    return rgb.join(marks, ["img", "y", "x"], "left").select("img", "w", "h", "c", "x", "y", value.alias("v"))
