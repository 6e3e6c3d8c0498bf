"""Projections over pixels: no shuffle but where two rasters meet."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr as E

KEY = ["img", "x", "y", "c"]


def map_subpixels(r: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return r.withColumn("v", f(F.col("v")))


def map_pixels(r: DataFrame, f: Callable[[list[Column]], list[Column]], channels: int) -> DataFrame:
    """``f`` maps a pixel's channels to its new ones; pixels are formed by one aggregation."""
    pixels = r.groupBy("img", "w", "h", "x", "y").agg(*[F.max(F.when(F.col("c") == c, F.col("v"))).alias(f"p{c}") for c in range(channels)])
    new = f([F.col(f"p{c}") for c in range(channels)])
    return pixels.select("img", "w", "h", "x", "y", F.posexplode(F.array(*new)).alias("c", "v")).select("img", "w", "h", "c", "x", "y", "v")


def map_enumerated(r: DataFrame, f: Callable[[Column, Column, Column], Column]) -> DataFrame:
    return r.withColumn("v", f(F.col("x"), F.col("y"), F.col("v")))


def map_pixels2(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column]) -> DataFrame:
    """Zips two rasters of the same ``img``; the size is a's width by b's height."""
    other = b.select("img", "x", "y", "c", F.col("v").alias("v2"), F.col("h").alias("h2"))
    return a.join(other, KEY).select("img", "w", F.col("h2").alias("h"), "c", "x", "y", f(F.col("v"), F.col("v2")).alias("v"))


def into_channel(r: DataFrame, channel: int) -> DataFrame:
    """One channel as a gray raster."""
    return r.where(F.col("c") == channel).withColumn("c", F.lit(0))


def from_channel(r: DataFrame, channel: int) -> DataFrame:
    """A gray raster as one channel of three, the others zero."""
    values = F.array(*[F.col("v") if c == channel else F.lit(0).cast(dict(r.dtypes)["v"]) for c in range(3)])
    return r.select("img", "w", "h", "x", "y", F.posexplode(values).alias("c", "v")).select("img", "w", "h", "c", "x", "y", "v")


def blend(a: DataFrame, b: DataFrame, left_weight: float, right_weight: float) -> DataFrame:
    """The weighted sum of two rasters."""
    return map_pixels2(a, b, lambda p, q: E.weighted_sum(p, q, left_weight, right_weight))


def threshold(r: DataFrame, level: Column | int, kind: str) -> DataFrame:
    """``binary``, ``binary_inverted``, ``truncate``, ``to_zero`` (zeroes what is above) or ``to_zero_inverted``."""
    v, t = F.col("v"), level if isinstance(level, Column) else F.lit(level)
    over = v > t
    new = {
        "binary": F.when(over, 255).otherwise(0),
        "binary_inverted": F.when(over, 0).otherwise(255),
        "truncate": F.when(over, t).otherwise(v),
        "to_zero": F.when(over, 0).otherwise(v),
        "to_zero_inverted": F.when(over, v).otherwise(0),
    }
    if kind not in new:
        raise ValueError(f"no threshold of kind {kind}")
    return r.withColumn("v", new[kind].cast("int"))


def stretch_contrast(r: DataFrame, in_low: int, in_high: int, out_low: int, out_high: int) -> DataFrame:
    """Linear map of [in_low, in_high] to [out_low, out_high] in integers, saturating; channel 3 stays."""
    if not (in_low < in_high and out_low <= out_high):
        raise ValueError("ranges must ascend")
    v = F.col("v")
    inner = (F.floor((v - in_low) * (out_high - out_low) / (in_high - in_low)) + out_low).cast("int")
    return r.withColumn("v", F.when(F.col("c") == 3, v).when(v <= in_low, out_low).when(v >= in_high, out_high).otherwise(inner).cast("int"))


def _even(seed: int, *of: str) -> Column:
    """A number between 0 and 1, evenly, from the MD5 of a seed and columns."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in of])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def gaussian_noise(r: DataFrame, mean: float, deviation: float, seed: int) -> DataFrame:
    """Normal noise on each value, from hashes of the seed and the place, so that it doesn't depend on partitions."""
    place = ("img", "c", "x", "y")
    normal = F.sqrt(-2.0 * F.log(_even(2 * seed, *place))) * F.cos(2 * math.pi * _even(2 * seed + 1, *place))
    return r.withColumn("v", E.clamp_trunc(F.col("v") + normal * deviation + mean))


def salt_and_pepper(r: DataFrame, rate: float, seed: int) -> DataFrame:
    """Black or white, evenly, with probability ``rate`` per pixel."""
    if not 0 <= rate <= 1:
        raise ValueError("rate is a probability")
    spot = _even(seed, "img", "x", "y")
    return r.withColumn("v", F.when((F.lit(float(rate)) == 0) | (spot >= rate), F.col("v")).when(spot < rate / 2, 0).otherwise(255).cast("int"))


def diffs(actual: DataFrame, expected: DataFrame, differs: Callable[[Column, Column], Column] = lambda a, b: a != b) -> DataFrame:
    """Places where two rasters differ."""
    other = expected.select(*KEY, F.col("v").alias("expected"))
    return actual.join(other, KEY).where(differs(F.col("v"), F.col("expected"))).select(*KEY, F.col("v").alias("actual"), "expected")


#: fixed values: a region of differences of fewer places a side is shown whole, with a margin; else the first differences are listed
SHOWN, MARGIN, LISTED = 6, 2, 5


def describe_diffs(actual: DataFrame, expected: DataFrame, tolerance: float = 0) -> DataFrame:
    """(img, left, top, right, bottom, n, text) of each raster whose values differ by more than ``tolerance``.

    The box bounds the ``n`` differing places.  If it is small, ``text`` shows its part of both rasters, a line each row,
    differing places in brackets; else it lists the first differences in raster order.  Only the boxes' own places and the
    listed differences are gathered, so a text is bounded whatever differs.
    """
    far = F.abs(F.col("v") - F.col("v2")) > tolerance
    both = actual.join(expected.select(*KEY, F.col("v").alias("v2")), KEY)
    values = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", name))), lambda s: s[name].cast("string")), ",")
    found = both.where(far).groupBy("img", "x", "y").agg(F.count("*").alias("channels"))
    box = found.groupBy("img").agg(F.min("x").alias("left"), F.min("y").alias("top"), F.max("x").alias("right"), F.max("y").alias("bottom"), F.count("*").alias("n"))
    box = box.withColumn("shown", F.greatest(F.col("right") - F.col("left"), F.col("bottom") - F.col("top")) < SHOWN)
    # the small boxes with their margins, side by side
    near = both.join(box.where("shown"), "img").where(F.col("x").between(F.col("left") - MARGIN, F.col("right") + MARGIN) & F.col("y").between(F.col("top") - MARGIN, F.col("bottom") + MARGIN))
    pixels = near.groupBy("img", "x", "y").agg(values("v").alias("a"), values("v2").alias("e"), F.max(far).alias("odd"))
    cell = lambda name: F.when(F.col("odd"), F.concat(F.lit("["), name, F.lit("]"))).otherwise(F.col(name))
    line = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", cell(name).alias("t")))), lambda s: s["t"]), " ")
    lines = pixels.groupBy("img", "y").agg(F.concat(line("a"), F.lit("  |  "), line("e")).alias("t"))
    shown = lines.groupBy("img").agg(F.concat(F.lit("actual  |  expected\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "t"))), lambda s: s["t"]), "\n")).alias("text"))
    # the first differences of the others
    place = W.partitionBy("img").orderBy("y", "x")
    first = found.join(box.where("not shown").select("img"), "img").withColumn("k", F.row_number().over(place)).where(F.col("k") <= LISTED)
    each = both.join(first.select("img", "x", "y", "k"), ["img", "x", "y"]).groupBy("img", "x", "y", "k").agg(values("v").alias("a"), values("v2").alias("e"))
    told = F.concat(F.lit("("), "x", F.lit(", "), "y", F.lit("): actual "), "a", F.lit(", expected "), "e")
    listed = each.groupBy("img").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", told.alias("t")))), lambda s: s["t"]), "\n").alias("text"))
    return box.join(shown.unionByName(listed), "img").select("img", "left", "top", "right", "bottom", "n", "text")


def diff_summary(actual: DataFrame, expected: DataFrame, most: int = 5, tolerance: float = 0) -> str | None:
    """The first rasters that differ by more than ``tolerance``, as text; None where there are none."""
    found = describe_diffs(actual, expected, tolerance).orderBy("img").limit(most).collect()
    return "\n".join(f"pixels of img {r.img} do not match\n{r.text}" for r in found) or None


def assert_dimensions_match(actual: DataFrame, expected: DataFrame) -> None:
    """Raises if the rasters of two relations differ in number or size."""
    size = ["img", "w", "h"]
    a, b = actual.select(size).distinct(), expected.select(size).distinct()
    odd = a.exceptAll(b).withColumn("side", F.lit("actual")).unionByName(b.exceptAll(a).withColumn("side", F.lit("expected"))).orderBy("img", "side").limit(5).collect()
    if odd:
        raise AssertionError("dimensions differ: " + "; ".join(f"{r.side} img {r.img} is {r.w}x{r.h}" for r in odd))


def assert_pixels_equal(actual: DataFrame, expected: DataFrame, tolerance: float = 0) -> None:
    """Raises if sizes differ or a value differs by more than ``tolerance``; names the first differences."""
    assert_dimensions_match(actual, expected)
    places = [actual.select(KEY), expected.select(KEY)]
    if any(a.join(b, KEY, "left_anti").limit(1).count() for a, b in (places, places[::-1])):
        raise AssertionError("channels or places differ")
    found = diffs(actual, expected, lambda a, b: F.abs(a - b) > tolerance).orderBy("img", "y", "x", "c").limit(5).collect()
    if found:
        raise AssertionError("\n".join(f"img {r.img} ({r.x}, {r.y}) channel {r.c}: {r.actual}, expected {r.expected}" for r in found))
