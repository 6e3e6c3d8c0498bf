"""Aggregates over rasters and the lookups they drive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr as E
from .stencil import COL, ROW, TILE_COL, TILE_ROW, tiled, untiled


def histogram(r: DataFrame) -> DataFrame:
    """(img, c, v, n): a count for each of the 256 values."""
    counts = r.groupBy("img", "c", "v").agg(F.count("*").alias("n"))
    bins = r.select("img", "c").distinct().select("img", "c", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("v"))
    return bins.join(counts, ["img", "c", "v"], "left").select("img", "c", "v", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def cumulative_histogram(r: DataFrame) -> DataFrame:
    upto = W.partitionBy("img", "c").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    return histogram(r).select("img", "c", "v", F.sum("n").over(upto).alias("n"))


def min_max(r: DataFrame) -> DataFrame:
    return r.groupBy("img", "c").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def percentile(r: DataFrame, p: int) -> DataFrame:
    """The least x with 100 * cum(x) div total >= p."""
    if not 0 <= p <= 100:
        raise ValueError("p is between 0 and 100")
    cum = cumulative_histogram(r)
    total = F.max("n").over(W.partitionBy("img", "c"))
    return cum.withColumn("share", F.floor(F.col("n") * 100 / total)).where(F.col("share") >= p).groupBy("img", "c").agg(F.min("v").alias("v"))


def squared_error(a: DataFrame, b: DataFrame) -> DataFrame:
    other = b.select("img", "c", "x", "y", F.col("v").alias("v2"))
    return a.join(other, ["img", "c", "x", "y"]).groupBy("img").agg(F.avg(F.pow((F.col("v") - F.col("v2")).cast("double"), F.lit(2.0))).alias("mse"))


def rmse(a: DataFrame, b: DataFrame) -> DataFrame:
    return squared_error(a, b).select("img", F.sqrt("mse").alias("rmse"))


def psnr(a: DataFrame, b: DataFrame, largest: float = 255.0) -> DataFrame:
    """20 log10(largest) - 10 log10(mse); infinite for equal rasters."""
    mse = F.col("mse")
    value = F.when(mse == 0, F.lit(float("inf"))).otherwise(20 * F.log10(F.lit(largest)) - 10 * F.log10(F.when(mse == 0, 1.0).otherwise(mse)))
    return squared_error(a, b).select("img", value.alias("psnr"))


def find_extremes(r: DataFrame) -> DataFrame:
    """Largest and least value with their places, the first in raster order."""
    least = F.min(F.struct("v", "y", "x"))
    most = F.min(F.struct((-F.col("v")).alias("m"), "y", "x"))
    found = r.groupBy("img").agg(most.alias("a"), least.alias("b"))
    return found.select("img", (-F.col("a.m")).alias("max_value"), F.col("a.x").alias("max_x"), F.col("a.y").alias("max_y"), F.col("b.v").alias("min_value"), F.col("b.x").alias("min_x"), F.col("b.y").alias("min_y"))


def _levels(r: DataFrame) -> DataFrame:
    """The histogram with sums up to each value and in all."""
    one = W.partitionBy("img", "c")
    upto = one.orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    return histogram(r).select("img", "c", "v", "n", F.sum("n").over(upto).alias("below"), F.sum(F.col("n") * F.col("v")).over(upto).alias("sum_below"), F.sum("n").over(one).alias("total"), F.sum(F.col("n") * F.col("v")).over(one).alias("sum_total"))


def otsu_level(r: DataFrame) -> DataFrame:
    """(img, c, level): the first value that maximises the variance between the classes v <= level and v > level."""
    rows = _levels(r)
    above = F.col("total") - F.col("below")
    d = F.lit(1.0)
    mean_b = F.col("sum_below") / F.when(F.col("below") == 0, d).otherwise(F.col("below"))
    mean_f = (F.col("sum_total") - F.col("sum_below")) / F.when(above == 0, d).otherwise(above)
    between = F.when((F.col("below") == 0) | (above == 0), 0.0).otherwise(F.col("below") * above * F.pow(mean_b - mean_f, F.lit(2.0)))
    best = F.max(F.struct(between.alias("s"), (-F.col("v")).alias("m")))
    return rows.groupBy("img", "c").agg(best.alias("b")).select("img", "c", F.when(F.col("b.s") > 0, -F.col("b.m")).otherwise(0).alias("level"))


def kapur_level(r: DataFrame) -> DataFrame:
    """(img, c, level): the first value that maximises the two classes' summed entropies."""
    one = W.partitionBy("img", "c")
    upto = one.orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    share = histogram(r).withColumn("p", F.col("n") / F.sum("n").over(one))
    term = F.when(F.col("p") > 0, -F.col("p") * F.log(F.when(F.col("p") > 0, F.col("p")).otherwise(1.0))).otherwise(0.0)
    rows = share.withColumn("e", term).select("img", "c", "v", F.sum("p").over(upto).alias("P"), F.sum("e").over(upto).alias("H"), F.sum("e").over(one).alias("T"))
    q = F.col("P") * (1 - F.col("P"))
    ok = q > 1e-12
    psi = F.log(F.when(ok, q).otherwise(1.0)) + F.col("H") / F.when(ok, F.col("P")).otherwise(1.0) + (F.col("T") - F.col("H")) / F.when(ok, 1 - F.col("P")).otherwise(1.0)
    best = F.max(F.when(ok, F.struct(F.round(psi, 9).alias("s"), (-F.col("v")).alias("m"))))
    return rows.groupBy("img", "c").agg(best.alias("b")).select("img", "c", F.coalesce(-F.col("b.m"), F.lit(0)).alias("level"))


def _looked_up(r: DataFrame, table: DataFrame) -> DataFrame:
    """Values replaced by a (img, c, v, new) table; it has 256 rows a raster and channel."""
    return r.join(table, ["img", "c", "v"]).select("img", "w", "h", "c", "x", "y", F.col("new").alias("v"))


def equalize_histogram(r: DataFrame) -> DataFrame:
    cum = cumulative_histogram(r)
    total = F.max("n").over(W.partitionBy("img", "c"))
    return _looked_up(r, cum.select("img", "c", "v", E.clamp_trunc(F.col("n") * 255.0 / total).alias("new")))


def match_histogram(r: DataFrame, target: DataFrame) -> DataFrame:
    """Values mapped so that the cumulative histogram follows the target's (of the same img).

    Each value takes the first target value whose share reaches its own, or the one before if
    that is strictly nearer.
    """
    def shares(x: DataFrame, name: str) -> DataFrame:
        total = F.max("n").over(W.partitionBy("img", "c"))
        return cumulative_histogram(x).select("img", "c", F.col("v").alias(name), (F.col("n") / total).alias(f"{name}_p"))

    s = shares(r, "v")
    t = shares(target, "t").groupBy("img", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "t_p"))), lambda z: z["t_p"]).alias("ps"))
    rows = s.join(t, ["img", "c"])
    reach = F.size(F.filter("ps", lambda p: p < F.col("v_p")))  # the first index at least as high
    hi = F.least(reach, F.lit(255))
    high, low = F.element_at("ps", hi + 1), F.element_at("ps", F.greatest(hi, F.lit(1)))
    new = F.when((hi > 0) & (F.col("v_p") - low < high - F.col("v_p")), hi - 1).otherwise(hi)
    return _looked_up(r, rows.select("img", "c", "v", new.cast("int").alias("new")))


# ---- prefix sums --------------------------------------------------------------------------


def integral_image(r: DataFrame, squared: bool = False, kind: str | None = None) -> DataFrame:
    """Sums over all places above and to the left; one row and column of zeros first.

    Rows are dealt by line, then columns, so no task needs a whole raster.
    """
    v = F.col("v").cast(kind or "bigint")
    before = (W.unboundedPreceding, 0)
    rows = r.withColumn("s", F.sum(v * v if squared else v).over(ROW().rowsBetween(*before)))
    sums = rows.select("img", (F.col("w") + 1).alias("w"), (F.col("h") + 1).alias("h"), "c", (F.col("x") + 1).alias("x"), (F.col("y") + 1).alias("y"), F.sum("s").over(COL().rowsBetween(*before)).alias("v"))
    sizes = r.select("img", "w", "h", "c").distinct()
    zero = F.lit(0).cast(kind or "bigint")
    top = sizes.select("img", (F.col("w") + 1).alias("w"), (F.col("h") + 1).alias("h"), "c", F.explode(F.sequence(F.lit(0), F.col("w"))).alias("x"), F.lit(0).alias("y"), zero.alias("v"))
    left = sizes.select("img", (F.col("w") + 1).alias("w"), (F.col("h") + 1).alias("h"), "c", F.lit(0).alias("x"), F.explode(F.sequence(F.lit(1), F.col("h"))).alias("y"), zero.alias("v"))
    return sums.unionByName(top).unionByName(left)


def rect_sums(integral: DataFrame, rects: DataFrame) -> DataFrame:
    """(img, c, rect columns, total) for ``rects(img, left, top, right, bottom)``, all inclusive: four lookups each."""
    corner = F.explode(F.array(*[F.struct(x.alias("x"), y.alias("y"), F.lit(s).alias("s")) for x, y, s in ((F.col("right") + 1, F.col("bottom") + 1, 1), (F.col("right") + 1, F.col("top"), -1), (F.col("left"), F.col("bottom") + 1, -1), (F.col("left"), F.col("top"), 1))]))
    asked = rects.select("img", "left", "top", "right", "bottom", corner.alias("k")).select("*", F.col("k.x").alias("x"), F.col("k.y").alias("y"), F.col("k.s").alias("s"))
    met = asked.join(integral.select("img", "c", "x", "y", "v"), ["img", "x", "y"])
    return met.groupBy("img", "c", "left", "top", "right", "bottom").agg(F.sum(F.col("s") * F.col("v")).alias("total"))


def rect_variance(r: DataFrame, rects: DataFrame) -> DataFrame:
    """(sum of squares - sum^2 / n) / n over each rectangle."""
    a = rect_sums(integral_image(r), rects)
    b = rect_sums(integral_image(r, squared=True), rects).withColumnRenamed("total", "squares")
    n = (F.col("right") - F.col("left") + 1) * (F.col("bottom") - F.col("top") + 1)
    return a.join(b, ["img", "c", "left", "top", "right", "bottom"]).withColumn("variance", (F.col("squares") - F.col("total") * F.col("total") / n) / n)


def running_sums(r: DataFrame, padding: int, rows: bool = True) -> DataFrame:
    """(img, c, line, i, v): running sums of each row (or column) with its edge values repeated ``padding`` times."""
    line, at, size = ("y", "x", "w") if rows else ("x", "y", "h")
    wide = F.when(F.col(at) == 0, F.sequence(F.lit(-padding), F.lit(0))).otherwise(F.array(F.col(at)))
    wide = F.when(F.col(at) == F.col(size) - 1, F.concat(wide, F.when(F.lit(padding) > 0, F.sequence(F.col(at) + 1, F.col(at) + F.greatest(F.lit(1), F.lit(padding)))).otherwise(F.array().cast("array<int>")))).otherwise(wide)
    spread = r.select("img", "c", F.col(line).alias("line"), F.explode(wide).alias("i"), "v")
    upto = W.partitionBy("img", "c", "line").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    return spread.select("img", "c", "line", (F.col("i") + padding).alias("i"), F.sum("v").over(upto).alias("v"))


def block_sum(r: DataFrame, radius: int) -> DataFrame:
    """``r`` with total and area of the block around each place, cut at the edges."""
    rows = tiled(r, radius, radius, radius, radius).withColumn("s", F.sum("v").over(TILE_ROW().rowsBetween(-radius, radius)))
    out = untiled(rows.withColumn("total", F.sum("s").over(TILE_COL().rowsBetween(-radius, radius))).drop("s"))
    side = lambda at, size: F.least(F.col(at) + radius, F.col(size) - 1) - F.greatest(F.col(at) - radius, F.lit(0)) + 1
    return out.withColumn("area", side("x", "w") * side("y", "h"))


def adaptive_threshold(r: DataFrame, radius: int, delta: int) -> DataFrame:
    """255 where the value is at least the block's integer mean less delta."""
    if radius < 1:
        raise ValueError("radius must be positive")
    mean = F.floor(F.col("total") / F.col("area"))
    return block_sum(r, radius).select("img", "w", "h", "c", "x", "y", F.when(F.col("v") >= mean - delta, 255).otherwise(0).alias("v"))
