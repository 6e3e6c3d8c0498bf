"""Rasters as relations ``(img, w, h, c, x, y, v)``, read or derived from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["img", "w", "h", "c", "x", "y", "v"]


def emb8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of ``embeddings`` as an 8x8 gray raster."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("img"), F.posexplode("embedding").alias("i", "e"))
    value = F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (F.col("e").cast("double") + 0.6) * 212.5))).cast("int")
    return rows.select("img", F.lit(8).alias("w"), F.lit(8).alias("h"), F.lit(0).alias("c"), (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), value.alias("v"))


def mosaic(spark: SparkSession, sf_dir: str, side: int = 5) -> DataFrame:
    """``embeddings`` as tiles of 8x8, ``side`` x ``side`` of them to a gray raster in the order of vec_id; missing ones are 0."""
    each = side * side
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.floor(F.col("vec_id") / each).alias("img"), F.pmod("vec_id", F.lit(each)).alias("tile"), "embedding")
    whole = rows.select("img").distinct().withColumn("tile", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(each - 1).cast("bigint"))))
    cells = whole.join(rows, ["img", "tile"], "left").select("img", "tile", F.posexplode(F.coalesce("embedding", F.array_repeat(F.lit(-1.0).cast("float"), 64))).alias("i", "e"))
    value = F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (F.col("e").cast("double") + 0.6) * 212.5))).cast("int")
    x, y = (F.col("tile") % side) * 8 + F.col("i") % 8, F.floor(F.col("tile") / side) * 8 + F.floor(F.col("i") / 8)
    return cells.select("img", F.lit(8 * side).alias("w"), F.lit(8 * side).alias("h"), F.lit(0).alias("c"), x.cast("int").alias("x"), y.cast("int").alias("y"), value.alias("v"))


def heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` counted on a grid of quantity by discount, 50x11, one raster; counts saturate at 255."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_quantity") - 1).cast("int").alias("x"), F.round(F.col("l_discount") * 100).cast("int").alias("y"))
    counts = rows.where("x between 0 and 49 and y between 0 and 10").groupBy("x", "y").agg(F.least(F.count("*"), F.lit(255)).cast("int").alias("n"))
    spread = spark.range(550).select((F.col("id") % 50).cast("int").alias("x"), F.floor(F.col("id") / 50).cast("int").alias("y"))
    return spread.join(counts, ["x", "y"], "left").select(F.lit(0).cast("bigint").alias("img"), F.lit(50).alias("w"), F.lit(11).alias("h"), F.lit(0).alias("c"), "x", "y", F.coalesce("n", F.lit(0)).alias("v"))


def grid(spark: SparkSession, width: int, height: int, value: Column, img: int = 0, channel: int = 0) -> DataFrame:
    """One generated raster; ``value`` reads columns ``x`` and ``y``."""
    places = spark.range(width * height).select((F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"))
    return places.select(F.lit(img).cast("bigint").alias("img"), F.lit(width).alias("w"), F.lit(height).alias("h"), F.lit(channel).alias("c"), "x", "y", value.cast("int").alias("v"))


def grids(sizes: DataFrame, value: Column, channel: int = 0) -> DataFrame:
    """A generated raster for each row of ``sizes(img, w, h)``; ``value`` reads columns ``x`` and ``y``."""
    rows = sizes.select("img", "w", "h", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    return rows.select("img", "w", "h", F.lit(channel).alias("c"), "x", "y", value.cast("int").alias("v"))


def _bench() -> list[Column]:
    """The test pattern's three channels; the first is the gray one."""
    r = F.col("x") % 7 + F.col("y") % 6
    return [r, 255 - r, F.least(r, 255 - r)]


def gray_benches(sizes: DataFrame) -> DataFrame:
    return grids(sizes, _bench()[0])


def rgb_benches(sizes: DataFrame) -> DataFrame:
    parts = [grids(sizes, v, c) for c, v in enumerate(_bench())]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def float_benches(sizes: DataFrame) -> DataFrame:
    return gray_benches(sizes).withColumn("v", F.col("v") / 255.0)


def gray_bench(spark: SparkSession, width: int, height: int) -> DataFrame:
    return grid(spark, width, height, _bench()[0])


def rgb_bench(spark: SparkSession, width: int, height: int) -> DataFrame:
    parts = [grid(spark, width, height, v, channel=c) for c, v in enumerate(_bench())]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def float_bench(spark: SparkSession, width: int, height: int) -> DataFrame:
    return gray_bench(spark, width, height).withColumn("v", F.col("v") / 255.0)


def literal(spark: SparkSession, rows: list[list[int]], img: int = 0) -> DataFrame:
    """A small gray raster from rows of values."""
    data = [(img, len(rows[0]) if rows else 0, len(rows), 0, x, y, v) for y, row in enumerate(rows) for x, v in enumerate(row)]
    return spark.createDataFrame(data, "img long, w int, h int, c int, x int, y int, v int")


def literal_channels(spark: SparkSession, rows: list[list[tuple[int, ...]]], img: int = 0) -> DataFrame:
    """A small raster from rows of pixels."""
    data = [(img, len(rows[0]), len(rows), c, x, y, v) for y, row in enumerate(rows) for x, p in enumerate(row) for c, v in enumerate(p)]
    return spark.createDataFrame(data, "img long, w int, h int, c int, x int, y int, v int")


def packed(pixels: DataFrame) -> DataFrame:
    """``(img, w, h, channels, data)``: a row per raster, row-major, channels interleaved."""
    data = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "c", "v"))), lambda p: p["v"])
    return pixels.groupBy("img", "w", "h").agg((F.max("c") + 1).alias("channels"), data.alias("data"))


def tall(rows: DataFrame) -> DataFrame:
    """The inverse of :func:`packed`."""
    i, n, w = F.col("i"), F.col("channels"), F.col("w")
    return rows.select("img", "w", "h", "channels", F.posexplode("data").alias("i", "v")).select("img", "w", "h", (i % n).alias("c"), (F.floor(i / n) % w).cast("int").alias("x"), F.floor(i / (n * w)).cast("int").alias("y"), "v")


def from_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files: Spark's reader gives interleaved BGR rows; channels come back in RGB order."""
    rows = spark.read.format("image").load(path).select("image.*")
    # a byte a character
    values = F.transform(F.split(F.decode("data", "ISO-8859-1"), ""), lambda b: F.ascii(b))
    n, w = F.col("n"), F.col("w")
    out = rows.select(F.xxhash64("origin").alias("img"), F.col("width").alias("w"), F.col("height").alias("h"), F.col("nChannels").alias("n"), F.posexplode(values).alias("i", "v"))
    c = (F.col("i") % n).cast("int")
    return out.select("img", "w", "h", F.when((n >= 3) & (c < 3), 2 - c).otherwise(c).alias("c"), (F.floor(F.col("i") / n) % w).cast("int").alias("x"), F.floor(F.col("i") / (n * w)).cast("int").alias("y"), "v")


def save(pixels: DataFrame, path: str) -> None:
    """Writes a raster relation as Parquet, clustered by raster."""
    pixels.repartition("img").sortWithinPartitions("img", "y", "x", "c").write.mode("errorifexists").parquet(path)
