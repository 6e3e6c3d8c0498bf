"""Connected components of an edge table: by joins alone, or, for ids that are longs, by contraction first."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: edges of one id that stay together in a join; ids with more are dealt to several keys
HUB = 1_000
#: keys that the members of one label are dealt to
SPREAD = 16
#: edges that a task of :func:`contracted_labels` joins at a time
FOREST = 1 << 18
#: contractions after which rounds of joins do the rest
LEVELS = 4


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut: a table in the folder of ``spark.checkpoint.dir``, computed once and read back.

    A temporary folder serves on a local master where the setting is missing.  Tables go when the driver ends.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None and context._jvm is not None:
        try:
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is over; the shared folder has its own clean-up
            pass


def _dealt(by: Column | str, keys: Column | int) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(keys) if isinstance(keys, int) else keys).cast("int")


def _copies(keys: Column | int) -> Column:
    return F.explode(F.sequence(F.lit(0), (F.lit(keys) if isinstance(keys, int) else keys) - 1))


def component_labels(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """(id, label): the least id reachable from each id of ``edges(a, b)``.

    Each round takes the least label of the neighbours, the label's own label, and the least that any
    holder of the same label took in the round before: chains halve, whole regions move at once, and
    long paths take few rounds.
    Labels only fall; the loop ends when none did.
    The edges of a hub, and the members of a large component, are dealt to several keys,
    so neither lands in one task.  The rounds' joins merge: their sides are dealt by key anyway, and a
    broadcast in each join of each round would go through the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = keep(both)
    labels = keep(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label"), F.first("a").alias("old"), F.ceil(F.count("*") / HUB).cast("int").alias("keys")))
    hubs = labels.where("keys > 1").select(F.col("id").alias("b"), "keys")  # one for HUB edges at most
    both = keep(both.join(hubs, "b", "left").select("a", "b", F.coalesce(_dealt("a", F.col("keys")), F.lit(0)).alias("part")))
    while True:
        known = labels.select(F.col("id").alias("b"), "label", _copies(F.col("keys")).alias("part"))
        near = both.join(known.hint("merge"), ["b", "part"]).groupBy("a").agg(F.min("label").alias("near"))
        own = labels.select(F.col("id").alias("label"), F.col("label").alias("top")).join(labels.select("label").distinct().hint("merge"), "label", "left_semi")
        tops = own.unionByName(labels.select(F.col("old").alias("label"), F.col("label").alias("top"))).groupBy("label").agg(F.min("top").alias("top")).where("top != label")
        tops = tops.select("label", "top", _copies(SPREAD).alias("part"))
        up = labels.drop("old").withColumn("part", _dealt("id", SPREAD)).join(tops.hint("merge"), ["label", "part"], "left")
        step = up.join(near.hint("merge"), up.id == near.a, "left").select("id", "keys", F.col("label").alias("old"), F.least("label", "near", "top").alias("label"))
        step = keep(step)
        moved = step.where("label != old").limit(1).count()
        labels = step
        if not moved:
            return labels.select("id", "label")


def _least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, roots): the least id that each id of the edges reaches through them."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        x, y = root[x], root[y]
        apart = x != y
        if not apart.any():
            return ids, ids[root]
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def forest() -> pa.RecordBatch:
        ids, roots = _least(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("a", "b")))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(roots)], ["id", "root"])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= FOREST:
            yield forest()
            held = []
    if held:
        yield forest()


def contracted_labels(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """:func:`component_labels` of ``edges(a long, b long)``, in one shuffle for each contraction.

    Tasks join the edges that they read, ``FOREST`` at a time, and pass on each id with the least id that it reaches there.
    An id's label is the least of these; the others and the label are the edges of the next, smaller table.
    It has few rows where groups are stars or small, and after ``LEVELS`` contractions, rounds of joins take what is left.
    A hub has one row for each task that meets it, so none lands in one task.
    """
    levels: list[DataFrame] = []
    rest = edges.where("a != b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    labels = None
    while labels is None:
        met = rest.mapInArrow(_forests, "id long, root long").groupBy("id").agg(F.collect_set("root").alias("roots"))
        level = keep(met.select("id", F.array_min("roots").alias("label"), "roots"))
        levels.append(level.select("id", "label"))
        several = level.where("size(roots) > 1").select(F.col("label").alias("a"), F.explode("roots").alias("b"))
        rest = keep(several.where("a != b"))
        n = rest.count()
        if not n:
            labels = levels.pop()
        elif len(levels) == LEVELS:
            labels = component_labels(rest, keep)
        else:
            rest = rest.coalesce(-(-n // FOREST))  # so that a task has edges enough to join
    while levels:
        tops = labels.where("id != label").select(F.col("id").alias("label"), F.col("label").alias("top"), _copies(SPREAD).alias("part"))
        up = levels.pop().withColumn("part", _dealt("id", SPREAD)).join(tops.hint("merge"), ["label", "part"], "left")
        labels = keep(up.select("id", F.coalesce("top", "label").alias("label")))
    return labels
