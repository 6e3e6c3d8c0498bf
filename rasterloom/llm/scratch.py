"""Tables that cut a plan's lineage, kept in the cluster's shared checkpoint folder."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset on a local master (tests) a temporary folder is used.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = getattr(spark, "_own_scratch", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="scratch-")
        spark._own_scratch = own
        atexit.register(_remove, spark, own)
    return own


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    try:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is over; the shared folder has its own clean-up
        pass


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nothing refers to any more.

    Spark's cleaner removes them when the driver's collectors find the plans gone, which on a
    quiet driver can be long after the job.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written to the shared folder once and read back."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    del df
    release(spark)
    return back


def discard(df: DataFrame) -> None:
    """Removes a table of :func:`written` that no plan needs any more."""
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, file)
