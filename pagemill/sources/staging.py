"""Tables written between stages, so that paid work is kept when an executor is lost."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: ``spark.checkpoint.dir``. Where it isn't set, a
    temporary one, if all of Spark is on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="pagemill-")


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer partitions than there are cores is dealt out, before work that is heavy for each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame, keep: bool = True) -> DataFrame:
    """The rows of ``df``, written as Parquet and read again: its stages run once. Unless ``keep``, the files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    if not keep:
        atexit.register(_drop, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone already
        pass
