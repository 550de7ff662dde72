"""What the operators of this subpackage share: reading tables, cutting lineage, Arrow helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space of the word pattern ``[^\x20\x09-\x0D]+``.
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, which all executors share.

    The setting is read from the session. Where there is none, a folder of our
    own is set if all of Spark is on this machine, as in tests; on a cluster
    executors couldn't see it, and that is an error.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            configured = tempfile.mkdtemp(prefix="pagemill-")
            atexit.register(shutil.rmtree, configured, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(configured)
    return jsc.getCheckpointDir().get()


def staged(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """The rows of a table, written as Parquet in the shared folder and read again; lineage ends there.

    Unlike a checkpoint, the table's size is known to the planner, and the
    folder goes when the driver process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A narrow table, staged: what is read more than once, or ends a round of a loop."""
    return staged(df, "lz4")


def remove_at_exit(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def drop() -> None:
        try:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        except Exception:  # the JVM may be gone already
            pass

    atexit.register(drop)


def free(name: str, *taken: str) -> str:
    """``name``, or that with underscores added, such that it is none of the columns ``taken`` (in any case)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def carried(df: DataFrame, *names: str) -> list[T.StructField]:
    """The fields of columns that a Python stage hands on as they are."""
    return [T.StructField(n, df.schema[n].dataType) for n in names]


#: A table is sent to every task up to so many rows and bytes.
SENT_ROWS, SENT_BYTES = 500_000, 32 << 20
#: A key with more than this part of all rows is hot; so there are no more than HOT of them, of at most HOT_BYTES each.
HOT, HOT_BYTES = 2000, 8192


def is_small(table: DataFrame, rows: int = SENT_ROWS, size: int = SENT_BYTES) -> bool:
    """Whether a staged table may be sent to every task, by a count of its rows and bytes."""
    n, held = table.agg(F.count("*"), F.sum(_octets(table))).first()
    return n <= rows and (held or 0) <= size


def _octets(table: DataFrame) -> Column:
    size = F.lit(0)
    for f in table.schema.fields:
        text = isinstance(f.dataType, (T.StringType, T.BinaryType))
        size = size + (F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) if text else F.lit(16))
    return size


def looked_up(rows: DataFrame, table: DataFrame, key: str, weight: str, small: bool | None = None) -> DataFrame:
    """``rows`` with the columns of ``table`` for their key, nulls where it has none; a left join that no key skews.

    ``table`` is staged, has one row for each ``key`` (no nulls) and in
    ``weight`` how many of ``rows`` have it; the weight isn't handed on. A
    table that proves small is sent to all tasks, and ``rows`` stay where they
    are. Else its hot keys are, of which there are HOT at most, and the
    others meet in a shuffle, in which rows of hot keys, which have no partner
    there, are spread evenly. Null keys must not be many: give them a value.
    """
    values, given = [c for c in table.columns if c not in (key, weight)], rows.columns
    if is_small(table) if small is None else small:
        return rows.join(F.broadcast(table.drop(weight)), key, "left").select(*given, *values)
    salt, hit = free("salt", *given, *table.columns), free("hit", *given, *table.columns)
    total = table.agg(F.sum(weight)).first()[0]
    is_hot = (F.col(weight) * HOT > total) & (_octets(table) <= HOT_BYTES)
    hot = table.where(is_hot).select(key, *(F.col(v).alias(f"{hit}_{v}") for v in values), F.lit(True).alias(hit))
    first = rows.join(F.broadcast(hot), key, "left")
    spread = F.when(F.col(hit), F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)) + 1).otherwise(F.lit(0))
    rest = table.where(~is_hot).select(key, *values, F.lit(0).cast("long").alias(salt))
    joined = first.withColumn(salt, spread.cast("long")).join(rest, [key, salt], "left")
    return joined.select(*given, *(F.coalesce(F.col(f"{hit}_{v}"), F.col(v)).alias(v) for v in values))


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(c, _UPPER, _LOWER)


def n_words(text: Column) -> Column:
    """How many words ``[^\x20\x09-\x0D]+`` a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 of each string of an Arrow column."""
    return column.cast(pa.binary()).to_pylist()


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of one string column, one row at least."""
    for batch in batches:
        start, held = 0, 0
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        for i, n in enumerate(sizes):
            held += n or 0
            if held >= most:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)
