"""Results out: pages, documents, figures, reports."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.schema import FIGURE


def write_pages(pages: DataFrame, path: str) -> None:
    pages.write.mode("overwrite").parquet(path)


def as_list(pages: DataFrame, page: str = "page_number", markdown: str = "markdown") -> list[str]:
    """One document's pages in order, for a caller who wants them on the driver.

    They are ordered here: sorting in Spark would sample them first, and so make their model calls twice.
    """
    rows = pages.select(page, markdown).collect()
    return [r[1] or "" for r in sorted(rows, key=lambda r: r[0])]


def document_folder(doc_id: Column) -> Column:
    """A folder's name for each document, so that the files of two documents never meet."""
    name = F.regexp_replace(F.element_at(F.split(doc_id.cast("string"), "/"), -1), r"[^\w.-]", "_")
    return F.concat(name, F.lit("-"), F.substring(F.md5(doc_id.cast("string")), 1, 8))


def opener(spark: SparkSession, root: str) -> Callable[[str, bytes], None] | None:
    """What writes a file below ``root`` from any executor; None if only Spark's own file systems know it."""
    import pyarrow.fs as fs

    try:
        fs.FileSystem.from_uri(root if "://" in root or root.startswith("/") else os.path.abspath(root))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None
    where = root if "://" in root or root.startswith("/") else os.path.abspath(root)

    def write(name: str, content: bytes) -> None:
        system, base = fs.FileSystem.from_uri(where)
        path = f"{base}/{name}"
        system.create_dir(path.rpartition("/")[0], recursive=True)
        with system.open_output_stream(path) as out:
            out.write(content)

    return write


def with_figure_files(pages: DataFrame, pngs: str, root: str, into: str = "figures", write: Callable[[str, bytes], None] | None = None) -> DataFrame:
    """``pages`` (doc_id, page_number) with figures by name instead of the array of pictures ``pngs``.

    Pictures are written by the tasks, below ``root``. One that can't be
    written is left out and uses up no number. Writing again gives the same
    files, so a task may run twice.
    """
    write = write or opener(pages.sparkSession, root)
    if write is None:
        raise ValueError(f"executors can't write to {root}: give a folder of a file system that pyarrow knows")
    folder = "figure_folder"
    given = pages.withColumn(folder, document_folder(F.col("doc_id")))
    schema = T.StructType([*pages.drop(pngs).schema.fields, T.StructField(into, T.ArrayType(FIGURE))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for where, page, found in zip(*(batch.column(c).to_pylist() for c in (folder, "page_number", pngs))):
                if found is None:
                    made.append(None)
                    continue
                named = []
                for png in found:
                    name = f"{where}/image_{page + 1}_{len(named) + 1}.png"
                    try:
                        write(name, bytes(png))
                    except OSError:
                        continue
                    named.append({"image_url": name, "base64_encoded": None})
                made.append(named)
            kind = pa.list_(pa.struct([("image_url", pa.string()), ("base64_encoded", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in schema.names[:-1]] + [pa.array(made, kind)], names=schema.names)

    return given.mapInArrow(run, schema)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A text file in any file system of Spark's, from the driver."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
