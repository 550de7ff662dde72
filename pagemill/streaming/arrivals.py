"""PDF files as a stream, as they arrive in a folder (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.sources.pdf import is_pdf

FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """(path, content) of PDF files as they arrive; convert each micro-batch with ``foreachBatch``."""
    stream = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", per_trigger).load(folder)
    return stream.where(is_pdf(stream["path"])).select("path", "content")
