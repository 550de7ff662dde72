"""PDF files as rows, and pages as rows. Reading and rendering are done by a reader that can be exchanged."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagemill.config import PageConfig
from pagemill.errors import ConversionError, UnsupportedFileError
from pagemill.operators.figures import png_of, regions
from pagemill.schema import PAGE, REGION

#: What an upload may have at most, in bytes.
LARGEST_UPLOAD = 5 * 1024 * 1024


class Reader(Protocol):
    """Opens a document from bytes: its length is the number of pages; pages are fetched by ordinal."""

    def open(self, content: bytes) -> Any: ...

    def pages(self, document: Any) -> int: ...

    def rotation(self, document: Any, ordinal: int) -> int: ...

    def render(self, document: Any, ordinal: int, scale: float, rotation: int, annotations: bool) -> Any: ...

    def close(self, document: Any) -> None: ...


class PdfiumReader:
    """A reader on pypdfium2, where that is installed."""

    def open(self, content: bytes) -> Any:
        try:
            import pypdfium2
        except ImportError as error:
            raise ImportError("pypdfium2 is needed on the executors to read PDF files") from error
        return pypdfium2.PdfDocument(content)

    def pages(self, document: Any) -> int:
        return len(document)

    def rotation(self, document: Any, ordinal: int) -> int:
        return document[ordinal].get_rotation()

    def render(self, document: Any, ordinal: int, scale: float, rotation: int, annotations: bool) -> Any:
        bitmap = document[ordinal].render(scale=scale, rotation=rotation, may_draw_forms=annotations, draw_annots=annotations)
        try:
            return bitmap.to_numpy().copy()
        finally:
            bitmap.close()

    def close(self, document: Any) -> None:
        document.close()


def is_pdf(path: Column) -> Column:
    """Whether a path ends in .pdf, in any case."""
    return F.lower(path).endswith(".pdf")


def check_path(spark: SparkSession, path: str) -> None:
    """A single file must exist and be a regular file, and then be named as a PDF, in any file system of Spark's."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where) or not system.getFileStatus(where).isFile():
        raise FileNotFoundError(f"no file at {path}")
    if not path.lower().endswith(".pdf"):
        raise UnsupportedFileError(f"{path} is not a PDF")


def read_files(spark: SparkSession, path: str, largest: int | None = None) -> DataFrame:
    """(path, content) of the PDF files at a path; larger ones than ``largest`` bytes are left out unread."""
    files = spark.read.format("binaryFile").load(path).where(is_pdf(F.col("path")))
    if largest is not None:
        files = files.where(F.col("length") <= largest)
    return files.select("path", "content")


def page_rows(
    files: DataFrame, reader: Reader, config: PageConfig | None = None, mode: str = "FAILFAST", with_regions: bool = False,
    search: Callable[[Any], list[dict]] = regions,
) -> DataFrame:
    """``files`` (path, content) as pages: doc_id, page_number from 0, png, width, height, rotation, error,
    and ``regions``, the candidates for figures, if asked for.

    A page is rendered and encoded in one go, so rasters never cross a stage;
    batches hold one page. In PERMISSIVE mode a page that fails has its error,
    and a document that can't be opened is one row without a page number; in
    FAILFAST mode a ConversionError names both. A page whose figures can't be
    searched isn't a failure: it has ``figure_error`` instead of regions.
    """
    config = config or PageConfig()
    schema = T.StructType([*PAGE.fields, T.StructField("figure_error", T.StringType()), T.StructField("regions", T.ArrayType(REGION))])

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        try:
            document = reader.open(content)
        except Exception as error:
            if mode == "FAILFAST":
                raise ConversionError(f"{path}: {error}") from error
            yield path, None, None, None, None, None, f"{path}: {error}", None, None
            return
        try:
            for ordinal in range(reader.pages(document)):
                try:
                    turn = reader.rotation(document, ordinal)
                    pixels = reader.render(document, ordinal, config.scale, turn if config.pass_rotation else 0, config.include_annotations)
                    found, lacking = None, None
                    if with_regions:
                        try:
                            found = [tuple(r[f] for f in REGION.names) for r in search(pixels)]
                        except Exception as error:
                            lacking = f"{path}, page {ordinal + 1}: {error}"
                    made = path, ordinal, png_of(pixels[:, :, :3]), pixels.shape[1], pixels.shape[0], turn, None, lacking, found
                except Exception as error:
                    said = f"{path}, page {ordinal + 1}: {error}"
                    if mode == "FAILFAST":
                        raise ConversionError(said) from error
                    made = path, ordinal, None, None, None, None, said, None, None
                yield made
        finally:
            try:
                reader.close(document)
            except Exception:
                pass

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                for row in rows(path.as_py(), content.as_py()):
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row[:-1])) | {"regions": _named(row[-1])}], schema=to_arrow_schema(schema))

    out = files.select("path", "content").mapInArrow(run, schema)
    return out if with_regions else out.drop("figure_error", "regions")


def _named(found: list[tuple] | None) -> list[dict] | None:
    return None if found is None else [dict(zip(REGION.names, r)) for r in found]


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files, one a row."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
