"""Batches of pages, and documents put together from pages in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import join_pages


def batch_of(page_number: Column, workers: int) -> Column:
    """The batch of ``workers`` consecutive pages that a page belongs to, from 0."""
    return F.floor(page_number / F.lit(workers)).cast("long")


def documents(pages: DataFrame, document: str = "doc_id", page: str = "page_number", markdown: str = "markdown") -> DataFrame:
    """(document, pages, markdown): a row for each document with its pages in page order.

    A group is one document, so its size doesn't grow with the corpus. Failed
    pages (null) keep their place as blank ones.
    """
    each = F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce(F.col(markdown), F.lit("")).alias("m")))
    ordered = pages.groupBy(document).agg(F.transform(F.array_sort(each), lambda x: x["m"]).alias("pages"))
    return ordered.withColumn("markdown", join_pages(F.col("pages")))
