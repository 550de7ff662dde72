"""The corpus pipeline: quality rules, line dedup, near-dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor
left, and returns a DataFrame that is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents.

Nulls are allowed in any column. A null text counts as empty, so the quality
rules reject it; a null source is a source like any other; a null doc_id comes
last where the smallest stays. Texts of any length are worked on whole.
Repeated rows are judged alike by the quality rules, count each in line dedup,
and are near-duplicates of each other, of which one stays. Columns beyond
those of documents are dropped by the first stage. An empty table gives an
empty table in each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import line_dedup, mixing, packing, quality_rules, simhash
from pagemill.llm.common import remove_at_exit, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars being that of the text as it now is."""
    made = F.char_length(F.coalesce("text", F.lit(""))).cast("long")
    return df.select("doc_id", "text", "lang", "source", made.alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule are removed, and rejected documents go: null, empty and short ones among them."""
    return _documents(quality_rules.accepted(docs).drop("text").withColumnRenamed("clean_text", "text"))


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least ten documents are dropped from all; every document stays, with an empty text if it loses all lines."""
    return _documents(line_dedup.drop_frequent_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that with the smallest doc_id, and of rows that repeat it the
    first. Documents that have lost all lines are a group."""
    return _documents(simhash.one_of_each(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them, up to three times or not at all; rows with the same doc_id and
    source alike. Those without words, which add none, go."""
    return _documents(mixing.resampled(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens; a document that comes again is packed again."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", shared_lines),
    ("near_dedup", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: Tokenising can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, with what lies between them in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            remove_at_exit(spark, path)
            docs = spark.read.parquet(path)
    return docs
