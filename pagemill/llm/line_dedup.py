"""Lines that many documents share are dropped from all of them.

A first pass explodes texts into normalised lines, hashes them to 128 bits and
counts documents per hash: for each batch of rows in Python, then with partial
aggregation in Spark, so that a line in a third of all documents is one row a
batch. A second pass drops the lines whose hash is frequent and puts a text
together again from those that stay, by position.

While the hashes that are frequent prove few, they are sent to all tasks, and
texts are never shuffled. Beyond that, places of lines are looked up by hash
(hot hashes sent, the others in a shuffle) and brought back to their document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import BLANKS, SENT_ROWS, carried, free, looked_up, small_batches, staged, utf8

MIN_DOCS, MIN_CHARS = 10, 1
_BLANKS = BLANKS.encode()


def line_key(line: bytes) -> bytes:
    """A line without ASCII white space at its ends, with A-Z in lower case."""
    return line.strip(_BLANKS).lower()


def hashes(text: bytes | None, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """The 128-bit hash of each line's key, or null if the key is too short to count.

    Lines end at line feeds; a null or empty text has one empty line.
    """
    keys = (line_key(x) for x in (text or b"").split(b"\n"))
    enough = (lambda k: len(k) >= min_chars) if min_chars <= 1 else (lambda k: len(k) >= min_chars and len(k.decode()) >= min_chars)
    return [xxhash.xxh3_128_digest(k) if enough(k) else None for k in keys]


def frequent_lines(docs: DataFrame, text: str, min_docs: int, min_chars: int) -> DataFrame:
    """(h, n): hashes of lines in at least ``min_docs`` rows, and in how many; staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches([whole], text):
                found: Counter[bytes] = Counter()
                for t in utf8(batch.column(text)):
                    found.update(set(hashes(t, min_chars)))
                found.pop(None, None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["h", "n"]
                )

    each = docs.select(text).mapInArrow(run, "h binary, n long")
    return staged(each.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs))


def drop_frequent_lines(
    docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, most_sent: int = SENT_ROWS
) -> DataFrame:
    """``docs`` with ``text`` less its frequent lines, and longs ``n_lines`` (before) and ``n_dropped``.

    A line goes from every document if its key has at least ``min_chars`` code
    points and is found in at least ``min_docs`` rows; a row counts once
    however often it has the line, and a repeated row counts again. Null and
    empty texts have one empty line, and become (or stay) empty texts. Texts
    of any length are taken whole. A table without rows gives none. Other
    columns stay as they are, whatever their names; columns of the names
    n_lines and n_dropped are replaced. ``docs`` should be read from files, so
    that its rows have the same places when they are read again. More than
    ``most_sent`` frequent lines are looked up in a shuffle instead of sent.
    """
    given = docs.drop("n_lines", "n_dropped")
    others = [c for c in given.columns if c != text]
    frequent = frequent_lines(given, text, min_docs, min_chars)
    schema = T.StructType(
        [T.StructField(c, T.StringType()) if c == text else carried(given, c)[0] for c in given.columns]
        + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    )
    if frequent.count() <= most_sent:
        rows = frequent.select("h").collect()  # at most ``most_sent`` hashes of 16 bytes
        sent = docs.sparkSession.sparkContext.broadcast(b"".join(bytes(r["h"]) for r in rows))
        return given.select(*others, text).mapInArrow(_filtered(given.columns, text, schema, min_chars, sent=sent), schema)
    row, at = free("row", *given.columns), free("at", *given.columns)
    placed = given.withColumn(row, F.monotonically_increasing_id())
    lines = placed.select(F.col(row).alias("row"), F.col(text).alias("text"))
    found = looked_up(lines.mapInArrow(_places(min_chars), "row long, at int, h binary"), frequent.withColumn("hit", F.lit(1)), "h", "n", False)
    per_row = found.where("hit is not null").groupBy(F.col("row").alias(row)).agg(F.collect_list("at").alias(at))
    joined = placed.join(per_row, row, "left").select(*others, text, at)
    return joined.mapInArrow(_filtered(given.columns, text, schema, min_chars, at=at), schema)


def _places(min_chars: int):
    """(row, place of the line, its hash) of each line that counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches([whole], "text"):
                out = [
                    (row, at, h)
                    for row, t in zip(batch.column("row").to_pylist(), utf8(batch.column("text")))
                    for at, h in enumerate(hashes(t, min_chars))
                    if h is not None
                ]
                row, at, h = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(at, pa.int32()), pa.array(h, pa.binary())], names=["row", "at", "h"])

    return run


def _filtered(columns: list[str], text: str, schema: T.StructType, min_chars: int, sent=None, at: str | None = None):
    """The second pass: lines go by hash (``sent``: the hashes put together) or by place (``at``: a column of places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frozenset(sent.value[i : i + 16] for i in range(0, len(sent.value), 16)) if sent is not None else frozenset()
        for whole in batches:
            for batch in small_batches([whole], text):
                texts, before, dropped = [], [], []
                places = batch.column(at).to_pylist() if at else None
                for i, t in enumerate(utf8(batch.column(text))):
                    lines = (t or b"").split(b"\n")
                    gone = {k for k, h in enumerate(hashes(t, min_chars)) if h in known} if places is None else set(places[i] or ())
                    texts.append(b"\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else t or b"")
                    before.append(len(lines))
                    dropped.append(len(gone))
                made = {text: pa.array(texts, pa.binary()).cast(pa.string())}
                yield pa.RecordBatch.from_arrays(
                    [made[c] if c in made else batch.column(c) for c in columns] + [pa.array(before, pa.int64()), pa.array(dropped, pa.int64())],
                    names=schema.names,
                )

    return run


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each document."""
    out = drop_frequent_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), e AS (
  SELECT rid, doc_id, len(ls) AS n, unnest(ls) AS l, generate_subscripts(ls, 1) AS pos FROM t
), k AS (
  SELECT *, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e
), f AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10
), d AS (
  SELECT k.*, f.key IS NOT NULL AS dropped FROM k LEFT JOIN f ON k.key = f.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM d GROUP BY rid
"""
