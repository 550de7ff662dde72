"""Which texts hold which of a set of items, word for word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.sources.staging import spread

#: Words of a shingle, and items without inner words that are compared with all texts at a time.
WORDS, BLOCK = 5, 1000
#: Items that are sent to every task at most, with so many bytes.
MOST_SENT, MOST_BYTES = 100_000, 32 << 20


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+", -1), lambda w: w != "")


def _shingle(words: Column, at: Column, n: int) -> Column:
    """A hash of n words and of their number."""
    return F.xxhash64(F.lit(n), *[F.get(words, at + k) for k in range(n)])


def _shingles(words: Column, n: int) -> Column:
    """The hash of each shingle of n words; none for fewer words."""
    every = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: _shingle(words, i, n))
    return F.when(F.size(words) >= n, every).otherwise(F.array().cast("array<bigint>"))


def holders(texts: DataFrame, items: DataFrame, text: str, item: str) -> DataFrame:
    """The pairs of ``texts`` and ``items`` in which the text contains the item; nulls are in no pair.

    An item's words but the first and last stand between white space in every
    text that holds it. So its key is a shingle of up to WORDS of these, the
    texts' shingles are met with the keys in an equi-join, and only pairs that
    meet are compared. Items are sent to the texts if they prove few. Items
    without inner words are compared with all texts, in blocks.
    """
    given = items.where(F.col(item).isNotNull()).withColumn("__words", _words(F.col(item)))
    inner = F.size("__words") - 2
    keyed = given.withColumn("__n", F.least(F.lit(WORDS), inner))
    lengths = [r[0] for r in keyed.where("__n > 0").select("__n").distinct().collect()]  # WORDS at most
    size = given.agg(F.count("*"), F.sum(F.octet_length(item))).first()
    few = size[0] <= MOST_SENT and (size[1] or 0) <= MOST_BYTES
    sent = F.broadcast if few else lambda df: df
    pairs = texts.limit(0).join(items.limit(0), F.lit(False))
    if lengths:
        key = F.lit(None).cast("long")
        for n in lengths:  # the middle of the item
            key = F.when(F.col("__n") == n, _shingle(F.col("__words"), F.floor((F.size("__words") - n) / 2).cast("int"), n)).otherwise(key)
        keys = keyed.where("__n > 0").select(*items.columns, key.alias("__key"))
        found = [_shingles(F.col("__words"), n) for n in lengths]
        # texts stay out of the exploded rows: a text is met again by its place in the files
        placed = spread(texts.select(text).withColumn("__row", F.monotonically_increasing_id())).withColumn("__words", _words(F.col(text)))
        met = placed.select("__row", F.explode(F.array_distinct(F.concat(*found))).alias("__key")).join(sent(keys), "__key").drop("__key")
        again = texts.withColumn("__row", F.monotonically_increasing_id()).join(met, "__row").drop("__row")
        pairs = pairs.unionByName(again.where(F.contains(F.col(text), F.col(item))))
    short = given.where(inner <= 0).select(*items.columns)
    n = short.count()
    if n:
        blocks = -(-n // BLOCK)
        numbered = short.withColumn("__block", F.pmod(F.xxhash64(item), F.lit(blocks)))
        for b in range(blocks):
            block = F.broadcast(numbered.where(F.col("__block") == b).drop("__block"))
            pairs = pairs.unionByName(texts.join(block, F.contains(F.col(text), F.col(item))))
    return pairs
