"""SimHash near-duplicates: 64-bit fingerprints, linked at 4 or fewer differing bits.

Candidates come from Golay-code fuzzy hashing. A fingerprint is cut into three
segments A, B and C of 23, 23 and 18 bits, each in two blocks. Let two
fingerprints differ in 4 bits or fewer; then for some segment S

* S differs in at most 2 bits, so both have a Golay key of S in common, and
* of the four blocks of the other two segments, at least two are equal:
  with S the segment that differs most, if that is in 2 bits or fewer, the
  others differ in at most 2 bits, that is in at most two blocks; if one
  segment differs in 3 or 4 bits, one of the others differs in none, and
  both its blocks are equal, while the third, taken as S, differs in 1 at most.

So a key is (S, two of the four blocks, the bits of both blocks, a Golay key
of S): 3 x 6 kinds, some 90 keys a fingerprint, with 30 to 35 bits each. Keys
are dealt out and sorted by Spark and compared in a stream, so a task holds one
group of equal keys at a time and returns a spanning forest of the group's
links, never its pairs. A group of more than ``DENSE`` fingerprints isn't held:
its members go to ``_balls``, which links them exactly without comparing pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm import golay
from pagemill.llm.common import carried, cut, free, looked_up, small_batches, utf8
from pagemill.llm.components import Forest, components

MOST_BITS, WORDS = 4, 4
#: Fingerprints of a group of equal keys that one task compares in memory.
DENSE = 8192
#: (lowest bit, width) of each segment's two blocks.
BLOCKS = (((0, 12), (12, 11)), ((23, 12), (35, 11)), ((46, 9), (55, 9)))
SEGMENTS = ((0, 23), (23, 23), (46, 18))
_LINK = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("dense", pa.bool_())])


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """The SimHash of a UTF-8 text; 0 for a text without words, or null.

    A-Z are lower-cased, words are runs of other than ASCII white space, and
    each shingle of ``words`` words counts as often as it occurs. A text of
    fewer words is one shingle. A bit is 1 if set in over half the hashes.
    """
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, 32768):
        part = range(start, min(n, start + 32768))
        hashed = [xxhash.xxh64_intdigest(b" ".join(tokens[i : i + words]), 42) for i in part]
        octets = np.array(hashed, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, text: str = "text", into: str = "fp", words: int = WORDS) -> DataFrame:
    """``docs`` without the text, with a long that holds the fingerprint's bits."""
    kept = [c for c in docs.columns if c not in (text, into)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            found = np.array([fingerprint(x, words) for x in utf8(batch.column(text))], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(found.view(np.int64))], names=[*kept, into]
            )

    schema = T.StructType([*carried(docs, *kept), T.StructField(into, T.LongType())])
    return docs.select(*kept, text).mapInArrow(run, schema)


def _bits(values: np.ndarray, low: int, width: int) -> np.ndarray:
    return (values >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64)


def candidate_keys(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, key) for every key of every unsigned fingerprint."""
    owners, found = [], []
    for s, (low, width) in enumerate(SEGMENTS):
        owner, code = golay.keys(_bits(values, low, width), width)
        others = [b for t in range(3) if t != s for b in BLOCKS[t]]
        for k, (first, second) in enumerate(itertools.combinations(others, 2)):
            exact = _bits(values, *first) << second[1] | _bits(values, *second)
            owners.append(owner)
            found.append(((s * 6 + k) << 48) | (code << 32) | exact[owner])
    return np.concatenate(owners), np.concatenate(found)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(values), 1024):
            owner, key = candidate_keys(values[i : i + 1024])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(values[i : i + 1024][owner].view(np.int64))], names=["key", "fp"]
            )


def _forest(group: np.ndarray, most: int = MOST_BITS) -> list[tuple[int, int]]:
    """A spanning forest of the links within a group of different fingerprints."""
    words, forest, out = group.view(np.uint64), Forest(), []
    for i in range(0, len(words), 256):
        near = np.bitwise_count(words[i : i + 256, None] ^ words[None, i:]) <= most
        a, b = np.nonzero(near)
        apart = b > a
        for x, y in zip(group[i + a[apart]].tolist(), group[i + b[apart]].tolist()):
            if forest.join(x, y):
                out.append((x, y))
    return out


def _link_groups(batches: Iterator[pa.RecordBatch], most: int = DENSE) -> Iterator[pa.RecordBatch]:
    """Links within each run of equal keys; the members of a run of over ``most``, marked as such."""
    key_now, held, dense = None, [], False
    out: list[tuple[int, int, bool]] = []

    def flush() -> None:
        nonlocal held
        if dense:
            out.extend((x, x, True) for part in held for x in part.tolist())
        elif held:
            group = np.concatenate(held)
            out.extend((a, b, False) for a, b in _forest(group))
        held = []

    def rows() -> Iterator[pa.RecordBatch]:
        nonlocal out
        if out:
            u, v, d = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(d)], schema=_LINK)
            out = []

    for batch in batches:
        key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        edges = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.r_[0, edges], np.r_[edges, len(key)]
        last = len(starts) - 1
        for g in np.flatnonzero((ends - starts > 1) | (starts == 0) | (np.arange(last + 1) == last)):
            a, b = starts[g], ends[g]
            if key[a] != key_now:
                flush()
                key_now, dense = key[a], False
            held.append(fp[a:b])
            if sum(map(len, held)) > most:
                dense = True
            if dense:
                flush()
            elif 0 < g < last:
                flush()
        yield from rows()
    flush()
    yield from rows()


def _balls(dense: DataFrame) -> DataFrame:
    """Links among fingerprints of overfull groups, exactly and without comparing pairs.

    Two fingerprints are 4 bits apart or fewer just when some word is 2 bits or
    fewer from both. Each fingerprint names the 2081 words that near, and is
    linked to the smallest that names the same word: the work grows with the
    number of fingerprints, never with its square.
    """
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    masks = np.concatenate([np.zeros(1, np.uint64), bits, bits[i] | bits[j]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(values), 64):
                part = values[k : k + 64]
                ball = part[:, None] ^ masks[None, :]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ball.ravel().view(np.int64)), pa.array(np.repeat(part, len(masks)).view(np.int64))],
                    names=["ball", "fp"],
                )

    named = dense.select("fp").mapInArrow(run, "ball long, fp long")
    least = named.groupBy("ball").agg(F.min("fp").alias("v"), F.max("fp").alias("x")).where("v <> x")
    return named.join(least, "ball").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def links(fingerprints: DataFrame, column: str = "fp", partitions: int | None = None, most: int = DENSE) -> DataFrame:
    """Links (u, v) that connect all of the different fingerprints 4 bits or fewer apart.

    Enough links for each component, not each pair. ``fingerprints`` may repeat.
    """
    spark = fingerprints.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a fingerprint becomes some ninety keys: dealt out evenly first, as the few bytes of all would be read by few tasks
    distinct = fingerprints.select(F.col(column).alias("fp")).distinct().repartition(n)
    keys = distinct.mapInArrow(_emit_keys, "key long, fp long")
    grouped = keys.repartition(n, "key").sortWithinPartitions("key")
    found = cut(grouped.mapInArrow(lambda batches: _link_groups(batches, most), "u long, v long, dense boolean").distinct())
    dense = found.where("dense").select(F.col("u").alias("fp"))
    sparse = found.where("not dense").select("u", "v")
    return sparse if dense.isEmpty() else sparse.union(_balls(dense))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row.

    component_id is the smallest doc_id whose document is reachable through
    links of 4 or fewer differing bits, itself included. Null and blank texts
    have fingerprint zero and are linked like any other. Texts are taken
    whole, however long. A null doc_id is
    never the smallest unless all of a component are null, and then the
    component's id is null. Repeated rows are returned as often as they come;
    an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    prints = cut(with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))))
    named = classes(prints, F.col("doc_id"))
    return named.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id")
    )


def classes(prints: DataFrame, label: F.Column, small: bool | None = None) -> DataFrame:
    """``prints`` (staged) has fp; adds ``least``, the smallest label of each row's component.

    Copies without number share a fingerprint, and fingerprints without number
    a component: both are looked up as hot keys.
    """
    least = cut(prints.groupBy("fp").agg(F.min(label).alias("own"), F.count("*").alias("rows")))
    roots = components(links(least.select("fp")), small=small)
    rooted = least.join(roots, least["fp"] == roots["node"], "left")
    rooted = cut(rooted.select("fp", "own", "rows", F.coalesce("root", "fp").alias("root")))
    by_root = cut(rooted.groupBy("root").agg(F.min("own").alias("least"), F.count("*").alias("prints")))
    table = cut(looked_up(rooted.select("fp", "rows", "root"), by_root, "root", "prints", small).select("fp", "rows", "least"))
    return looked_up(prints, table, "fp", "rows", small)


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps one document: that with the
    smallest doc_id (nulls last), and among rows that repeat it, the first in the table.

    Null, blank and very long texts as in ``near_duplicates``. Other columns
    are handed on, whatever their names. ``docs`` should be a table read from
    files, so that its rows have the same places when they are read twice.
    """
    row = free("row", *docs.columns)
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    narrow = placed.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(row).alias("row"))
    prints = cut(with_fingerprints(narrow, "text", "fp"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    go = classes(prints, order).where(F.col("least")["row"] != F.col("row")).select(F.col("row").alias(row))
    return placed.join(cut(go), row, "left_anti").drop(row)
