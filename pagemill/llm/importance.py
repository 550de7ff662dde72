"""Importance resampling: documents are drawn by how much more like a target text they are than the raw corpus.

Two generative models over hashed n-grams are counted: the target's from
labelled good documents (a bounded sample of labels), the raw one from every
document. From the log of their ratio, bucket by bucket, follow a few features
of a document: its means, and how much evidence there is against it. N-grams
aren't independent, so their plain sum says far too much; a logistic regression
on the labelled sample calibrates the features to the probability p that a
document is of the target. Its log weight is log(p / prior), the log of the
ratio of both texts' densities at the document, which can't be over that of
1 / prior, as the target's text is part of the raw one.

Documents are drawn without replacement by Gumbel top-k: the k largest of log
weight over temperature plus Gumbel noise. (Data Selection with Importance
Resampling, Xie et al. 2023.)

Counting and scoring hash whole batches of bytes with numpy; a task hands on
one vector of counts, so what is shuffled doesn't grow with a batch. The k-th
largest key is found by counting keys in bins, never by sorting in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import carried, cut, small_batches, utf8

#: Buckets of hashed tokens, and as many of pairs; labelled rows that the models are fitted on at most.
BUCKETS, MOST_LABELS, SEED = 1 << 18, 50_000, 11
#: Nats of log weight that weigh as much as one unit of Gumbel noise: under 1, the draw is sharper than the weights.
TEMPERATURE = 0.5
#: Log ratios below this are evidence against a document; strength of the regression's prior.
AGAINST, RIDGE = -1.0, 1.0
FEATURES = ("ratio", "token_ratio", "tokens_against", "pairs_against", "log_against", "log_size")
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Classes of bytes: 0 white space, 1 parts of words, 2 all other ASCII.
_CLASS = np.array([0 if chr(i) in " \t\n\x0b\x0c\r" else 1 if i >= 128 or chr(i).isalnum() else 2 for i in range(256)], np.uint8)
_FOLD = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def ngrams(texts: list[bytes | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every token, and then of every pair of neighbouring tokens, whose buckets
    come after those of tokens.

    Tokens are runs of letters, digits and bytes beyond ASCII, or runs of
    other marks. A-Z are folded, but a token with two or more capitals counts
    as another than the same in lower case.
    """
    data = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)
    lengths = np.array([len(t or b"") + 1 for t in texts])
    kind = _CLASS[data]
    first = np.flatnonzero((kind != 0) & np.r_[True, kind[1:] != kind[:-1]])
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = np.flatnonzero((kind != 0) & np.r_[kind[1:] != kind[:-1], True]) + 1
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(256, 0x100000001B3, np.uint64))
        starts = np.zeros(len(data), np.int64)
        starts[first] = 1
        within = np.arange(len(data)) - first[np.maximum(np.cumsum(starts) - 1, 0)]
        values = (_FOLD[data] + np.uint64(1)) * powers[within & 255]  # tokens over 256 bytes repeat their powers
        sums = np.r_[np.uint64(0), np.cumsum(values)]
        capitals = np.r_[0, np.cumsum((data >= 65) & (data <= 90))]
        shouted = (capitals[last] - capitals[first] >= 2).astype(np.uint64)
        token = _mixed(sums[last] - sums[first] + shouted * np.uint64(0xD6E8FEB86659FD93))
        doc = np.searchsorted(np.cumsum(lengths), first, side="right")
        pair = _mixed(token[:-1] * np.uint64(0xBF58476D1CE4E5B9) + token[1:])
    same = doc[:-1] == doc[1:]
    shift = np.uint64(64 - (buckets - 1).bit_length())
    docs = np.concatenate([doc, doc[:-1][same]])
    return docs, np.concatenate([(token >> shift).astype(np.int64), (pair[same] >> shift).astype(np.int64) + buckets])


def counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` has text and target (boolean, may be null). Returns bucket, raw and target counts over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(2 * buckets, np.int64), np.zeros(2 * buckets, np.int64)
        for whole in batches:
            for batch in small_batches([whole], "text", 1 << 20):
                doc, bucket = ngrams(utf8(batch.column("text")), buckets)
                raw += np.bincount(bucket, minlength=2 * buckets)
                good = np.array([bool(x) for x in batch.column("target").to_pylist()])
                target += np.bincount(bucket[good[doc]], minlength=2 * buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    per_task = docs.select("text", "target").mapInArrow(run, "bucket long, raw long, target long")
    return per_task.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(table: list, buckets: int = BUCKETS) -> np.ndarray:
    """log of target over raw probability of each bucket; one is added to each count of the target,
    and in proportion to those of the raw model, so that a bucket never seen says nothing."""
    raw, target = np.zeros(2 * buckets), np.zeros(2 * buckets)
    for r in table:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(2 * buckets)
    expected = raw / raw.sum() * target.sum()
    return np.log((target + 1) / (expected + 1))


def features(texts: list[bytes | None], ratios: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; a text without n-grams has zeros."""
    doc, bucket = ngrams(texts, len(ratios) // 2)
    r, token = ratios[bucket], bucket < len(ratios) // 2
    total = lambda values, some=slice(None): np.bincount(doc[some], weights=values[some], minlength=len(texts))
    n, n_tokens = np.maximum(np.bincount(doc, minlength=len(texts)), 1), np.maximum(np.bincount(doc[token], minlength=len(texts)), 1)
    below = np.minimum(r - AGAINST, 0)
    against = total(below, token)
    return np.stack([total(r) / n, total(r, token) / n_tokens, against / n_tokens, total(below, ~token) / n, np.log1p(-against), np.log(n)], axis=1)


def with_features(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """``docs`` without text, with FEATURES."""
    kept = [c for c in docs.columns if c != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # 2 x BUCKETS doubles, four megabytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches([whole], "text", 1 << 20):
                found = features(utf8(batch.column("text")), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in kept), *(pa.array(np.ascontiguousarray(x)) for x in found.T)], names=[*kept, *FEATURES]
                )

    schema = T.StructType([*carried(docs, *kept), *(T.StructField(f, T.DoubleType()) for f in FEATURES)])
    return docs.mapInArrow(run, schema)


def calibrated(x: np.ndarray, target: np.ndarray, rounds: int = 60) -> np.ndarray:
    """The intercept and slopes of a logistic regression with a ridge on the scaled slopes, by Newton's steps."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z, ridge = np.c_[np.ones(len(x)), (x - mean) / scale], np.r_[1e-6, np.full(x.shape[1], RIDGE)]
    w = np.zeros(z.shape[1])
    loss = lambda w: np.logaddexp(0, z @ w).sum() - target @ (z @ w) + ridge @ (w * w) / 2
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        slope = z.T @ (p - target) + ridge * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), slope)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-10:
            break
    slopes = w[1:] / scale
    return np.r_[w[0] - slopes @ mean, slopes]


def log_weight(model: np.ndarray, prior: float) -> Column:
    """log(p / prior) from FEATURES, where p is the regression's probability."""
    z = F.lit(float(model[0]))
    for w, f in zip(model[1:], FEATURES):
        z = z + F.lit(float(w)) * F.col(f)
    return -F.when(z > 0, F.log1p(F.exp(-z))).otherwise(F.log1p(F.exp(z)) - z) - F.lit(float(np.log(prior)))


def gumbel(doc_id: Column, seed: Column) -> Column:
    """Gumbel noise drawn from a row's id, the same in each run."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.coalesce(doc_id, F.lit(-1)), seed), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(uniform))


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest of a column of finite doubles, by counting in ever narrower bins.

    Each round is one aggregation to at most ``bins`` rows; it ends when a bin
    holds a single value.
    """
    low, high = df.agg(F.min(column), F.max(column)).first()
    above, value = 0, F.col(column)
    while low < high:
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            break
        place = F.least(F.lit(bins - 1), F.floor((value - low) / F.lit(width)))
        inside = df.where((value >= low) & (value <= high)).groupBy(place.alias("bin"))
        rows = inside.agg(F.count("*").alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).collect()
        for r in sorted(rows, key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                low, high = r["a"], r["b"]
                break
            above += r["n"]
    return low


def resample(
    docs: DataFrame, labels: DataFrame, share: float | None = None, temperature: float = TEMPERATURE, most_labels: int = MOST_LABELS,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, log_weight, gumbel_key, kept) of each row.

    The target is the text of labelled documents of quality 1 that aren't
    toxic; of more than ``most_labels`` labelled rows those with the smallest
    hashes of their ids are used. ``share`` of all rows are kept, by default
    the share of good ones among the labels used; rows that tie with the last
    kept one are kept too. Without labels, or none that are good, all weights
    are 0 and all rows are kept; where all are good, all weights are 0. Null
    and empty texts are weighed as texts that nothing is known of; texts of
    any length are read whole. Null doc_ids aren't labelled; a repeated row
    has the same key each time and is kept or left with its like. No rows give
    no rows. Other columns are ignored, whatever their names.
    """
    named = labels.where("doc_id is not null").select("doc_id", "quality", "toxic")
    picked = named.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(most_labels)
    good = (F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    picked = cut(picked.groupBy("doc_id").agg(F.min(good).alias("target")))
    n, of = picked.agg(F.count("*"), F.count_if("target")).first()
    given = docs.select(F.col("doc_id"), F.col("text"))
    marked = given.join(F.broadcast(picked), "doc_id", "left")  # at most ``most_labels`` rows
    ratios = log_ratios(counts(marked).collect())
    scored = cut(with_features(marked.select("doc_id", "target", "text"), ratios))
    # at most ``most_labels`` documents; a document that is there more often is fitted on once
    sample = scored.where("target is not null").groupBy("doc_id").agg(F.first("target").alias("target"), *(F.min(f).alias(f) for f in FEATURES))
    rows = sample.orderBy("doc_id").collect()
    weight = F.lit(0.0)
    if of and of < n and rows:
        x, y = np.array([[r[f] for f in FEATURES] for r in rows]), np.array([float(r["target"]) for r in rows])
        if 0 < y.sum() < len(y):
            weight = log_weight(calibrated(x, y), y.mean())
    scored = scored.select("doc_id", weight.alias("log_weight"))
    scored = cut(scored.withColumn("gumbel_key", F.col("log_weight") / temperature + gumbel(F.col("doc_id"), F.lit(seed + 1))))
    total = scored.count()
    if not total or not of:
        return scored.withColumn("kept", F.lit(True))
    k = max(1, round(total * (of / n if share is None else share)))
    return scored.withColumn("kept", F.col("gumbel_key") >= F.lit(kth_largest(scored, "gumbel_key", k)))
