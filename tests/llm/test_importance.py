import math
from collections import Counter

import numpy as np
import pytest
from helpers import docs
from pyspark.sql import functions as F

from pagemill.llm import importance


def corpus(n=600):
    rng = np.random.default_rng(5)
    good = [f"alpha{i}" for i in range(200)]
    bad = [f"junk{i}###" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        words = good if i % 4 else bad
        rows.append((i, " ".join(rng.choice(words, int(rng.integers(20, 200)))), "s"))
        if i % 8 < 4:
            labels.append((i, int(i % 4 != 0), 0))
    return rows, labels


def test_ngrams_count_tokens_and_pairs():
    doc, bucket = importance.ngrams([b"One two, TWO one two", None, b"", b"one  two", "é日 x".encode(), b"x" * 5000])
    assert np.bincount(doc, minlength=6).tolist() == [6 + 5, 0, 0, 2 + 1, 2 + 1, 1]
    tokens = bucket[:6]
    assert tokens[0] == tokens[4] and tokens[1] == tokens[5] and tokens[1] != tokens[3]
    by_doc = {d: sorted(bucket[doc == d].tolist()) for d in (0, 3)}
    assert set(by_doc[3]) <= set(by_doc[0])
    alone = importance.ngrams([b"one  two"])[1]
    assert sorted(alone.tolist()) == by_doc[3]


@pytest.mark.parametrize("k", [1, 7, 250, 999, 1000])
def test_kth_largest(spark, k):
    rng = np.random.default_rng(k)
    values = np.r_[rng.normal(size=700) * 1e-6, rng.normal(size=200) * 1e3, np.full(100, 0.5)].tolist()
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert importance.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]


def test_held_out_documents_are_told_apart(spark):
    rows, labels = corpus()
    rows += [(None, "alpha1 alpha2 alpha3", "s"), (9000, None, "s"), (9001, "", "s"), (9002, "alpha5 " * 30000, "s"), (1, rows[1][1], "s")]
    df = docs(spark, rows).selectExpr("*", "1 as target", "2 as log_weight")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = importance.resample(df, lab)
    rs = got.collect()
    assert got.columns == ["doc_id", "log_weight", "gumbel_key", "kept"] and len(rs) == len(rows)
    known = {i for i, _, _ in labels}
    held = [r for r in rs if r["doc_id"] is not None and r["doc_id"] < 600 and r["doc_id"] not in known]
    right = sum(r["kept"] == (r["doc_id"] % 4 != 0) for r in held)
    assert len(held) > 200 and right >= 0.95 * len(held)
    good = sum(q == 1 for _, q, _ in labels) / len(labels)
    assert abs(sum(r["kept"] for r in rs) - good * len(rows)) <= 3
    again = {(r["doc_id"], r["gumbel_key"]) for r in importance.resample(df, lab).collect()}
    assert again == {(r["doc_id"], r["gumbel_key"]) for r in rs}


def brute(rows, labels):
    """Log weights from n-grams as text, without buckets; the regression is the library's."""
    good = {i for i, q, t in labels if q == 1 and not t}
    known = {i for i, _, _ in labels}
    grams = []
    for _, text, _ in rows:
        words = (text or "").lower().split()
        grams.append((words, list(zip(words, words[1:]))))
    raw, target = Counter(), Counter()
    for (i, _, _), (words, pairs) in zip(rows, grams):
        raw.update(words + pairs)
        if i in good:
            target.update(words + pairs)
    expected = sum(target.values()) / sum(raw.values())
    ratio = {g: math.log((target[g] + 1) / (n * expected + 1)) for g, n in raw.items()}
    x = []
    for words, pairs in grams:
        n, m = max(1, len(words + pairs)), max(1, len(words))
        against = sum(min(0, ratio[g] + 1) for g in words)
        x.append([sum(ratio[g] for g in words + pairs) / n, sum(ratio[g] for g in words) / m, against / m, sum(min(0, ratio[g] + 1) for g in pairs) / n, math.log1p(-against), math.log(n)])
    fit = [(a, float(r[0] in good)) for a, r in zip(x, rows) if r[0] in known]
    model = importance.calibrated(np.array([a for a, _ in fit]), np.array([b for _, b in fit]))
    prior = sum(b for _, b in fit) / len(fit)
    return [-math.log1p(math.exp(-(model[0] + model[1:] @ np.array(a)))) - math.log(prior) for a in x]


def test_weights_and_kept_set_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choice(words[:8] if i % 3 else words[4:], int(rng.integers(5, 40)))), "s") for i in range(200)] + [(900, "", "s")]
    labels = [(i, int(i % 3 != 0), int(i % 20 == 1)) for i in range(0, 200, 2)]
    want = brute(rows, labels)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in importance.resample(docs(spark, rows), lab, share=0.3).collect()}
    for (i, _, _), w in zip(rows, want):
        assert abs(got[i]["log_weight"] - w) < 1e-6
    noise = {r[0]: r[1] for r in docs(spark, rows).select("doc_id", importance.gumbel(F.col("doc_id"), F.lit(importance.SEED + 1))).collect()}
    keys = {i: w / importance.TEMPERATURE + noise[i] for (i, _, _), w in zip(rows, want)}
    top = set(sorted(keys, key=lambda i: -keys[i])[: round(0.3 * len(rows))])
    assert {i for i, r in got.items() if r["kept"]} == top
    plain = set(sorted(keys, key=lambda i: -got[i]["log_weight"])[: len(top)])
    assert len(top - plain) > 0.2 * len(top)  # noise has a say


def test_ties_at_the_cut_are_kept(spark):
    rows = [(7, "same text", "s")] * 6 + [(i, "other words here", "s") for i in range(20, 30)]
    lab = spark.createDataFrame([(20, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    got = importance.resample(docs(spark, rows), lab, share=1 / 16).collect()
    assert sum(r["kept"] for r in got) in (1, 6) and len({r["kept"] for r in got if r["doc_id"] == 7}) == 1


def test_inclusion_rates_follow_the_weights_over_seeds(spark):
    """The first drawn of Gumbel top-k is each document with its share of all weights."""
    weights = {0: 0.0, 1: 0.7, 2: 1.5, 3: -1.0}
    df = spark.createDataFrame(list(weights.items()), "doc_id long, w double").crossJoin(spark.range(4000).withColumnRenamed("id", "seed"))
    df = df.withColumn("key", F.col("w") + importance.gumbel(F.col("doc_id"), F.col("seed")))
    first = Counter(r["best"] for r in df.groupBy("seed").agg(F.max_by("doc_id", "key").alias("best")).collect())
    for i, w in weights.items():
        p = math.exp(w) / sum(map(math.exp, weights.values()))
        assert abs(first[i] / 4000 - p) < 4 * math.sqrt(p * (1 - p) / 4000)


def test_calibration_ends_where_the_slope_is_zero():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 2)) * [1, 100]
    y = (rng.random(500) < 1 / (1 + np.exp(-(x[:, 0] * 2 - x[:, 1] / 50)))).astype(float)
    model = importance.calibrated(x, y)
    p = 1 / (1 + np.exp(-(model[0] + x @ model[1:])))
    assert abs((p - y).sum()) < 1e-3 and np.abs(x.T @ (p - y) + importance.RIDGE * model[1:] * x.var(0)).max() < 1e-2
    assert np.isfinite(importance.calibrated(np.array([[0.0], [1.0]]), np.array([0.0, 1.0]))).all()  # classes that are wholly apart


def test_toxic_and_poor_documents_that_were_held_out_are_left(spark):
    """Labels of sf0.01, half of them held out."""
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000")
    lab = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("doc_id < 4000")
    got = importance.resample(df, lab.where("doc_id % 2 = 0")).join(lab.where("doc_id % 2 = 1"), "doc_id")
    rate = {(r["quality"], r["toxic"]): r["rate"] for r in got.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("rate")).collect()}
    assert rate[1, 0] > 0.85 and rate[0, 0] < 0.15 and rate[1, 1] < 0.45, rate


def test_without_labels_or_rows(spark):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["kept"] for r in importance.resample(docs(spark, [(1, "a b", "s"), (2, None, "s")]), lab).collect())
    assert importance.resample(docs(spark, []), lab).count() == 0
