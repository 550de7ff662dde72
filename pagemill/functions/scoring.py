"""Scores of a candidate text against the truth: sentence BLEU and edit similarity.

BLEU has uniform weights over 1 to 4-grams, no smoothing, and the brevity
penalty (Papineni et al. 2002). A text's tokens are runs of letters, runs of
digits and single other marks, in lower case; a reference tokenizer with rules
of its own gives other absolute values. If any order has no match the score is 0.

Both are column expressions: a pair is scored inside its row, in one pass and
without a shuffle. What is heavy, the edit distance and the count of n-grams in
common, is worked out by ``pairs`` in Arrow batches.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import pairs as in_batches

TOKEN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"
ORDERS = 4


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance, in characters, over the longer length; 1 for two empty texts."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.arrow_udf(in_batches.distances, "int")(a, b) / longer)


def _matches(truth: Column, candidate: Column) -> Column:
    """How many tokens both texts have, and how many n-grams of each order of the candidate are in the truth."""
    counts = ", ".join(f"{n}: int" for n in ("nt", "nc", *(f"hit{n}" for n in range(1, ORDERS + 1))))

    def matches(truth: pa.Array, candidate: pa.Array) -> pa.Array:
        return in_batches.matches(truth, candidate, ORDERS)

    return F.arrow_udf(matches, f"struct<{counts}>")(F.lower(truth), F.lower(candidate))


def bleu(pairs: DataFrame, keys: list[str], truth: str, candidate: str) -> DataFrame:
    """(keys, bleu) of each pair. A candidate without tokens, or without a match in some order, scores 0."""
    return with_bleu(pairs, truth, candidate).select(*keys, "bleu")


def with_bleu(pairs: DataFrame, truth: str, candidate: str, into: str = "bleu") -> DataFrame:
    """``pairs`` with the score; nulls count as empty texts."""
    found = f"{into}_matches"
    counted = pairs.withColumn(found, _matches(F.col(truth), F.col(candidate)))
    m = F.col(found)
    logs, every = F.lit(0.0), F.lit(True)
    for n in range(1, ORDERS + 1):
        hit = m[f"hit{n}"]
        every = every & (hit > 0)
        logs = logs + F.log(F.when(hit > 0, hit / (m["nc"] - (n - 1))))
    brevity = F.when(m["nc"] > m["nt"], 1.0).otherwise(F.exp(1 - m["nt"] / F.nullif(m["nc"], F.lit(0))))
    score = F.when(every, brevity * F.exp(logs / ORDERS)).otherwise(F.lit(0.0))
    return counted.withColumn(into, F.coalesce(score, F.lit(0.0))).drop(found)


def accuracy(pairs: DataFrame, keys: list[str], truth: str, candidate: str) -> DataFrame:
    """(keys, bleu, edit, accuracy): accuracy is the mean of both scores. Nulls count as empty texts."""
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    scored = with_bleu(pairs, truth, candidate).withColumn("edit", edit_similarity(text(truth), text(candidate)))
    return scored.select(*keys, "bleu", "edit").withColumn("accuracy", (F.col("bleu") + F.col("edit")) / 2)


def result_text(result: Column) -> Column:
    """A parser's result as one text: pages given as an array are joined by a line feed; null is empty."""
    return F.coalesce(F.array_join(F.transform(result, lambda p: F.coalesce(p, F.lit(""))), "\n"), F.lit(""))


def by_parser(runs: DataFrame, parser: str = "parser", run: str = "run", score: str = "accuracy", order: str | None = None) -> DataFrame:
    """(parser, avg_accuracy, num_runs, accuracy_scores in order of runs), and the least of ``order``, the
    parsers' order as run, if that is a column."""
    each = F.array_sort(F.collect_list(F.struct(F.col(run).alias("r"), F.col(score).alias("s"))))
    more = [F.min(order).alias(order)] if order else []
    return runs.groupBy(parser).agg(
        F.avg(score).alias("avg_accuracy"), F.count("*").cast("int").alias("num_runs"), F.transform(each, lambda x: x["s"]).alias("accuracy_scores"), *more
    )


def report(results: list, generated: str) -> str:
    """The results as markdown: a ranking's table first, then each parser's runs; two decimals."""
    lines = [f"# How close the parsers came ({generated})", "", "| | parser | mean score |", "| -: | :- | -: |"]
    lines += [f"| {i} | {r['parser']} | {r['avg_accuracy']:.2f} |" for i, r in enumerate(results, 1)]
    for r in results:
        lines += ["", f"## Runs of {r['parser']}", "", "| run | score |", "| -: | -: |"]
        lines += [f"| {i} | {x:.2f} |" for i, x in enumerate(r["accuracy_scores"], 1)]
    return "\n".join([*lines, ""])
