"""Parsers run against a ground truth, several times each, and what comes out of it."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import scoring
from pagemill.sources.pdf import read_truth
from pagemill.sources.sinks import write_text

RESULT = "place int, parser string, run int, pages array<string>"


def pages_of(result: Any) -> list[str]:
    """A parser's result as pages: a list as it is, an object with ``text_content`` or any other as a single one."""
    if isinstance(result, list):
        return [str(p) for p in result]
    return [str(getattr(result, "text_content", result))]


def scored(results: DataFrame, truth: str) -> DataFrame:
    """(place, parser, avg_accuracy, num_runs, accuracy_scores) from ``results`` (as RESULT), in no order.

    ``truth`` is the text of one document, and part of the plan.
    """
    pairs = results.withColumns({"truth": F.lit(truth), "cand": scoring.result_text(F.col("pages"))})
    each = scoring.accuracy(pairs, ["place", "parser", "run"], "truth", "cand")
    return scoring.by_parser(each, order="place")


def compare(
    spark: SparkSession, parsers: Mapping[str, Callable[[str], Any]], path: str, truth_path: str, report_path: str | None = None,
    runs: int = 3, now: Callable[[], datetime] = datetime.now,
) -> DataFrame:
    """Each parser run ``runs`` times on the file at ``path``, scored, and listed in the order given; a report is written if asked for."""
    rows = []
    for place, (name, parse) in enumerate(parsers.items()):
        rows += [(place, name, run, pages_of(parse(path))) for run in range(1, runs + 1)]
    out = scored(spark.createDataFrame(rows, RESULT), read_truth(spark, truth_path).first()["text"]).orderBy("place")
    if report_path is not None:
        write_text(spark, report_path, scoring.report(out.collect(), now().strftime("%Y-%m-%d %H:%M:%S")))
    return out
