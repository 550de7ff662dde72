"""From a page's analysis to what is done with it.

Routes are a plain column, but work that costs model calls hangs on filtered
branches that are put together again: Spark evaluates Python in a CASE WHEN
for every row, whatever the branch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.text import strip_fences
from pagemill.operators.prompts import CONFIDENT, markdown_prompt, simple_prompt
from pagemill.schema import FLAGS, RAW_ANALYSIS

BLANK, DIRECT, TAILORED, FALLBACK, SIMPLE, FAILED = "blank", "direct", "tailored", "fallback", "simple", "failed"
#: The provider whose confident analyses spare the second call.
SHORTCUT_PROVIDER = "ollama"


def parse_analysis(reply: Column) -> Column:
    """The analysis of a JSON reply, fenced or not, as a struct of strings; fields it hasn't are null."""
    return F.from_json(strip_fences(reply), RAW_ANALYSIS)


def is_valid(analysis: Column) -> Column:
    """Whether an analysis has all six fields, flags that are Yes or No, and a number for its confidence."""
    ok = analysis["extracted_text"].isNotNull() & analysis["confidence_score_text"].try_cast("double").isNotNull()
    for flag in FLAGS:
        ok = ok & analysis[flag].isin("Yes", "No")
    return F.coalesce(ok, F.lit(False))


def route(analysis: Column, valid: Column, provider: str, image_mode: str | None, detailed: bool = True) -> Column:
    """Which way a page goes, by the rules in their order."""
    if not detailed:
        return F.lit(SIMPLE)
    no_figures = (analysis["images_detected"] == "No") | F.lit(image_mode is None)
    plain = (analysis["tables_detected"] == "No") & (analysis["latex_equations_detected"] == "No") & no_figures
    sure = analysis["confidence_score_text"].try_cast("double") > CONFIDENT
    return (
        F.when(~valid, FALLBACK)
        .when(analysis["text_detected"] == "No", BLANK)
        .when(F.lit(provider == SHORTCUT_PROVIDER) & sure & plain, DIRECT)
        .otherwise(TAILORED)
    )


def wants_figures(analysis: Column, image_mode: str | None) -> Column:
    return (analysis["images_detected"] == "Yes") & F.lit(image_mode is not None)


def model_calls(route_of: Column) -> Column:
    """Calls that a page takes by its route, the analysis included."""
    return F.when(route_of == FAILED, 0).when(route_of.isin(BLANK, DIRECT, SIMPLE), 1).otherwise(2)


def sticky_failures(failed: Column, document: str, page: str) -> Column:
    """For each page, whether its document has had a failed analysis up to it."""
    upto = W.partitionBy(document).orderBy(page).rowsBetween(W.unboundedPreceding, W.currentRow)
    return F.max(failed).over(upto)


def with_routes(
    pages: DataFrame, provider: str, image_mode: str | None = None, detailed: bool = True, custom_prompt: str | None = None,
    fallback_scope: str = "page", document: str = "doc_id", page: str = "page_number",
) -> DataFrame:
    """``pages`` with a ``reply`` of the analysis gets analysis, route and prompt (null where no second call is made).

    A page with an ``error`` has failed before any call. One with a
    ``figure_error`` falls back if its figures are wanted.
    """
    df = pages.withColumn("analysis", parse_analysis(F.col("reply")))
    df = df.withColumn("valid", is_valid(F.col("analysis")))
    if fallback_scope == "document":
        df = df.withColumn("valid", ~sticky_failures(~F.col("valid"), document, page))
    a = F.col("analysis")
    way = route(a, F.col("valid"), provider, image_mode, detailed)
    if detailed and "figure_error" in pages.columns:
        way = F.when((way == TAILORED) & wants_figures(a, image_mode) & F.col("figure_error").isNotNull(), FALLBACK).otherwise(way)
    if "error" in pages.columns:
        way = F.when(F.col("error").isNotNull(), FAILED).otherwise(way)
    df = df.withColumn("route", way)
    tailored = markdown_prompt(
        a["extracted_text"], a["tables_detected"], a["latex_equations_detected"], a["confidence_score_text"].try_cast("double"), custom_prompt
    )
    prompt = F.when(F.col("route") == TAILORED, tailored).when(F.col("route").isin(FALLBACK, SIMPLE), simple_prompt(custom_prompt))
    return df.withColumn("prompt", prompt)


def converted(routed: DataFrame, describe: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``routed`` with ``markdown``. ``describe`` gets the rows that need a second call, and only
    those, and adds ``answer`` to them. Materialise ``routed`` first: each branch
    works it out anew, and filters that are pushed down parse the reply for each field."""
    said = F.when(F.col("route") == BLANK, "").when(F.col("route") == DIRECT, F.col("analysis")["extracted_text"])
    settled = routed.where(F.col("route").isin(BLANK, DIRECT, FAILED)).withColumn("markdown", said)
    asked = describe(routed.where(F.col("route").isin(TAILORED, FALLBACK, SIMPLE)))
    asked = asked.withColumn("markdown", strip_fences(F.col("answer"))).drop("answer")
    return settled.unionByName(asked)


def converted_inline(routed: DataFrame, answer: Column) -> DataFrame:
    """The same where the answer is a column expression: one pass, as the JVM evaluates a CASE's branches only where they hold."""
    way = F.col("route")
    direct = F.when(way == BLANK, "").when(way == DIRECT, F.col("analysis")["extracted_text"])
    return routed.withColumn("markdown", direct.otherwise(strip_fences(answer)))
