"""Prompts as columns. The wording is our own; what it must ask for is fixed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import escape_html

CONFIDENT = 0.6
ANALYSIS = (
    "Look at the page image and answer with one JSON object and nothing else. Its fields: "
    '"text_detected", "tables_detected", "images_detected" and "latex_equations_detected", each "Yes" or "No"; '
    '"extracted_text", all text of the page in reading order; '
    '"confidence_score_text", a number from 0.0 to 1.0 that says how sure you are of the text.'
)
OPENING = "Write the page as markdown."
COMPARE = "A first pass read the text below. Hold it against the image, mend what differs and add what is missing.\n"
GENERIC = "Read all text of the image in reading order, headings, lists and emphasis included."
TABLES = "Tables: keep every row and column, as markdown tables with a header row."
LATEX = "Equations: inline ones between single dollar signs, displayed ones between double dollar signs, as LaTeX."
RULES = "Keep the structure of the page. Leave nothing out. Add no comments of your own. Use no code fences."


def markdown_prompt(
    extracted_text: Column, tables: Column, latex: Column, confidence: Column, custom: Column | str | None = None
) -> Column:
    """The second call's prompt. ``custom`` is added even if empty, but not if null."""
    text = F.regexp_replace(escape_html(extracted_text), r"^\s+|\s+$", "")
    custom = F.lit(custom) if custom is None or isinstance(custom, str) else custom
    return F.concat_ws(
        "\n",
        F.lit(OPENING),
        F.when(confidence > CONFIDENT, F.concat(F.lit(COMPARE), text)).otherwise(F.lit(GENERIC)),
        F.when(tables == "Yes", F.lit(TABLES)),
        F.when(latex == "Yes", F.lit(LATEX)),
        F.lit(RULES),
        F.when(custom.isNotNull(), escape_html(custom.cast("string"))),
    )


def simple_prompt(custom: Column | str | None = None) -> Column:
    """The prompt without an analysis: tables asked for, equations not, no text to compare."""
    return markdown_prompt(F.lit(""), F.lit("Yes"), F.lit("No"), F.lit(0.0), custom)
