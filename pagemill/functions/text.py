"""Column functions on markdown: fences, page labels, escaping, page joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a reply's fenced blocks, untagged or tagged markdown, are replaced by their bodies.
FENCE = r"(?s)```(?:markdown)?\n(.*?)\n```"


def strip_fences(reply: Column) -> Column:
    """Every fenced block of a reply by its body."""
    return F.regexp_replace(reply, FENCE, "$1")


def escape_html(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def strip_blanks(text: Column) -> Column:
    """White space at both ends goes, line ends too."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_page_label(markdown: Column, page_number: Column) -> Column:
    """Each "Page n" of the page's own number (from 1) goes, inside longer numbers too, then blanks at the ends."""
    label = F.concat(F.lit("Page "), (page_number + 1).cast("string"))
    return strip_blanks(F.replace(markdown, label, F.lit("")))


def join_pages(pages: Column, separator: str = "\n\n") -> Column:
    """An ordered array of pages as one text; a page that is null counts as blank and keeps its separator."""
    return F.array_join(F.transform(pages, lambda p: F.coalesce(p, F.lit(""))), separator)
