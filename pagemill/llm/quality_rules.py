"""Line-first cleaning: rules remove lines, then documents that lost too much text are rejected.

DataFrame functions only. Everything is computed inside a row, so nothing is
shuffled; a document's work grows with its length alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import BLANKS, free

SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, MOST_REPEATED = 50, 3, 50
#: Windows that repeat in a text: up to so many are looked for one by one.
FEW = 16
#: Separators that make a line a menu, and bullets that lead list lines of links.
MENU_FROM, SYMBOL_SHARE, SHOUT_FROM, PROSE_FROM = 3, 0.1, 20, 5
#: A text is hard-wrapped if the ends of a quarter of its lines lie within BAND columns.
BAND, BAND_SHARE = 24, 0.25
#: Marks that end a sentence in other scripts than those of ``ended`` (Unicode's Sentence_Terminal, and shad).
OTHER_ENDS = (
    r"\u0589\u061D-\u061F\u06D4\u0700-\u0702\u07F9\u0837\u0839\u083D\u083E\u0964\u0965\u0F0D\u0F0E\u104A\u104B\u1362\u1367\u1368"
    r"\u166E\u1735\u1736\u17D4\u17D5\u1803\u1809\u1944\u1945\u1AA8-\u1AAB\u1B5A\u1B5B\u1B5E\u1B5F\u1B7D\u1B7E\u1C3B\u1C3C\u1C7E\u1C7F"
    r"\u203C\u203D\u2047-\u2049\u2E2E\u2E3C\u2E53\u2E54\uA4FF\uA60E\uA60F\uA6F3\uA6F7\uA876\uA877\uA8CE\uA8CF\uA92F\uA9C8\uA9C9"
    r"\uAA5D-\uAA5F\uAAF0\uAAF1\uABEB\uFE12\uFE52\uFE56\uFE57\uFF0E\uFF61"
)
#: A document that loses more than this share of its characters is rejected.
MOST_LOST = 0.4
BOILERPLATE = (
    r"(?i)\b(privacy policy|cookie policy|terms of (use|service)|all rights reserved|enable javascript|"
    r"uses? cookies|accept (all )?cookies|sign up (now|for)|subscribe (now|to our)|click here|read more|"
    r"lorem ipsum|powered by|copyright \(c\)|skip to (main )?content)\b|©"
)


def words_of(text: Column) -> Column:
    """The words ``[^\x20\x09-\x0D]+`` of a text, in order; null has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+", -1))


def _count_of(text: Column, characters: str) -> Column:
    """How many of some characters a text has; they are only counted where there are any."""
    there = text.rlike(f"[{characters}]")
    return F.when(there, F.char_length(text) - F.char_length(F.translate(text, characters, ""))).otherwise(0)


def _ended(bare: Column) -> Column:
    """Whether a text ends as prose does, or holds a sentence's end."""
    last = F.substring(bare, -4, 4).rlike(rf"[.!?:;…。！？{OTHER_ENDS}][\"'”’»)\]]*$")
    return last | bare.rlike(rf"[.!?…。{OTHER_ENDS}][\"'”’»)\]]?\s")


def _stay(lines: Column, paragraph: Column | None = None) -> Column:
    """The lines that no rule removes. Each is bared once, as a lambda works out anew whatever it names twice."""
    bares = F.transform(lines, lambda x: F.btrim(x, F.lit(BLANKS)))
    return F.filter(F.zip_with(lines, bares, lambda x, bare: F.when(~_fails(bare, paragraph), x)), lambda x: x.isNotNull())


def _fails(bare: Column, paragraph: Column | None = None) -> Column:
    """Whether a line, without white space at its ends, is to go. Blank lines stay; they hold no text.

    A line of a hard-wrapped paragraph has an end if the paragraph has one.
    """
    n = F.char_length(bare)
    menu = _count_of(bare, "|»•›·") >= MENU_FROM
    symbols = _count_of(bare, SYMBOLS) > SYMBOL_SHARE * n
    shouting = (n >= SHOUT_FROM) & ~bare.rlike(r"\p{Ll}") & bare.rlike(r"\p{Lu}")
    unended = bare.rlike(r"^" + r"\S++\s++" * (PROSE_FROM - 1) + r"\S") & ~_ended(bare)
    if paragraph is not None:
        unended &= ~_ended(F.btrim(paragraph, F.lit(BLANKS)))
    code = F.substring(bare, -1, 1).isin("{", "}")
    return (n > 0) & (menu | symbols | shouting | unended | code | bare.rlike(BOILERPLATE))


def _width(full: str) -> Column:
    """The column at which a text is wrapped, from its lines that aren't blank; null if it isn't wrapped.

    That is the longest length with a quarter of the lines, and one more, at
    most BAND below it: paragraphs of a line each have lengths of all kinds.
    """
    lengths = F.sort_array(F.transform(full, lambda x: F.char_length(F.rtrim(x, F.lit(BLANKS)))), asc=False)
    peer = F.greatest(F.lit(1), F.floor(BAND_SHARE * F.size(full)).cast("int"))
    wide = F.filter(F.arrays_zip(lengths.alias("n"), F.slice(lengths, peer + 1, F.size(full)).alias("m")), lambda x: x["n"] - x["m"] <= BAND)
    return F.get(wide, F.lit(0))["n"]


def _paragraphs(lines: str, width: str) -> Column:
    """The paragraphs of a hard-wrapped text, their lines joined by line feeds.

    A line is carried on by the next if that one's first word had no room in
    it. Lines carried on aren't blank, so two line feeds part paragraphs only.
    """

    def marked(x: Column, i: Column) -> Column:
        after = F.btrim(F.get(lines, i + 1), F.lit(BLANKS))
        n = F.char_length(F.rtrim(x, F.lit(BLANKS)))
        word = F.char_length(F.regexp_extract(after, r"^\S*", 0))
        on = (F.btrim(x, F.lit(BLANKS)) != "") & (after != "") & (n <= F.col(width)) & (n + 1 + word > F.col(width))
        return F.when(on | (i == F.size(lines) - 1), x).otherwise(F.concat(x, F.lit("\n")))

    return F.split(F.array_join(F.transform(lines, marked), "\n"), "\n\n", -1)


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``clean_text`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_lines_removed, lost_share and kept.

    ``clean_text`` is the text less the lines that fail a rule: menus, lines of
    symbols, shouting, prose without an end mark (in hard-wrapped texts: lines
    of paragraphs without one), code, boilerplate phrases. base_failed: fewer than 50 words, or more than half of them in
    three-word windows that occur twice. kept: neither base_failed nor more
    than MOST_LOST of the characters (line feeds apart) lost. Null and empty
    texts have no words, fail and aren't kept; texts of any length are judged
    whole, inside their row. Repeated rows are judged alike; no rows give no
    rows; columns of the names above are replaced, others handed on whatever
    their names.
    """
    made = ["clean_text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    made += ["base_failed", "n_lines_removed", "lost_share", "kept"]
    given = [c for c in docs.columns if c.lower() not in made]
    # helper columns have names that no given column has
    words, lines, full, hashed, width, stay, windows, twice, again, ordered, places, chars = (
        free(x, *given, *made) for x in "words lines full hashed width stay windows twice again ordered places chars".split()
    )
    whole = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(*given).withColumns({words: words_of(F.col(text)), lines: F.split(whole, "\n", -1)})
    df = df.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
            "n_symbols": _count_of(whole, SYMBOLS).cast("long"),
            full: F.filter(lines, lambda x: F.btrim(x, F.lit(BLANKS)) != ""),
            hashed: F.transform(words, lambda w: F.xxhash64(w)),
        }
    ).drop(words)
    df = df.withColumn(width, _width(full))
    of_wrapped = F.flatten(F.transform(_paragraphs(lines, width), lambda p: _stay(F.split(p, "\n", -1), p)))
    alone = _stay(F.col(lines))
    df = df.withColumn(stay, F.when(F.col(width).isNull(), alone).otherwise(of_wrapped)).drop(width)
    n = F.col("n_words").cast("int") - (WINDOW - 1)
    each = F.slice(hashed, 1, n)
    for k in range(1, WINDOW):
        each = F.zip_with(each, F.slice(hashed, k + 1, n), lambda a, b: F.xxhash64(a, b))
    df = df.withColumns(
        {
            "n_dup_lines": (F.size(full) - F.size(F.array_distinct(full))).cast("long"),
            windows: F.when(n > 0, each).otherwise(F.array().cast("array<bigint>")),
            "clean_text": F.array_join(stay, "\n"),
            "n_lines_removed": (F.size(lines) - F.size(stay)).cast("long"),
            chars: F.char_length(whole) - F.size(lines) + 1,
        }
    ).drop(hashed, full, lines)
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    df = df.withColumn(twice, F.when(repeats, F.sort_array(windows)))
    df = df.withColumn(twice, F.array_distinct(F.filter(twice, lambda x, i: F.get(twice, i - 1) == x)))
    # a few windows that repeat are looked for; of many, all windows are sorted with their places
    several = F.size(twice) > FEW
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn(ordered, F.when(several, placed))
    of_many = F.filter(ordered, lambda x, k: (F.get(ordered, k - 1)["h"] == x["h"]) | (F.get(ordered, k + 1)["h"] == x["h"]))
    of_few = F.transform(windows, lambda h, i: F.when(F.array_contains(twice, h), i))
    df = df.withColumn(again, F.when(several, F.transform(of_many, lambda x: x["i"])).when(F.size(twice) > 0, of_few)).drop(ordered, windows, twice)
    df = df.withColumn(places, F.sort_array(F.filter(again, lambda i: i.isNotNull()))).drop(again)
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(
        places,
        start,
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop(places)
    few = F.col("n_words") < MIN_WORDS
    repeated = 100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    left = F.char_length("clean_text") - F.greatest(F.size(stay) - 1, F.lit(0))
    lost = F.when(F.col(chars) > 0, 1 - left / F.col(chars)).otherwise(F.lit(0.0))
    df = df.withColumns({"base_failed": few | repeated, "lost_share": lost})
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= MOST_LOST))
    return df.select(*given, *made)


def accepted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``judged`` that are kept.

    The filter hangs on a row's number, which keeps it above the projections
    that work the verdict out: pushed below them it would put their whole
    expressions into itself, and into their own lambdas, for each element anew.
    """
    at = free("at", *docs.columns, "clean_text", "n_words", "word_chars", "n_symbols", "kept")
    numbered = judged(docs, text).withColumn(at, F.monotonically_increasing_id())
    return numbered.where(F.col("kept") & (F.col(at) >= 0)).drop(at)


def verdicts(docs: DataFrame) -> DataFrame:
    """The counts and verdict of each document, without its text."""
    return judged(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_QUOTED = BOILERPLATE.replace("'", "''")
SQL = rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t
), g AS (
  SELECT rid, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), d AS (
  SELECT rid, g FROM g GROUP BY ALL HAVING count(*) > 1
), r AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM g JOIN d USING (rid, g), range(0, 3) AS x(k) GROUP BY rid
), l AS (
  SELECT rid, l, trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS b FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM t)
), f AS (
  SELECT *, b <> '' AND (
    length(b) - length(translate(b, '|»•›·', '')) >= {MENU_FROM}
    OR length(b) - length(translate(b, '{SYMBOLS}', '')) > {SYMBOL_SHARE}::DOUBLE * length(b)
    OR (length(b) >= {SHOUT_FROM} AND NOT regexp_matches(b, '\p{{Ll}}') AND regexp_matches(b, '\p{{Lu}}'))
    OR (regexp_matches(b, '^(\S+\s+){{{PROSE_FROM - 1}}}\S')
      AND NOT regexp_matches(right(b, 4), '[.!?:;…。！？]["''”’»)\]]*$') AND NOT regexp_matches(b, '[.!?…。]["''”’»)\]]?\s'))
    OR right(b, 1) IN ('{{', '}}') OR regexp_matches(b, '{_QUOTED}')) AS fails FROM l
), s AS (
  SELECT rid, count(*) AS n, count(*) FILTER (b <> '') - count(DISTINCT l) FILTER (b <> '') AS dup,
    sum(length(l)) AS chars, coalesce(sum(length(l)) FILTER (NOT fails), 0) AS stay FROM f GROUP BY rid
), c AS (
  SELECT t.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols, s.dup::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, CASE WHEN s.chars > 0 THEN 1 - s.stay::DOUBLE / s.chars ELSE 0 END AS lost
  FROM t JOIN w USING (rid) JOIN s USING (rid) LEFT JOIN r USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND lost <= {MOST_LOST}::DOUBLE AS kept
FROM c
"""
