"""Mixing sources to target weights by Pareto order sampling.

A source's documents are each due the same number of copies: target over size.
Its whole part is allocated for certain; the rest is an inclusion probability
p, and documents are ranked by the odds of a random number over the odds of p
(Rosen 1997). In that order they are taken as long as their words fit into
what the source still lacks, so the sample has a fixed size in words. What
then remains, less than the next document, is filled by the one document of
the rest whose size comes nearest to it, if any does better than none.

The order is found without sorting a source: ranks fall into bins, whose words
are summed with partial aggregation, and only the bin in which a source's
sample ends is looked into, in bins again until few rows are left. All that is
known of a source is one row, which is sent to the documents: a source with a
third of all rows is read like any other, and never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import cut, free, looked_up, n_words

WEIGHTS, MOST_COPIES, BINS, SEED = (5, 2, 1), 3, 8192, "mix-1"
#: Rows of a source's last bin that are ordered as they are; those of more are binned again.
FEW = 10_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``sizes`` has source and source_size, a row for each source; adds the double ``target``.

    Sources in order of their code points, null last, weigh ``weights`` in
    turn and share the sum of all sizes. None gets over ``most`` times its
    size: with sources in the order of size over weight, those before a point
    get just that, and the rest share what is left by weight; the point is the
    first where none of the rest is above (there the share is largest). Both windows order the distinct
    sources only.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    cap = (most * F.col("source_size")).cast("double")
    s = sizes.withColumn("weight", weight).withColumn("cap", cap)
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    every = W.partitionBy()
    s = (
        s.withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("capped", F.sum("cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("open", F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("share", (F.col("total") - F.coalesce("capped", F.lit(0.0))) / F.col("open"))
        .withColumn("share", F.max(F.when(F.col("share") * F.col("weight") <= F.col("cap"), F.col("share"))).over(every))
    )
    target = F.least("cap", F.coalesce(F.col("share") * F.col("weight"), F.col("cap")))
    return s.select("source", "source_size", target.alias("target"))


def odds(*key: Column, seed: str = SEED) -> Column:
    """U/(1-U) for a number between 0 and 1 that is drawn from the key, the same in each run."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(k.cast("string"), F.lit("-")) for k in key))
    drawn = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5
    return drawn / (F.lit(float(1 << 52)) - drawn)


def _key(source: Column) -> Column:
    """A source's key, which is never null: null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _rank(p: Column) -> Column:
    """The odds of a row's number over those of its inclusion."""
    return F.when(p > 0, F.col("u") / (p / (1 - p)))


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, bins: int = BINS, few: int = FEW) -> DataFrame:
    """What the mix takes of each source, from ``rows`` (k, source, size, u), which are staged.

    A staged row a source: k, rows (how many it has), source_size, target,
    whole (certain copies), p, ends (null if all ranks are in the sample), q_in
    (the last rank in it; null: those whose z = q / (1 + q) is under a), and
    q_fill (the rank of the document that fills it up).
    """
    sizes = rows.groupBy("k", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    known = cut(sizes)
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    made = targets(known.select("source", "source_size"), weights, most).withColumn("due", due)
    made = made.withColumn("whole", F.floor("due")).withColumn("p", F.col("due") - F.col("whole"))
    made = made.withColumn("lack", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("k", _key(F.col("source")))
    made = cut(made.join(known.select("k", "rows"), "k"))
    drawn = looked_up(rows.select("k", "size", "u"), made.select("k", "p", "lack", "rows"), "k", "rows").where("p > 0 and size > 0")
    drawn = cut(drawn.select("k", "size", "lack", _rank(F.col("p")).alias("q")))
    z = F.col("q") / (1 + F.col("q"))
    # the bin in which a source's sample ends, as the range [a, b] of z, the words before it, and the rows in it
    state = made.where("p > 0").select("k", "rows", F.lit(0.0).alias("a"), F.lit(1.0).alias("b"), F.lit(0).cast("long").alias("before"))
    settled = None
    while not state.isEmpty():
        inside = looked_up(drawn, state, "k", "rows").where((z >= F.col("a")) & (z <= F.col("b")))
        place = F.least(F.lit(bins - 1), F.floor((z - F.col("a")) / (F.col("b") - F.col("a")) * bins))
        each = inside.groupBy("k", place.alias("bin")).agg(
            F.sum("size").alias("words"), F.count("*").alias("n"), F.min(z).alias("a"), F.max(z).alias("b"),
            F.first("before").alias("before"), F.first("lack").alias("lack"),
        )
        upto = F.col("before") + F.sum("words").over(W.partitionBy("k").orderBy("bin"))
        last = each.withColumn("upto", upto).where("upto > lack and upto - words <= lack")
        last = cut(last.select("k", F.col("n").alias("rows"), "a", "b", (F.col("upto") - F.col("words")).alias("before")))
        done = (F.col("rows") <= few) | (F.col("a") >= F.col("b"))
        settled = last.where(done) if settled is None else settled.unionByName(last.where(done))
        state = last.where(~done)
    if settled is None:
        none = {"ends": "boolean", "q_in": "double", "a": "double", "q_fill": "double"}
        return made.withColumns({c: F.lit(None).cast(t) for c, t in none.items()}).drop("due", "lack")
    settled = cut(settled)
    inside = looked_up(drawn, settled, "k", "rows").where((z >= F.col("a")) & (z <= F.col("b")))
    tied = inside.groupBy("k", "q").agg(F.sum("size").alias("words"), F.first("lack").alias("lack"), F.first("before").alias("before"))
    upto = F.col("before") + F.sum("words").over(W.partitionBy("k").orderBy("q"))
    fits = F.col("upto") <= F.col("lack")
    ends = tied.withColumn("upto", upto).groupBy("k").agg(
        F.max(F.when(fits, F.col("q"))).alias("q_in"), (F.first("lack") - F.coalesce(F.max(F.when(fits, F.col("upto"))), F.first("before"))).alias("gap")
    )
    # the last rank that fits: inside the bin, or else just below it
    ends = ends.join(settled, "k").join(made.select("k", F.col("rows").alias("all")), "k")
    ends = cut(ends.select("k", "q_in", "gap", "a", F.col("all").alias("rows")))
    left = looked_up(drawn, ends, "k", "rows").where((z >= F.col("a")) & (F.col("q_in").isNull() | (F.col("q") > F.col("q_in"))))
    single = left.groupBy("k", "q").agg(F.sum("size").alias("words"), F.first("gap").alias("gap"))
    off = F.abs(F.col("gap") - F.col("words"))
    filled = single.where(off < F.col("gap")).groupBy("k").agg(F.min_by("q", F.struct(off, F.col("q"))).alias("q_fill"))
    # below a bin without a rank that fits, all ranks are taken: those under its least z
    ends = ends.join(filled, "k", "left").select("k", F.lit(True).alias("ends"), "q_in", "a", "q_fill")
    return cut(made.join(ends, "k", "left").drop("due", "lack"))


PLAN = ("whole", "p", "ends", "q_in", "a", "q_fill")


def _copies(named: dict[str, str], u: Column) -> Column:
    """How often a row is taken, from the columns (by ``named``) of its source's plan."""
    whole, p, ends, q_in, a, q_fill = (F.col(named[c]) for c in PLAN)
    q = F.when(p > 0, u / (p / (1 - p)))
    inside = F.when(q_in.isNull(), q / (1 + q) < a).otherwise(q <= q_in)
    extra = (p > 0) & (ends.isNull() | inside | F.coalesce(q == q_fill, F.lit(False)))
    return (whole + extra.cast("int")).cast("long")


def _rows(docs: DataFrame, words: Column, doc_id: str, source: str) -> DataFrame:
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), words.cast("long").alias("size"))
    return named.withColumn("u", odds(F.col("doc_id"), F.col("source"))).withColumn("k", _key(F.col("source")))


def mix(docs: DataFrame, size: Column | None = None, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies) of each row.

    ``size`` defaults to the words of ``text``, which is taken whole, however
    long. Null texts and texts without words have size 0 and are taken for 0
    words. Null is a source like any other. Rows with the same doc_id and
    source are drawn as one: all get a copy or none does. Sources without
    words have target 0. No rows give no rows. Other columns are ignored,
    whatever their names.
    """
    rows = cut(_rows(docs, n_words(F.col("text")) if size is None else size, doc_id, source))
    known = plan(rows)
    final = looked_up(rows, known.drop("source"), "k", "rows").withColumn("copies", _copies({c: c for c in PLAN}, F.col("u")))
    return final.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


def resampled(docs: DataFrame, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` (doc_id, text, source and others) as often as it is taken.

    Rows of size 0 add no words to the mix and are left out. Texts stay where
    they are: what is known of each source comes to them. Else as ``mix``;
    other columns are handed on, whatever their names.
    """
    words = n_words(F.col("text"))
    known = plan(cut(_rows(docs, words, doc_id, source)))
    given = docs.columns
    key, own = free("k", *given), free("taken", *given)
    columns = {c: free(f"{own}_{c}", *given) for c in PLAN}
    named = known.select(F.col("k").alias(key), F.col("rows").alias(own), *(F.col(c).alias(n) for c, n in columns.items()))
    found = looked_up(docs.withColumn(key, _key(F.col(source).cast("string"))), named, key, own)
    found = found.withColumn(own, _copies(columns, odds(F.col(doc_id), F.col(source).cast("string"))))
    found = found.where((F.col(own) > 0) & (words > 0))
    return found.withColumn(key, F.explode(F.sequence(F.lit(1), F.col(own).cast("int")))).select(*given)


SQL = """
WITH r AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(source, '-')), 1, 13) AS BIGINT)
      ::DOUBLE + 0.5 AS d
  FROM documents
), z AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source
), w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
    (3 * source_size)::DOUBLE AS cap FROM z
), c AS (
  SELECT *, (SELECT sum(source_size)::DOUBLE FROM z) AS total,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM w
), s AS (
  SELECT max((total - capped) / open) AS share FROM c WHERE (total - capped) / open * weight <= cap
), t AS (
  SELECT source, source_size, least(cap, coalesce(share * weight, cap)) AS target FROM c, s
), u AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS due FROM t
), v AS (
  SELECT *, floor(due) AS whole, due - floor(due) AS p, target - floor(due) * source_size AS lack FROM u
), q AS (
  SELECT r.doc_id, r.size, v.*, d / (4503599627370496.0::DOUBLE - d) / (p / (1 - p)) AS q FROM r JOIN v ON r.source IS NOT DISTINCT FROM v.source
), g AS (
  SELECT source, q, sum(size) AS words FROM q WHERE p > 0 AND size > 0 GROUP BY source, q
), h AS (
  SELECT g.*, v.lack, sum(g.words) OVER (PARTITION BY g.source ORDER BY g.q) AS upto FROM g JOIN v ON g.source IS NOT DISTINCT FROM v.source
), e AS (
  SELECT source, lack - coalesce(max(upto) FILTER (upto <= lack), 0) AS gap, any_value(lack) AS lack FROM h GROUP BY source, lack
), x AS (
  SELECT h.source, arg_min(h.q, {'o': abs(e.gap - h.words), 'q': h.q}) AS q_fill FROM h JOIN e ON h.source IS NOT DISTINCT FROM e.source
  WHERE h.upto > h.lack AND abs(e.gap - h.words) < e.gap GROUP BY h.source
)
SELECT q.doc_id, q.size::BIGINT AS size, q.source_size, q.target,
  (q.size * (whole + CASE WHEN p > 0 AND (h.upto <= h.lack OR coalesce(q.q = x.q_fill, false)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM q LEFT JOIN h ON q.source IS NOT DISTINCT FROM h.source AND q.q = h.q LEFT JOIN x ON q.source IS NOT DISTINCT FROM x.source
"""
