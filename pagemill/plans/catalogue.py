"""Named queries over the driver tables, and the SQL that gives the same rows.

The tables hold no PDF, image or model reply. Stand-ins: a page is a row of
``documents`` (a document of ordered pages one of ``conversations``); an
analysis is built from a row's text and id; a model answers with the page's
text in a fence; figure metrics come from numbers of ``lineitem``.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.config import Options, local_server_env, workers_for
from pagemill.errors import ModelCallError
from pagemill.functions import scoring
from pagemill.functions.text import strip_blanks, strip_fences, strip_page_label
from pagemill.operators import backends, collect, figures, holding, prompts, registry, routing
from pagemill.schema import REGION
from pagemill.sources import sinks
from pagemill.sources.pdf import LARGEST_UPLOAD, is_pdf
from pagemill.sources.staging import spread, written

#: Ground-truth items that are sent to every task at most.
MOST_SENT = 10_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def named(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLE_SQL[run.__name__] = sql
        return run

    return named


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def yes_no(c: Column) -> Column:
    return F.when(c, "Yes").otherwise("No")


def analysed(docs: DataFrame) -> DataFrame:
    """documents as pages with the JSON reply of a stand-in analysis; every 11th lacks a field."""
    d, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    said = {
        "text_detected": yes_no((d % 13 != 0) & (strip_blanks(text) != "")),
        "tables_detected": yes_no(F.contains(text, F.lit("|"))),
        "images_detected": yes_no(d % 3 == 0),
        "latex_equations_detected": F.when(d % 11 != 0, yes_no(F.contains(text, F.lit("$")))),
        "extracted_text": text,
        "confidence_score_text": ((d * 37) % 100 / 100.0).cast("string"),
    }
    reply = F.to_json(F.struct(*[c.alias(n) for n, c in said.items()]))
    return docs.select("doc_id", F.lit(0).alias("page_number"), "text", reply.alias("reply"))


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.with_routes(analysed(read(spark, sf_dir, "documents")), "ollama", "url")


ROUTED_SQL = """
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS text, doc_id % 11 = 0 AS broken,
    doc_id % 13 <> 0 AND regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') <> '' AS has_text,
    contains(coalesce(text, ''), '|') AS has_tables, contains(coalesce(text, ''), '$') AS has_latex,
    doc_id % 3 = 0 AS has_images, ((doc_id * 37) % 100) / 100.0::DOUBLE AS conf
  FROM documents
), r AS (
  SELECT *, CASE WHEN broken THEN 'fallback' WHEN NOT has_text THEN 'blank'
    WHEN conf > 0.6 AND NOT has_tables AND NOT has_latex AND NOT has_images THEN 'direct' ELSE 'tailored' END AS route
  FROM a
)
"""


@query(
    ROUTED_SQL
    + """SELECT doc_id, route, (CASE WHEN route IN ('blank', 'direct') THEN 1 ELSE 2 END)::INTEGER AS n_calls,
  CASE route WHEN 'blank' THEN '' WHEN 'direct' THEN text ELSE '# Page 1' || chr(10) || chr(10) || text END AS markdown FROM r"""
)
def q01_route_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat(F.lit("```markdown\n# Page 1\n\n"), F.col("text"), F.lit("\n```"))
    out = routing.converted_inline(routed(spark, sf_dir), answer)
    return out.select("doc_id", "route", routing.model_calls(F.col("route")).alias("n_calls"), "markdown")


@query(
    ROUTED_SQL
    + """SELECT route, has_images AND route = 'tailored' AS with_figures, count(*) AS n_pages,
  sum(CASE WHEN route IN ('blank', 'direct') THEN 1 ELSE 2 END)::BIGINT AS n_calls FROM r GROUP BY 1, 2"""
)
def q02_route_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures_too = routing.wants_figures(F.col("analysis"), "url") & (F.col("route") == routing.TAILORED)
    rows = routed(spark, sf_dir).select("route", figures_too.alias("with_figures"), routing.model_calls(F.col("route")).alias("n"))
    return rows.groupBy("route", "with_figures").agg(F.count("*").alias("n_pages"), F.sum("n").alias("n_calls"))


_FENCED = """CASE doc_id % 6 WHEN 0 THEN text WHEN 1 THEN '```markdown' || chr(10) || text || chr(10) || '```'
  WHEN 2 THEN '```' || chr(10) || text || chr(10) || '```' || chr(10) || 'and' || chr(10) || '```markdown' || chr(10) || 'more' || chr(10) || '```'
  WHEN 3 THEN '```python' || chr(10) || 'x' || chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10) || 'y' || chr(10) || '```'
  WHEN 4 THEN '```markdown' || chr(10) || text ELSE 'before ```' || chr(10) || text || chr(10) || '``` after' END"""


@query(
    f"SELECT doc_id, regexp_replace({_FENCED}, '```(?:markdown)?\\n(.*?)\\n```', '\\1', 'gs') AS markdown FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
)
def q03_fence_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.expr(_FENCED.replace("chr(10)", "'\\n'"))
    docs = read(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return docs.select("doc_id", strip_fences(reply).alias("markdown"))


_FORMS = (
    '{"text_detected":"Yes","tables_detected":"No","images_detected":"No","latex_equations_detected":"No","extracted_text":"a","confidence_score_text":0.75}',
    '{"text_detected":"Yes","tables_detected":"No","images_detected":"No","extracted_text":"a","confidence_score_text":0.75}',
    '{"text_detected":"Yes","tables_detected":"maybe","images_detected":"No","latex_equations_detected":"No","extracted_text":"a","confidence_score_text":0.75}',
    '{"text_detected":"No","tables_detected":"No","images_detected":"Yes","latex_equations_detected":"No","extracted_text":"","confidence_score_text":"0.5"}',
    "no json at all",
    "",
    '{"text_detected":"Yes","tables_detected":"No","images_detected":"No","latex_equations_detected":"No","extracted_text":"a","confidence_score_text":"high"}',
    '{"text_detected":null,"tables_detected":"No","images_detected":"No","latex_equations_detected":"No","extracted_text":"a","confidence_score_text":1}',
)
_FORM_SQL = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN {quoted(f)}" for i, f in enumerate(_FORMS)) + " END"


@query(
    f"""WITH f AS (SELECT doc_id, {_FORM_SQL} AS reply FROM documents), j AS (
  SELECT doc_id, CASE WHEN json_valid(reply) THEN reply ELSE '{{}}' END AS reply FROM f
), v AS (SELECT doc_id, coalesce("""
    + " AND ".join(f"(reply->>'{f}') IN ('Yes', 'No')" for f in routing.FLAGS)
    + """ AND (reply->>'extracted_text') IS NOT NULL AND try_cast(reply->>'confidence_score_text' AS DOUBLE) IS NOT NULL, false) AS valid,
  try_cast(reply->>'confidence_score_text' AS DOUBLE) AS c FROM j)
SELECT doc_id, valid, CASE WHEN valid THEN c END AS confidence FROM v"""
)
def q04_validate_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.expr(_FORM_SQL.replace("\\", "\\\\")).alias("reply"))
    docs = docs.withColumn("analysis", routing.parse_analysis(F.col("reply")))
    docs = docs.withColumn("valid", routing.is_valid(F.col("analysis")))
    sure = F.when(F.col("valid"), F.col("analysis")["confidence_score_text"].try_cast("double"))
    return docs.select("doc_id", "valid", sure.alias("confidence"))


_ESCAPED = "regexp_replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;'), '''', '&#39;'), '^\\s+|\\s+$', '', 'g')"


@query(
    ROUTED_SQL
    + f"""SELECT doc_id, CASE WHEN route IN ('tailored', 'fallback') THEN concat_ws(chr(10), {quoted(prompts.OPENING)},
  CASE WHEN route = 'tailored' AND conf > 0.6 THEN {quoted(prompts.COMPARE.rstrip())} || chr(10) || {_ESCAPED} ELSE {quoted(prompts.GENERIC)} END,
  CASE WHEN route = 'fallback' OR has_tables THEN {quoted(prompts.TABLES)} END,
  CASE WHEN route = 'tailored' AND has_latex THEN {quoted(prompts.LATEX)} END,
  {quoted(prompts.RULES)}, 'Keep &lt;br&gt; &amp; all &#34;marks&#34;.') END AS prompt FROM r"""
)
def q05_prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = analysed(read(spark, sf_dir, "documents"))
    return routing.with_routes(docs, "ollama", "url", custom_prompt='Keep <br> & all "marks".').select("doc_id", "prompt")


@query(
    """SELECT conv_id, turn, max(CASE WHEN (conv_id * 7 + turn) % 11 = 0 THEN 1 ELSE 0 END)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) = 1 AS simple FROM conversations"""
)
def q06_sticky_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "conversations")
    failed = (F.col("conv_id") * 7 + F.col("turn")) % 11 == 0
    return pages.select("conv_id", "turn", routing.sticky_failures(failed, "conv_id", "turn").alias("simple"))


@query(
    """SELECT conv_id, count(*)::INTEGER AS n_pages, string_agg(CASE WHEN turn % 5 = 3 THEN '' ELSE coalesce(text, '') END, chr(10) || chr(10) ORDER BY turn) AS markdown
  FROM conversations GROUP BY conv_id"""
)
def q07_page_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("turn") % 5 != 3, F.col("text")))
    out = collect.documents(pages, "conv_id", "turn", "text")
    return out.select("conv_id", F.size("pages").alias("n_pages"), "markdown")


@query(
    """SELECT conv_id, turn, regexp_replace(replace(chr(10) || 'Page ' || (turn + 1) || ' ' || coalesce(text, '') || ' Page ' || (turn + 1) || '0 ' || chr(9),
  'Page ' || (turn + 1), ''), '^\\s+|\\s+$', '', 'g') AS markdown FROM conversations"""
)
def q08_page_label_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.col("turn") + 1).cast("string")
    text = F.coalesce("text", F.lit(""))
    labelled = F.concat(F.lit("\nPage "), number, F.lit(" "), text, F.lit(" Page "), number, F.lit("0 \t"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", strip_page_label(labelled, F.col("turn")).alias("markdown"))


@query(
    """SELECT conv_id, turn // 4 AS batch_id, count(*) AS n_pages, min(turn) AS first_page, max(turn) AS last_page FROM conversations GROUP BY 1, 2"""
)
def q09_page_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "conversations").withColumn("batch_id", collect.batch_of(F.col("turn"), 4))
    return pages.groupBy("conv_id", "batch_id").agg(F.count("*").alias("n_pages"), F.min("turn").alias("first_page"), F.max("turn").alias("last_page"))


#: The SQL engine's edit distance counts bytes, ours characters. For SQL alone, the letters beyond ASCII that
#: the tables have are put as bytes that they haven't, one for one, which leaves every distance as it is.
_LETTERS = "ßàáâäçèéêíñóöúüÀÁÂÄÇÈÉÊÍÑÓÖÚÜ"
_BYTES = " || ".join(f"chr({i})" for i in (*range(1, 9), *range(14, 32), 127, 11, 12)[: len(_LETTERS)])


def in_bytes(column: str) -> str:
    return f"translate({column}, '{_LETTERS}', {_BYTES})"


def similarity_sql(a: str, b: str) -> str:
    longer = f"greatest(length({a}), length({b}))"
    return f"CASE WHEN {longer} = 0 THEN 1.0 ELSE 1 - levenshtein({in_bytes(a)}, {in_bytes(b)})::DOUBLE / {longer} END"


@query(
    f"""WITH b AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS place, count(*) OVER () AS n FROM benchmark)
SELECT d.doc_id, b.item_id, round({similarity_sql('b.text', "coalesce(d.text, '')")}, 6) AS similarity
  FROM documents d JOIN b ON b.place = (d.doc_id % n + n) % n"""
)
def q10_edit_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against an item of the whole ground truth: the one whose place is its id's remainder."""
    items = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("truth"))
    n = items.count()
    placed = items.withColumn("place", (F.row_number().over(W.orderBy("item_id")) - 1).cast("long"))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("cand"), F.pmod("doc_id", F.lit(n)).alias("place"))
    pairs = spread(docs).join(F.broadcast(placed) if n <= MOST_SENT else placed, "place")
    return pairs.select("doc_id", "item_id", F.round(scoring.edit_similarity(F.col("truth"), F.col("cand")), 6).alias("similarity"))


def bleu_sql(pairs: str, keys: str) -> str:
    """BLEU of a CTE ``pairs`` with the keys, truth and cand."""
    token = "'\\p{L}+|\\p{N}+|[^\\s\\p{L}\\p{N}]'"
    grams = "SELECT {keys}, n, array_to_string({side}[i:i+n-1], chr(1)) AS g, count(*) AS k FROM (SELECT *, unnest(range(1, len({side}) - n + 2)) AS i FROM tok, range(1, 5) AS x(n)) GROUP BY ALL"
    return f"""tok AS (SELECT {keys}, regexp_extract_all(lower(truth), {token}) AS t, regexp_extract_all(lower(cand), {token}) AS c FROM {pairs}
), gt AS ({grams.format(keys=keys, side="t")}
), gc AS ({grams.format(keys=keys, side="c")}
), ord AS (SELECT {keys}, n, sum(least(gc.k, coalesce(gt.k, 0))) AS hit, sum(gc.k) AS tot FROM gc LEFT JOIN gt USING ({keys}, n, g) GROUP BY ALL
), lg AS (SELECT {keys}, count(*) AS orders, sum(ln(hit::DOUBLE / tot)) AS logs FROM ord WHERE hit > 0 GROUP BY ALL
), bl AS (SELECT {keys}, CASE WHEN coalesce(orders, 0) < 4 THEN 0.0 ELSE
    (CASE WHEN len(c) > len(t) THEN 1.0 ELSE exp(1 - len(t)::DOUBLE / len(c)) END) * exp(logs / 4) END AS bleu FROM tok LEFT JOIN lg USING ({keys}))"""


@query(
    "WITH pairs AS (SELECT d.doc_id, b.item_id, b.text AS truth, d.text AS cand FROM documents d JOIN benchmark b ON contains(d.text, b.text)), "
    + bleu_sql("pairs", "doc_id, item_id")
    + " SELECT doc_id, item_id, round(bleu, 6) AS bleu FROM bl"
)
def q11_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("truth"))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("cand"))
    pairs = spread(holding.holders(docs, truth, "cand", "truth"))
    out = scoring.bleu(pairs, ["doc_id", "item_id"], "truth", "cand")
    return out.select("doc_id", "item_id", F.round("bleu", 6).alias("bleu"))


_RUNS = 3


@query(
    f"""WITH pairs AS (SELECT conv_id, turn, role, run, coalesce(text, '') AS truth,
    CASE (turn + run) % 3 WHEN 0 THEN text WHEN 1 THEN substr(text, 1, (length(text) * (9 - run)) // 10) ELSE replace(text, 'th', 'd' || run) END AS cand
  FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations), range(1, {_RUNS + 1}) AS r(run)), """
    + bleu_sql("pairs", "conv_id, turn, role, run")
    + f""", s AS (SELECT role AS parser, run, avg((bleu + {similarity_sql("truth", "cand")}) / 2) AS accuracy
  FROM bl JOIN pairs USING (conv_id, turn, role, run) GROUP BY ALL)
SELECT parser, round(avg(accuracy), 6) AS avg_accuracy, count(*)::INTEGER AS num_runs, array_to_string(list(printf('%.2f', accuracy) ORDER BY run), ', ') AS scores FROM s GROUP BY parser"""
)
def q12_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of conversations as truth, a role as parser, and an edit that depends on page and run as its result."""
    pages = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("truth"))
    runs = spread(pages).withColumn("run", F.explode(F.array(*[F.lit(i) for i in range(1, _RUNS + 1)])))
    n = F.char_length("truth")
    cut_off = F.substring(F.col("truth"), F.lit(1), F.floor(n * (9 - F.col("run")) / 10).cast("int"))
    other = F.replace(F.col("truth"), F.lit("th"), F.concat(F.lit("d"), F.col("run").cast("string")))
    kind = (F.col("turn") + F.col("run")) % 3
    pairs = runs.withColumn("cand", F.when(kind == 0, F.col("truth")).when(kind == 1, cut_off).otherwise(other))
    scored = scoring.accuracy(pairs, ["conv_id", "turn", "role", "run"], "truth", "cand")
    per_run = scored.groupBy(F.col("role").alias("parser"), "run").agg(F.avg("accuracy").alias("accuracy"))
    out = scoring.by_parser(per_run)
    scores = F.array_join(F.transform("accuracy_scores", lambda x: F.printf(F.lit("%.2f"), x)), ", ")
    return out.select("parser", F.round("avg_accuracy", 6).alias("avg_accuracy"), "num_runs", scores.alias("scores"))


_STATIC = {f"src{i}": p for i, p in enumerate(("ollama", "openai", "openai", "gemini", "gemini", "gemini"))}
_DYNAMIC = {f"src{i}": "ollama" for i in (4, 5, 6, 7, 12)}


def _values(models: dict[str, str]) -> str:
    return ", ".join(f"({quoted(m)}, {quoted(p)})" for m, p in models.items())


@query(
    f"""WITH s(model, sp) AS (VALUES {_values(_STATIC)}), d(model, dp) AS (VALUES {_values(_DYNAMIC)})
SELECT doc_id, source AS model, coalesce(sp, dp) AS provider, CASE WHEN sp IS NOT NULL THEN 'static' WHEN dp IS NOT NULL THEN 'dynamic' END AS resolved_by
FROM documents LEFT JOIN s ON s.model = source LEFT JOIN d ON d.model = source"""
)
def q13_registry_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("model"))
    return registry.resolve(asked, _STATIC, _DYNAMIC)


@query(
    """WITH m AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ['completion', 'vision'] WHEN 1 THEN ['completion'] WHEN 2 THEN [] END AS capabilities,
  CASE WHEN doc_id % 5 = 0 THEN ['llama', 'clip'] WHEN doc_id % 5 < 3 THEN ['llama'] END AS families FROM documents)
SELECT doc_id, coalesce(list_contains(capabilities, 'vision'), false) OR coalesce(list_contains(families, 'clip'), false) AS vision FROM m"""
)
def q14_vision_capable(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    strings = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    capabilities = F.when(d % 4 == 0, strings("completion", "vision")).when(d % 4 == 1, strings("completion")).when(d % 4 == 2, strings())
    families = F.when(d % 5 == 0, strings("llama", "clip")).when(d % 5 < 3, strings("llama"))
    return read(spark, sf_dir, "documents").select("doc_id", registry.takes_images(capabilities, families).alias("vision"))


_REGIONS = """SELECT l_orderkey AS doc_id, l_linenumber % 3 AS page_number, l_linenumber AS region, (l_quantity * 22)::INTEGER AS w, ((l_partkey % 60) * 18)::INTEGER AS h,
  1000::INTEGER AS page_w, 1000::INTEGER AS page_h, (l_suppkey % 40)::INTEGER AS y, (l_partkey % 50)::INTEGER AS x,
  l_discount * 1000 AS std, (l_partkey * 7 % 260)::DOUBLE AS mean, (l_partkey * 13 % 700)::DOUBLE AS lapvar,
  (l_quantity * 22) * ((l_partkey % 60) * 18) * (1 + l_suppkey % 9) / 10 AS area FROM lineitem"""
_ACCEPTED = "w >= 100 AND h >= 100 AND w <= 950 AND h <= 950 AND std > 25 AND mean > 20 AND mean < 235 AND area / (w * h) > 0.4 AND lapvar < 500"


def stand_in_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = _REGIONS.replace("::INTEGER", "").replace("::DOUBLE", "").split(" FROM ")[0].removeprefix("SELECT ")
    df = read(spark, sf_dir, "lineitem").selectExpr(*[x.strip() for x in whole.split(",\n")[0].split(", ")], *[x.strip() for line in whole.split(",\n")[1:] for x in line.split(", ")])
    return df.withColumns({c: F.col(c).cast("int") for c in ("w", "h", "page_w", "page_h", "y", "x")} | {c: F.col(c).cast("double") for c in ("mean", "lapvar", "area")})


@query(f"WITH g AS ({_REGIONS}) SELECT doc_id, page_number, region, w, h, area FROM g WHERE {_ACCEPTED}")
def q15_figure_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return figures.accepted(stand_in_regions(spark, sf_dir)).select("doc_id", "page_number", "region", "w", "h", "area")


_RANKED = f"""g AS ({_REGIONS}), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY area DESC, y, x, region) AS idx FROM g WHERE {_ACCEPTED})"""


def ranked_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = figures.accepted(stand_in_regions(spark, sf_dir))
    kept = kept.withColumn("x", F.struct("x", "region"))  # equal boxes are told apart by their number
    return figures.numbered(kept, ["doc_id", "page_number"])


@query(f"WITH {_RANKED} SELECT doc_id, page_number, region, idx, 'image_' || (page_number + 1) || '_' || idx || '.png' AS name FROM k")
def q16_figure_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = figures.figure_name(F.col("page_number"), F.col("idx"))
    return ranked_regions(spark, sf_dir).select("doc_id", "page_number", "region", "idx", name.alias("name"))


@query(
    f"""WITH {_RANKED}, n AS (SELECT doc_id, 'image_' || (page_number + 1) || '_' || idx || '.png' AS name, page_number, idx FROM k),
  f AS (SELECT doc_id, string_agg(chr(10) || chr(10) || '![' || name || '](' || name || ')', '' ORDER BY page_number, idx) AS links FROM n GROUP BY doc_id)
SELECT d.doc_id, coalesce(d.text, '') || coalesce(links, '') AS markdown FROM documents d LEFT JOIN f USING (doc_id)"""
)
def q17_figure_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = ranked_regions(spark, sf_dir).select(
        "doc_id", "page_number", "idx", figures.as_struct(figures.figure_name(F.col("page_number"), F.col("idx")), F.lit(None).cast("binary"), "url").alias("figure")
    )
    of_doc = named.groupBy("doc_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("page_number", "idx", "figure"))), lambda x: x["figure"]).alias("figures")
    )
    docs = read(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit(""))).join(of_doc, "doc_id", "left")
    return docs.select("doc_id", figures.append_figures(F.col("text"), F.col("figures")).alias("markdown"))


_CASES = [(cards, apple, cores) for cards in range(7) for apple in (False, True) for cores in (1, 2, 3, 4, 8, 64)]


@query(
    """WITH c AS (SELECT cards, apple, cores FROM range(0, 7) AS a(cards), (VALUES (false), (true)) AS b(apple), (VALUES (1), (2), (3), (4), (8), (64)) AS d(cores)),
  w AS (SELECT *, CASE WHEN cards > 0 THEN 'cuda' WHEN apple THEN 'mps' ELSE 'cpu' END AS device,
    CASE WHEN cards > 0 THEN least(2 * cards, 8) WHEN apple THEN 4 ELSE greatest(2, cores // 2) END::BIGINT AS workers FROM c)
SELECT cards::BIGINT AS cards, apple, cores::BIGINT AS cores, device, workers, dpi::BIGINT AS dpi, round(dpi / 72.0::DOUBLE * 2, 6) AS scale FROM w, range(72, 601, 24) AS p(dpi)"""
)
def q18_render_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(*case, *workers_for(*case)) for case in _CASES]
    cases = spark.createDataFrame(rows, "cards long, apple boolean, cores long, device string, workers long")
    dpis = cases.withColumn("dpi", F.explode(F.sequence(F.lit(72).cast("long"), F.lit(600).cast("long"), F.lit(24).cast("long"))))
    return dpis.withColumn("scale", F.round(F.col("dpi") / 72 * 2, 6))


@query(
    f"""WITH p AS (SELECT doc_id, '/in/' || coalesce(source, '') || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' WHEN 2 THEN '.txt' ELSE '.pdf.bak' END AS path,
  n_chars * 2048 AS length FROM documents)
SELECT doc_id, CASE WHEN NOT lower(path) LIKE '%.pdf' THEN 'unsupported' WHEN length > {LARGEST_UPLOAD} THEN 'too large' ELSE 'accepted' END AS verdict FROM p"""
)
def q19_source_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    suffix = F.when(d % 4 == 0, ".pdf").when(d % 4 == 1, ".PDF").when(d % 4 == 2, ".txt").otherwise(".pdf.bak")
    path = F.concat(F.lit("/in/"), F.coalesce("source", F.lit("")), F.lit("/"), d.cast("string"), suffix)
    verdict = F.when(~is_pdf(path), "unsupported").when(F.col("n_chars") * 2048 > LARGEST_UPLOAD, "too large").otherwise("accepted")
    return read(spark, sf_dir, "documents").select("doc_id", verdict.alias("verdict"))


@query(
    """SELECT item_id AS doc_id, 0 AS page_number, (30 + item_id % 40)::INTEGER AS x, (20 + item_id % 40)::INTEGER AS y, (110 + 2 * (item_id * 7 % 50))::INTEGER AS w,
  (120 + item_id * 7 % 50)::INTEGER AS h, 360 AS page_w, 420 AS page_h, ((109 + 2 * (item_id * 7 % 50)) * (119 + item_id * 7 % 50))::DOUBLE AS area, 1 AS idx FROM benchmark"""
)
def q20_figure_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures found in drawn pages, one for each ground-truth item: a textured box whose place and size follow the item's number."""
    cores = spark.sparkContext.defaultParallelism
    drawn = read(spark, sf_dir, "benchmark").repartition(cores, "item_id").selectExpr("item_id as id", "item_id % 40 as place", "item_id * 7 % 50 as size")

    def run(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for key, place, size in zip(batch["id"], batch["place"], batch["size"]):
                page = np.full((420, 360, 3), 255, np.uint8)
                h, w, y, x = 120 + int(size), 110 + 2 * int(size), 20 + int(place), 30 + int(place)
                fade = np.linspace(40, 180, w)[None, :, None] + np.linspace(0, 30, h)[:, None, None]
                page[y : y + h, x : x + w] = fade.astype(np.uint8)
                found = figures.regions(page, with_png=False)
                rows = [{"doc_id": key, "page_number": 0, **{k: v for k, v in r.items() if k != "png"}} for r in found]
                if rows:
                    yield pd.DataFrame(rows)

    schema = "doc_id long, page_number int, x int, y int, w int, h int, page_w int, page_h int, area double, mean double, std double, lapvar double"
    found = figures.numbered(figures.accepted(drawn.mapInPandas(run, schema)), ["doc_id", "page_number"])
    return found.select("doc_id", "page_number", "x", "y", "w", "h", "page_w", "page_h", "area", "idx")


_ANSWERS = "SELECT doc_id, 'page ' || doc_id AS prompt, CASE WHEN {failed} THEN NULL ELSE 'answer to page ' || doc_id END AS answer, CASE WHEN {failed} THEN 'ollama: no answer in time' END AS answer_error FROM documents"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("page "), F.col("doc_id").cast("string")).alias("prompt"))


def _reply(png: bytes | None, prompt: str, structured: bool) -> str:
    return f"answer to {prompt}"


@query(_ANSWERS.format(failed="doc_id % 10 = 0"))
def q21_retry_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a backend that times out: once for every third page, three times for every tenth."""

    def fails(prompt: str, attempt: int) -> bool:
        n = int(prompt.rpartition(" ")[2])
        return attempt <= (3 if n % 10 == 0 else 1 if n % 3 == 0 else 0)

    return backends.answers(_asked(spark, sf_dir), backends.Scripted(_reply, fails=fails), "answer", "prompt", mode="PERMISSIVE", sleep=_no_wait)


def _no_wait(seconds: float) -> None:
    """The clock of a test: no wait."""


@query(_ANSWERS.format(failed="false"))
def q22_concurrent_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that a batch's threads ask for: each page gets its own."""
    return backends.answers(_asked(spark, sf_dir), backends.Scripted(_reply), "answer", "prompt", mode="PERMISSIVE", concurrent=8)


@query(
    ROUTED_SQL
    + """, f AS (SELECT *, doc_id % 17 = 5 AS failed, doc_id % 4 = 1 AS unsearched FROM r),
  g AS (SELECT doc_id, text, CASE WHEN failed THEN 'failed' WHEN route = 'tailored' AND has_images AND unsearched THEN 'fallback' ELSE route END AS route FROM f)
SELECT doc_id, route, (CASE route WHEN 'failed' THEN 0 WHEN 'blank' THEN 1 WHEN 'direct' THEN 1 ELSE 2 END)::INTEGER AS n_calls,
  CASE route WHEN 'failed' THEN NULL WHEN 'blank' THEN '' WHEN 'direct' THEN text ELSE 'answer' END AS markdown,
  CASE WHEN route = 'failed' THEN 'page ' || doc_id || ': no page' END AS error FROM g"""
)
def q23_failed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that couldn't be rendered take no call and keep their error; those whose figures can't be searched fall back if figures are wanted."""
    d = F.col("doc_id")
    pages = analysed(read(spark, sf_dir, "documents")).withColumns(
        {
            "error": F.when(d % 17 == 5, F.concat(F.lit("page "), d.cast("string"), F.lit(": no page"))),
            "figure_error": F.when(d % 4 == 1, F.lit("odd raster")),
        }
    )
    routed_pages = routing.with_routes(pages, "ollama", "url").select("doc_id", "route", "error", "analysis")
    once = written(routed_pages, keep=False)  # as Converter does; else each branch's filter parses the reply for each field
    out = routing.converted(once, lambda rows: rows.withColumn("answer", F.lit("```\nanswer\n```")))
    return out.select("doc_id", "route", routing.model_calls(F.col("route")).alias("n_calls"), "markdown", "error")


@query(
    f"""SELECT doc_id, 'simple' AS route, 1::INTEGER AS n_calls, concat_ws(chr(10), {quoted(prompts.OPENING)}, {quoted(prompts.GENERIC)}, {quoted(prompts.TABLES)},
  {quoted(prompts.RULES)}, '') AS prompt FROM documents"""
)
def q24_simple_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without detailed extraction every page takes the simple prompt, and one call."""
    docs = analysed(read(spark, sf_dir, "documents"))
    out = routing.with_routes(docs, "openai", "url", detailed=False, custom_prompt="")
    return out.select("doc_id", "route", routing.model_calls(F.col("route")).alias("n_calls"), "prompt")


@query(
    f"""WITH f AS (SELECT doc_id, '```' || CASE WHEN doc_id % 2 = 0 THEN 'markdown' ELSE '' END || chr(10) || {_FORM_SQL} || chr(10) || '```' AS fenced, {_FORM_SQL} AS reply FROM documents),
j AS (SELECT doc_id, CASE WHEN json_valid(reply) THEN reply ELSE '{{}}' END AS reply FROM f)
SELECT doc_id, coalesce("""
    + " AND ".join(f"(reply->>'{f}') IN ('Yes', 'No')" for f in routing.FLAGS)
    + """ AND (reply->>'extracted_text') IS NOT NULL AND try_cast(reply->>'confidence_score_text' AS DOUBLE) IS NOT NULL, false) AS valid FROM j"""
)
def q25_fenced_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses in fences are as good as bare ones."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.expr(_FORM_SQL.replace("\\", "\\\\")).alias("reply"))
    tag = F.when(F.col("doc_id") % 2 == 0, "markdown").otherwise("")
    fenced = F.concat(F.lit("```"), tag, F.lit("\n"), F.col("reply"), F.lit("\n```"))
    return docs.select("doc_id", routing.is_valid(routing.parse_analysis(fenced)).alias("valid"))


@query(
    f"""WITH s(model) AS (VALUES {', '.join(f"({quoted(m)})" for m in _STATIC)}), d(model) AS (VALUES {', '.join(f"({quoted(m)})" for m in _DYNAMIC)})
SELECT source AS model, count(*) AS n_pages FROM documents WHERE source IS NOT NULL AND source NOT IN (SELECT model FROM s) AND source NOT IN (SELECT model FROM d) GROUP BY source"""
)
def q26_unknown_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models that neither registry knows, which a conversion would refuse, and the pages that ask for them."""
    asked = read(spark, sf_dir, "documents").select(F.col("source").alias("model")).where("model is not null")
    unknown = registry.resolve(asked, _STATIC, _DYNAMIC).where("provider is null")
    return unknown.groupBy("model").agg(F.count("*").alias("n_pages"))


@query("SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS result FROM conversations GROUP BY conv_id")
def q27_result_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parser's pages as the one text that is scored: joined by a line feed."""
    pages = read(spark, sf_dir, "conversations")
    out = collect.documents(pages, "conv_id", "turn", "text")
    return out.select("conv_id", scoring.result_text(F.col("pages")).alias("result"))


@query(
    f"""WITH g AS ({_REGIONS}), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY area DESC, y, x, region) AS idx FROM g WHERE {_ACCEPTED}),
  n AS (SELECT doc_id, page_number, idx, 'image_' || (page_number + 1) || '_' || idx || '.png' AS name, 'png of ' || doc_id || '/' || region AS png FROM k)
SELECT doc_id, page_number, idx, name AS by_url, name AS named, base64(encode(png)) AS data FROM n"""
)
def q28_figure_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures by name ("url"), or with their data as well ("base64")."""
    name = figures.figure_name(F.col("page_number"), F.col("idx"))
    png = F.encode(F.concat(F.lit("png of "), F.col("doc_id").cast("string"), F.lit("/"), F.col("region").cast("string")), "utf-8")
    both = ranked_regions(spark, sf_dir).withColumns({"url": figures.as_struct(name, png, "url"), "base64": figures.as_struct(name, png, "base64")})
    none = F.assert_true(F.col("url.base64_encoded").isNull())
    return both.select("doc_id", "page_number", "idx", F.coalesce(none.cast("string"), F.col("url.image_url")).alias("by_url"), F.col("base64.image_url").alias("named"), F.col("base64.base64_encoded").alias("data"))


@query(
    """WITH r AS (SELECT role, min(turn) AS place, count(*) AS n FROM conversations GROUP BY role)
SELECT place, role AS parser, 3::INTEGER AS num_runs, '0.50, 0.25, 1.00' AS scores, '0.58' AS mean FROM r"""
)
def q29_report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsers as rows of a report: in the order in which they ran, runs in theirs, two decimals."""
    runs = read(spark, sf_dir, "conversations").groupBy(F.col("role").alias("parser")).agg(F.min("turn").alias("place"))
    each = runs.withColumn("r", F.explode(F.array(*[F.struct(F.lit(i).alias("run"), F.lit(x).alias("accuracy")) for i, x in ((2, 0.25), (3, 1.0), (1, 0.5))])))
    out = scoring.by_parser(each.select("place", "parser", "r.*"), order="place")
    two = lambda x: F.printf(F.lit("%.2f"), x)
    return out.select("place", "parser", "num_runs", F.array_join(F.transform("accuracy_scores", two), ", ").alias("scores"), two(F.col("avg_accuracy")).alias("mean"))


@query(
    """WITH d AS (SELECT * FROM (VALUES ('cuda'), ('mps'), ('cpu')) AS a(device), (VALUES (2), (4), (8)) AS b(workers), (VALUES (false), (true)) AS c(concurrent)),
  s AS (SELECT *, 'OLLAMA_KEEP_ALIVE' AS name, '-1' AS value FROM d
    UNION ALL SELECT *, 'OLLAMA_NUM_GPU', CASE device WHEN 'cuda' THEN (workers // 2)::VARCHAR ELSE '1' END FROM d WHERE concurrent AND device <> 'cpu'
    UNION ALL SELECT *, 'OLLAMA_NUM_PARALLEL', (workers * CASE device WHEN 'cpu' THEN 10 ELSE 8 END)::VARCHAR FROM d WHERE concurrent
    UNION ALL SELECT *, 'OLLAMA_GPU_LAYERS', 'all' FROM d WHERE concurrent AND device = 'cuda'
    UNION ALL SELECT *, 'OLLAMA_NUM_THREAD', workers::VARCHAR FROM d WHERE concurrent AND device <> 'cuda')
SELECT device, workers::BIGINT AS workers, concurrent, name, value FROM s"""
)
def q30_server_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings of a local model server by device, workers and concurrency."""
    rows = [(d, w, c, n, v) for d in ("cuda", "mps", "cpu") for w in (2, 4, 8) for c in (False, True) for n, v in local_server_env(d, w, c).items()]
    return spark.createDataFrame(rows, "device string, workers long, concurrent boolean, name string, value string")


@query(
    """WITH p(provider, served) AS (VALUES ('openai', 'gpt-4o'), ('azure', 'mine')), s(structured) AS (VALUES (false), (true)), i(with_image) AS (VALUES (false), (true))
SELECT provider, structured, with_image, served, CASE WHEN structured THEN 0.0 ELSE 0.7 END::DOUBLE AS temperature, CASE WHEN structured THEN 0.4 ELSE 0.9 END::DOUBLE AS top_p,
  CASE WHEN structured THEN 'json_schema' END AS reply_format, CASE WHEN structured THEN NULL ELSE 9 END::BIGINT AS max_tokens, (1 + with_image::INTEGER)::BIGINT AS n_parts,
  CASE WHEN with_image THEN 'data:image/png;base64,' || base64(encode('png')) END AS image FROM p, s, i"""
)
def q31_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is asked of a provider: settings of free and structured calls, the deployment for the model, the image as data."""
    rows = []
    for name, config in (("openai", {}), ("azure", {"AZURE_ENDPOINT_URL": "e", "AZURE_OPENAI_API_KEY": "k", "AZURE_DEPLOYMENT_NAME": "mine"})):
        backend = backends.OpenAI("gpt-4o", config=config | {"AZURE_ENDPOINT_URL": config.get("AZURE_ENDPOINT_URL", "")}, top_p=0.9, extra={"max_tokens": 9})
        for structured in (False, True):
            for png in (None, b"png"):
                asked = backend.request(png, "prompt", structured)
                parts = asked["messages"][0]["content"]
                image = parts[1]["image_url"]["url"] if len(parts) > 1 else None
                rows.append((name, structured, png is not None, asked["model"], asked["temperature"], asked["top_p"], asked.get("response_format", {}).get("type"), asked.get("max_tokens"), len(parts), image))
    schema = "provider string, structured boolean, with_image boolean, served string, temperature double, top_p double, reply_format string, max_tokens long, n_parts long, image string"
    return spark.createDataFrame(rows, schema)


_FLAGS = "(VALUES (false), (true))"


@query(
    f"""SELECT detailed, former, mode, CASE WHEN detailed AND former OR mode NOT IN ('none', 'url', 'base64') THEN 'refused' WHEN former THEN 'deprecated' ELSE 'accepted' END AS verdict
FROM {_FLAGS} AS a(detailed), {_FLAGS} AS b(former), (VALUES ('none'), ('url'), ('base64'), ('jpeg')) AS c(mode)"""
)
def q32_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options that are accepted, accepted by a former name, or refused."""
    rows = []
    for detailed in (False, True):
        for former in (False, True):
            for mode in ("none", "url", "base64", "jpeg"):
                with warnings.catch_warnings(record=True) as told:
                    warnings.simplefilter("always")
                    try:
                        made = Options(detailed_extraction=detailed, extraction_complexity=former, image_mode=None if mode == "none" else mode)
                        assert made.detailed_extraction == (detailed or former)
                        verdict = "deprecated" if told else "accepted"
                    except ValueError:
                        verdict = "refused"
                rows.append((detailed, former, mode, verdict))
    return spark.createDataFrame(rows, "detailed boolean, former boolean, mode string, verdict string")


@query(f"SELECT with_key, endpoint, CASE WHEN with_key AND endpoint THEN 'azure' WHEN with_key OR endpoint THEN 'refused' ELSE 'openai' END AS served_by FROM {_FLAGS} AS a(with_key), {_FLAGS} AS b(endpoint)")
def q33_azure_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Azure needs its endpoint and its key; one alone is an error."""
    rows = []
    for key in (False, True):
        for endpoint in (False, True):
            config = {"AZURE_OPENAI_API_KEY": "k" if key else "", "AZURE_ENDPOINT_URL": "e" if endpoint else ""}
            backend = backends.OpenAI("gpt-4o", config=config)
            try:
                backend.check()
                served = "azure" if backend.azure else "openai"
            except ModelCallError:
                served = "refused"
            rows.append((key, endpoint, served))
    return spark.createDataFrame(rows, "with_key boolean, endpoint boolean, served_by string")


@query(
    "SELECT 'model' || i AS model, 'ollama' AS provider FROM range(0, 40) AS m(i) WHERE i % 7 <> 6 AND (i % 3 = 0 OR i % 5 = 0)"
)
def q34_discovered_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models of a stand-in server that take images, by what each says; every seventh can't be asked."""

    def show(name: str) -> dict:
        n = int(name.removeprefix("model"))
        if n % 7 == 6:
            raise OSError("no answer")
        return {"capabilities": ["vision"] if n % 3 == 0 else None, "details": {"families": ["clip"] if n % 5 == 0 else []}}

    found = registry.discovery(spark, lambda: [f"model{i}" for i in range(40)], show)()
    return spark.createDataFrame(sorted(found.items()), "model string, provider string")


@query(
    """SELECT item_id, 1::BIGINT AS n_figures, (110 + 2 * (item_id * 7 % 50))::BIGINT AS png_w, (120 + item_id * 7 % 50)::BIGINT AS png_h, 'image_' || (item_id % 5 + 1) || '_1.png' AS name,
  'doc_' || item_id || '.pdf-' || substr(md5('/in/doc ' || item_id || '.pdf'), 1, 8) AS folder FROM benchmark"""
)
def q35_figure_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of drawn pages as files: crops of the right size, under names that never meet; where they are written is a stand-in."""
    drawn = spread(read(spark, sf_dir, "benchmark")).selectExpr("item_id", "item_id % 40 as place", "item_id * 7 % 50 as size")

    def run(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for key, place, size in zip(batch["item_id"], batch["place"], batch["size"]):
                page = np.full((420, 360, 3), 255, np.uint8)
                h, w, y, x = 120 + int(size), 110 + 2 * int(size), 20 + int(place), 30 + int(place)
                page[y : y + h, x : x + w] = (np.linspace(40, 180, w)[None, :, None] + np.linspace(0, 30, h)[:, None, None]).astype(np.uint8)
                yield pd.DataFrame({"item_id": [key], "regions": [figures.regions(page)]})

    region = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in REGION.fields)
    pages = drawn.mapInPandas(run, f"item_id long, regions array<struct<{region}>>").select(
        "item_id", F.concat(F.lit("/in/doc "), F.col("item_id").cast("string"), F.lit(".pdf")).alias("doc_id"),
        (F.col("item_id") % 5).cast("int").alias("page_number"), figures.ranked_pngs(F.col("regions")).alias("pngs"),
    )
    size = lambda at: F.conv(F.hex(F.substring(F.element_at("pngs", 1), at, 4)), 16, 10).cast("long")
    sized = pages.select("*", F.size("pngs").cast("long").alias("n_figures"), size(17).alias("png_w"), size(21).alias("png_h"))
    out = sinks.with_figure_files(sized, "pngs", "stand-in", write=_nowhere)
    parts = F.split(F.col("figures")[0]["image_url"], "/")
    return out.select("item_id", "n_figures", "png_w", "png_h", parts[1].alias("name"), parts[0].alias("folder"))


def _nowhere(name: str, content: bytes) -> None:
    """The file system of a test."""


@query(
    """WITH r AS (SELECT row_number() OVER (ORDER BY role) AS i, role, min(turn) AS place FROM conversations GROUP BY role), n AS (SELECT count(*) AS k FROM r)
SELECT (4 + i)::BIGINT AS line, '| ' || i || ' | ' || role || ' | 0.50 |' AS said FROM r
UNION ALL SELECT (4 + k + (i - 1) * 7 + 2)::BIGINT, '## Runs of ' || role FROM r, n
UNION ALL SELECT (4 + k + (i - 1) * 7 + 6)::BIGINT, '| 1 | 0.25 |' FROM r, n
UNION ALL SELECT (4 + k + (i - 1) * 7 + 7)::BIGINT, '| 2 | 0.75 |' FROM r, n"""
)
def q36_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a report that hold results: the parsers' means, then the runs of each, two decimals."""
    parsers = read(spark, sf_dir, "conversations").select(F.col("role").alias("parser")).distinct()
    runs = parsers.withColumn("r", F.explode(F.array(*[F.struct(F.lit(i).alias("run"), F.lit(x).alias("accuracy")) for i, x in ((2, 0.75), (1, 0.25))])))
    rows = scoring.by_parser(runs.select("parser", "r.*")).orderBy("parser").collect()
    lines = enumerate(scoring.report(rows, "today").split("\n"), 1)
    held = [(i, x) for i, x in lines if x.startswith("## ") or x[:3] == "| 1" or x[:3] == "| 2" or (x.startswith("| ") and x[2:3].isdigit())]
    return spark.createDataFrame(held, "line long, said string")
