import itertools
import json

import pytest
from pyspark.sql import functions as F

from pagemill.functions.text import join_pages, strip_blanks, strip_fences, strip_page_label
from pagemill.operators import collect, prompts, routing


def reply(text="Yes", tables="No", images="No", latex="No", said="T", c=0.9):
    return json.dumps({"text_detected": text, "tables_detected": tables, "images_detected": images, "latex_equations_detected": latex, "extracted_text": said, "confidence_score_text": c})


def expected(t, tab, lx, im, c, mode, provider):
    if t == "No":
        return "blank"
    if provider == "ollama" and c > 0.6 and tab == "No" and lx == "No" and (im == "No" or mode is None):
        return "direct"
    return "tailored"


@pytest.mark.parametrize("provider", ["ollama", "openai"])
@pytest.mark.parametrize("mode", [None, "url"])
def test_truth_table(spark, provider, mode):
    cells = list(itertools.product(("Yes", "No"), ("Yes", "No"), ("Yes", "No"), ("Yes", "No"), (0.6, 0.61, 0.2)))
    rows = [(i, 0, reply(t, tab, im, lx, "T", c)) for i, (t, tab, lx, im, c) in enumerate(cells)]
    df = spark.createDataFrame(rows, "doc_id int, page_number int, reply string")
    got = {r["doc_id"]: r for r in routing.with_routes(df, provider, mode).collect()}
    for i, (t, tab, lx, im, c) in enumerate(cells):
        want = expected(t, tab, lx, im, c, mode, provider)
        assert got[i]["route"] == want
        assert (got[i]["prompt"] is not None) == (want == "tailored")
        if want == "tailored":
            assert (prompts.TABLES in got[i]["prompt"]) == (tab == "Yes")
            assert (prompts.LATEX in got[i]["prompt"]) == (lx == "Yes")
            assert (prompts.COMPARE in got[i]["prompt"]) == (c > 0.6)


def test_validity_and_fallback(spark):
    whole = json.loads(reply())
    cases = {"ok": reply(), "quoted": reply(c="0.9"), "none": None, "empty": "", "text": "no json", "word": reply(c="high"), "flag": reply(tables="maybe")}
    for field in whole:
        cases[f"without {field}"] = json.dumps({k: v for k, v in whole.items() if k != field})
    df = spark.createDataFrame([(k, 0, v) for k, v in cases.items()], "doc_id string, page_number int, reply string")
    got = {r["doc_id"]: r for r in routing.with_routes(df, "ollama", None, custom_prompt="").collect()}
    for k, r in got.items():
        assert r["route"] == ("direct" if k in ("ok", "quoted") else "fallback"), k
        if r["route"] == "fallback":
            assert prompts.TABLES in r["prompt"] and prompts.GENERIC in r["prompt"] and r["prompt"].endswith("\n")
    plain = routing.with_routes(df, "ollama", None, detailed=False).collect()
    assert {r["route"] for r in plain} == {"simple"}


def test_document_scope_is_sticky(spark):
    rows = [("a", i, reply() if i != 2 else "x") for i in range(5)] + [("b", i, reply()) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id string, page_number int, reply string")
    got = {(r["doc_id"], r["page_number"]): r["route"] for r in routing.with_routes(df, "ollama", fallback_scope="document").collect()}
    assert [got["a", i] for i in range(5)] == ["direct", "direct", "fallback", "fallback", "fallback"]
    assert {got["b", i] for i in range(3)} == {"direct"}


FENCES = {
    "plain": "plain", "```\na\n```": "a", "```markdown\na\nb\n``` c ```\nd\n```": "a\nb c d", "```markdown\nopen": "```markdown\nopen",
    "```python\nx\n```\ny\n```\nz": "```python\nx\ny\nz", "": "", "```\n\n```": "",
}


def test_text_functions(spark):
    df = spark.createDataFrame([(k, v) for k, v in FENCES.items()], "a string, b string")
    for r in df.select("b", strip_fences(F.col("a")).alias("c")).collect():
        assert r["c"] == r["b"]
    rows = [("Page 1\n\ttext Page 10 ", 0, "text 0"), (" é Page 2 ", 1, "é"), ("", 0, ""), (None, 0, None), ("😀 Page 3", 2, "😀")]
    for r in spark.createDataFrame(rows, "a string, p int, want string").select("want", strip_page_label(F.col("a"), F.col("p")).alias("got")).collect():
        assert r["got"] == r["want"]
    one = spark.range(1).select(join_pages(F.array(F.lit("a"), F.lit(None).cast("string"), F.lit(""), F.lit("b"))).alias("j"), strip_blanks(F.lit("\n x \t")).alias("s")).first()
    assert one["j"] == "a\n\n\n\n\n\nb" and one["s"] == "x"


def test_prompt_escapes_and_custom(spark):
    p = prompts.markdown_prompt(F.lit(" <a> & \"b\" 'c' "), F.lit("No"), F.lit("No"), F.lit(0.7), "be <brief>")
    got = spark.range(1).select(p.alias("p")).first()["p"]
    assert "\n&lt;a&gt; &amp; &#34;b&#34; &#39;c&#39;\n" in got and got.endswith("be &lt;brief&gt;")
    none = spark.range(1).select(prompts.simple_prompt(None).alias("p")).first()["p"]
    assert none.endswith(prompts.RULES)


def test_pages_are_collected_in_order(spark):
    rows = [("d", i, f"p{i}" if i % 4 else None) for i in (3, 0, 11, 2, 1, 10)]
    got = collect.documents(spark.createDataFrame(rows, "doc_id string, page_number int, markdown string")).first()
    assert got["pages"] == ["", "p1", "p2", "p3", "p10", "p11"] and got["markdown"] == "\n\np1\n\np2\n\np3\n\np10\n\np11"
    batches = [r[0] for r in spark.range(10).select(collect.batch_of(F.col("id"), 4)).collect()]
    assert batches == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]


def test_failed_pages_parse_each_reply_once(spark):
    """The branches of q23 read what was routed once; their filters used to parse the reply two dozen times each."""
    from pagemill.plans import catalogue

    plan = catalogue.QUERIES["q23_failed_pages"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "regexp_replace(to_json" not in plan
