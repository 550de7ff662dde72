from helpers import docs, duck, rows

from pagemill.llm import mixing

COLUMNS = ["doc_id", "size", "source_size", "target", "taken"]


def fixture():
    out = [(i, "w " * (5 + i % 17), "hot") for i in range(400)]
    out += [(1000 + i, "a b\tc\x0bd e", s) for i, s in enumerate(["b", "c", "d", "é", "z", None, None, ""] * 12)]
    out += [(2000, None, "b"), (2001, "", "empty"), (2002, " \n", "empty"), (None, "one two", "b"), (None, "one two", "b")]
    return out + [(3000, "long " * 20000, "long"), (5, "w " * 10, "hot"), (5, "w " * 10, "hot")]


def test_equals_sql_and_comes_near_its_targets(spark):
    df = docs(spark, fixture())
    got = mixing.mix(df.withColumn("q", df["doc_id"]).withColumn("target", df["text"]))
    assert rows(got.select(*COLUMNS)) == rows(duck(mixing.SQL, documents=df))
    by = {}
    for r in got.collect():
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    total = sum(r["size"] for x in by.values() for r in x)
    assert abs(sum(x[0]["target"] for x in by.values()) - total) < 1e-6 * total
    for x in by.values():
        assert x[0]["target"] <= 3 * x[0]["source_size"] + 1e-9
        off = abs(sum(r["taken"] for r in x) - x[0]["target"])
        assert off <= max(r["size"] for r in x) and (x[0]["source"] != "hot" or off <= 4)


def test_small_bins_and_shuffled_plans_change_nothing(spark):
    df = docs(spark, fixture())
    rows = mixing.cut(mixing._rows(df, mixing.n_words(df["text"]), "doc_id", "source"))
    want = sorted(map(str, mixing.plan(rows).collect()))
    assert sorted(map(str, mixing.plan(rows, bins=3, few=2).drop("a").collect())) == sorted(map(str, mixing.plan(rows).drop("a").collect()))
    assert len(want) == 10


def test_resampled_rows_come_as_often_as_taken(spark, tmp_path):
    docs(spark, fixture()).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d")).selectExpr("*", "1 as k", "'x' as taken", "doc_id as __row", "2.0 as P")
    out = mixing.resampled(df)
    assert out.columns == df.columns
    each = {}
    for r in out.collect():
        each[r["doc_id"], r["source"]] = each.get((r["doc_id"], r["source"]), 0) + 1
    want = {}
    for r in mixing.mix(df).collect():
        if r["taken"]:
            want[r["doc_id"], r["source"]] = want.get((r["doc_id"], r["source"]), 0) + r["copies"]
    assert each == want
    words = out.select(mixing.n_words(out["text"]).alias("n")).groupBy().sum("n").first()[0]
    total = df.select(mixing.n_words(df["text"]).alias("n")).groupBy().sum("n").first()[0]
    assert abs(words - total) < 25000


def test_empty_and_wordless(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix(docs(spark, [(1, None, None), (2, "", "a")])).collect()] == [0, 0]
