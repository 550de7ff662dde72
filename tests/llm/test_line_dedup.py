from helpers import docs, duck, rows

from pagemill.llm import line_dedup


def fixture():
    out = [(i, f"own {i}\n  Shared LINE\t\nÄrger\n", "a") for i in range(12)]
    out += [(100 + i, f"nine {i}\nonly nine\n only NINE", "b") for i in range(9)]
    out += [(200, None, "a"), (201, "", None), (202, "\n\n", "a"), (203, "x\r\nshared line", "a"), (None, "shared line", "a")]
    out += [(204, "ärger\nÄRGER", "a"), (205, "\n".join(["shared line", "kept"] * 20000), "a"), (206, "only nine!", "a")]
    return out + [(100, "nine 0\nonly nine\n only NINE", "b")]  # a repeated row counts again


def test_equals_sql(spark, tmp_path):
    docs(spark, fixture()).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    assert rows(line_dedup.digest(df)) == rows(duck(line_dedup.SQL, documents=df))


def test_other_columns_stay_and_clashing_ones_are_replaced(spark):
    df = docs(spark, fixture()).selectExpr("*", "'x' as n_lines", "doc_id + 1 as __other")
    out = line_dedup.drop_frequent_lines(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "__other", "n_lines", "n_dropped"]
    got = {r["doc_id"]: r for r in out.collect() if r["doc_id"] is not None}
    assert got[203]["text"] == "x\r" and got[203]["n_dropped"] == 1
    assert got[205]["text"] == "\n".join(["kept"] * 20000)
    assert got[200]["text"] == "" and got[200]["n_lines"] == 1


def test_more_frequent_lines_than_are_sent(spark, tmp_path):
    docs(spark, fixture()).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d")).selectExpr("*", "doc_id as row", "text as AT", "1 as h")
    sent, shuffled = (sorted(map(str, line_dedup.drop_frequent_lines(df, most_sent=n).collect())) for n in (1000, 0))
    assert sent == shuffled


def test_keys_of_a_least_length(spark):
    df = docs(spark, [(i, "é\nab\nabc", "a") for i in range(10)])
    assert {r["text"] for r in line_dedup.drop_frequent_lines(df, min_chars=2).collect()} == {"é"}


def test_empty(spark):
    assert line_dedup.digest(docs(spark, [])).count() == 0
