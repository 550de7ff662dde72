import math
from collections import Counter

import regex

from pagemill.functions import scoring


def bleu(truth, cand):
    t, c = (regex.findall(scoring.TOKEN, x.lower()) for x in (truth, cand))
    if not c:
        return 0.0
    logs = 0.0
    for n in range(1, 5):
        a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (t, c))
        hit = sum(min(k, a[g]) for g, k in b.items())
        if not hit:
            return 0.0
        logs += math.log(hit / sum(b.values()))
    return (1.0 if len(c) > len(t) else math.exp(1 - len(t) / len(c))) * math.exp(logs / 4)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


PAIRS = [("a b c d e f", "a b c d e f"), ("a b c d e f", ""), ("", ""), ("a b c", "x y z"), ("one two three", "one two three"), ("The cat, the dog 12!", "the cat. THE dog 12 !"),
         ("é à ü ß x y z w", "é a ü ß x y z w"), ("a a a a a a", "a a a a a a a a a"), ("one two three four five six", "one two three four five")]


def test_scores_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(PAIRS)], "i int, t string, c string")
    got = {r["i"]: r for r in scoring.accuracy(df, ["i"], "t", "c").collect()}
    assert len(got) == len(PAIRS)
    for i, (t, c) in enumerate(PAIRS):
        edit = 1 - distance(t, c) / max(len(t), len(c)) if t or c else 1.0
        assert abs(got[i]["bleu"] - bleu(t, c)) < 1e-9 and abs(got[i]["edit"] - edit) < 1e-9
        assert abs(got[i]["accuracy"] - (bleu(t, c) + edit) / 2) < 1e-9


def test_report(spark):
    runs = spark.createDataFrame([("p", 2, 0.5), ("p", 1, 0.25), ("q", 1, 1.0)], "parser string, run int, accuracy double")
    rows = scoring.by_parser(runs).orderBy("parser").collect()
    assert rows[0]["accuracy_scores"] == [0.25, 0.5] and rows[0]["num_runs"] == 2
    text = scoring.report(rows, "today")
    assert "| 1 | p | 0.38 |" in text and "| 2 | 0.50 |" in text and text.index("Runs of p") < text.index("Runs of q")


def test_results_of_pages_are_one_text(spark):
    df = spark.createDataFrame([(["a", None, "b"],), ([],), (None,)], "pages array<string>")
    assert [r[0] for r in df.select(scoring.result_text(df["pages"])).collect()] == ["a\n\nb", "", ""]


def test_scores_take_one_scan_and_no_shuffle(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d", None)], "i int, t string, c string").write.parquet(str(tmp_path / "p"))
    plan = scoring.accuracy(spark.read.parquet(str(tmp_path / "p")), ["i"], "t", "c")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_holders_equal_brute_force(spark, tmp_path):
    from pagemill.operators import holding

    texts = ["one two three four five six seven eight nine", "xone two three  four fivey", "", None, "aab", "three four five six seven\neight nine ten", "a b c"]
    items = ["two three four five six seven eight", "one two three  four five", "a", "", None, "b c", "three four five", "e two thr", "seven\neight nine", "one two three four five six seven eight nine"]
    spark.createDataFrame(list(enumerate(texts)), "i int, t string").write.parquet(str(tmp_path / "t"))
    spark.createDataFrame(list(enumerate(items)), "j int, x string").write.parquet(str(tmp_path / "x"))
    got = holding.holders(spark.read.parquet(str(tmp_path / "t")), spark.read.parquet(str(tmp_path / "x")), "t", "x").collect()
    want = [(i, j) for i, t in enumerate(texts) for j, x in enumerate(items) if t is not None and x is not None and x in t]
    assert sorted((r["i"], r["j"]) for r in got) == want


def odd_pairs(n=400):
    import random

    r = random.Random(7)
    word = lambda k, letters: "".join(r.choice(letters) for _ in range(r.randint(0, k)))
    for i in range(n):
        letters = ("ab", "abc dé.", "ab1 .,ß😀\n\x0b\x85Ⅷ²", "abcdefgh ij")[i % 4]
        a = word(60, letters)
        b = (word(60, letters), a[: r.randint(0, 60)], a.replace("ab", "x1"), word(6, letters + "QZ"), "".join(r.choice((c, c, c, "", "Q", c + c)) for c in a))[i % 5]
        yield (a, b) if r.random() < 0.5 else (b, a)


def test_batches_of_pairs_equal_brute_force():
    import pyarrow as pa

    from pagemill.functions import pairs

    t, c = zip(*odd_pairs(), *PAIRS, ("a b", None), (None, "a"), (None, None))
    found = pairs.distances(pa.array(t), pa.array(c)).to_pylist()
    assert found == [None if x is None or y is None else distance(x, y) for x, y in zip(t, c)]
    for got, x, y in zip(pairs.matches(pa.array(t), pa.array(c), 4).to_pylist(), t, c):
        x, y = (regex.findall(r"\p{L}+|\p{N}+|[^ \t-\r\p{L}\p{N}]", s or "") for s in (x, y))
        assert (got["nt"], got["nc"]) == (len(x), len(y))
        for n in range(1, 5):
            a, b = (Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1)) for s in (x, y))
            assert got[f"hit{n}"] == (a & b).total()
    assert len(pairs.matches(pa.array([], pa.string()), pa.array([], pa.string()), 4)) == 0


def test_large_pairs_are_scored_without_a_table(spark, monkeypatch):
    """Of texts with 300,000 characters, edited as q12 does; a table would have 90 billion cells."""
    from pagemill.functions import pairs

    text = "the path of the other text, " * 11_000
    monkeypatch.setattr(pairs, "_by_bits", None)
    assert [pairs.distance(text, c) for c in (text, text[:200_000], text.replace("th", "d1"))] == [0, len(text) - 200_000, 2 * text.count("th")]
    plan = scoring.accuracy(spark.createDataFrame([(1, "a", "b")], "i int, t string, c string"), ["i"], "t", "c")._jdf.queryExecution().executedPlan().toString()
    assert "levenshtein" not in plan and "aggregate(" not in plan


def test_items_found_in_order_need_no_table(monkeypatch):
    from pagemill.functions import pairs

    texts = [("the quick brown fox jumps over it " * 9000, "A fox, über the fox; over 12 quick jumps!"), ("xaby", "aQb"), ("ab" * 9, "ba" * 8 + "QQ"), ("ab" * 9, "Q" * 17), ("abcab", "cQQ"), ("abcabab", "cbaaQ")]
    wanted = [distance(a, b) if len(a) < 99 else len(a) - len(b) + sum(c not in a for c in b) for a, b in texts]
    assert [pairs.distance(a, b) for a, b in texts] == [pairs.distance(b, a) for a, b in texts] == wanted
    monkeypatch.setattr(pairs, "_by_bits", None)
    assert [pairs.distance(*texts[i]) for i in (0, 3)] == [wanted[i] for i in (0, 3)]
