import textwrap
from collections import Counter

from helpers import docs

from pagemill.llm import quality_rules

SPACE = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    words = text.encode().split()
    words = [w.decode() for w in words]
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def prose(n, k=0):
    return "\n".join(" ".join(f"w{k}{i}x{j}" for j in range(10)).capitalize() + "." for i in range(n))


def fixture():
    return [
        (1, None, "a"), (2, "", "a"), (3, " \n\t\x0b ", "a"), (4, "a b c a b c a b", "a"), (5, prose(10), "a"),
        (6, prose(6) + "\n" + prose(6), "a"), (7, "x y z " * 30000, "a"), (8, prose(9, "é") + "\n\n \n b c", "a"),
        (9, "one | two | three | four\n" * 30 + prose(8), "a"), (10, prose(8) + "\nWe use cookies, see our privacy policy.", "a"),
        (11, "\n".join(f"W{i}A!! SHOUT{i}!! LOUD{i * i}!! TEXT{i * 7}!!" for i in range(20)), "a"), (None, prose(7, "n"), None),
        (12, " ".join(f"s{i}###" for i in range(90)) + ".", "a"), (12, " ".join(f"s{i}###" for i in range(90)) + ".", "a"),
        (13, "\n".join(f"item {i} of a list without any end" for i in range(20)), "a"), (14, prose(2000, "long"), "b"),
    ]


def test_base_equals_brute_force(spark):
    rows = fixture()
    df = docs(spark, rows).selectExpr("*", "'x' as kept", "1 as n_words", "2 as lines")
    got = [tuple(r) for r in quality_rules.verdicts(df).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([r[:7] for r in got], key=order) == sorted([(i, *brute(t)) for i, t, _ in rows], key=order)
    kept = {r[0] for r in got if r[7]}
    assert kept == {5, 8, 10, 14, None}
    assert not any(r[6] and r[7] for r in got)


def test_texts_with_few_and_many_repeats(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = []
    for i in range(60):
        words = [f"v{x}" for x in rng.integers(0, (3, 12, 60, 4000)[i % 4], int(rng.integers(1, 400)))]
        rows.append((i, " ".join(words), "a"))
    got = [tuple(r)[:7] for r in quality_rules.verdicts(docs(spark, rows)).collect()]
    assert sorted(got) == sorted((i, *brute(t)) for i, t, _ in rows)


def test_clashing_helpers_are_handed_on(spark):
    names = ["words", "lines", "Full", "width", "stay", "windows", "twice", "at", "chars"]
    df = docs(spark, fixture()).selectExpr("*", *(f"'{n}!' as {n}" for n in names))
    for out in (quality_rules.judged(df), quality_rules.accepted(df)):
        assert all(r[n] == f"{n}!" for r in out.collect() for n in names)


def test_cleaned_text_and_columns(spark):
    out = quality_rules.judged(docs(spark, fixture()))
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[10]["clean_text"] == prose(8) and by[10]["n_lines_removed"] == 1
    assert by[5]["clean_text"] == prose(10) and by[5]["lost_share"] == 0


def sentences(n, k=0, end="."):
    return ["Some " + " ".join(f"word{k}{i}x{j * j}" for j in range(23)) + " and so on" + end for i in range(n)]


def test_wrapped_prose_and_other_scripts_are_whole(spark):
    wrapped = ["\n".join(textwrap.fill(x, w) for x in sentences(9)) for w in (40, 72, 100)]
    parted = "\n\n".join(textwrap.fill(x, 72) for x in sentences(9, "p"))
    unended = "\n".join(textwrap.fill(x, 72) for x in sentences(9, "u", ""))
    mixed = wrapped[1] + "\n\nhome page of this site and of others\n\n" + parted
    texts = [*wrapped, parted, *("\n".join(sentences(9, i, end)) for i, end in enumerate("।؟۔።။")), unended, mixed]
    by = {r["doc_id"]: r for r in quality_rules.judged(docs(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    assert [i for i in by if not by[i]["kept"]] == [9]
    assert all(by[i]["clean_text"] == texts[i] for i in range(9))
    assert by[10]["n_lines_removed"] == 1 and "home page" not in by[10]["clean_text"]


def test_empty(spark):
    assert quality_rules.verdicts(docs(spark, [])).count() == 0
