import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from helpers import docs

from pagemill.llm import packing, simhash, tokens


def corpus():
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    line = lambda n: (" ".join(word() for _ in range(n)) + ".").capitalize()
    rows = []
    for i in range(60):
        text = "\n".join(line(12) for _ in range(12)) + ("\nShared by all of us." if i % 2 else "")
        rows.append((i, text, f"s{i % 4}"))
        if i % 10 == 0:
            rows += [(1000 + i, text, "s1"), (2000 + i, text + " Tail.", "s2")]
    rows += [(300, "one | two | three | four\n" * 40, "s0"), (301, None, "s0"), (302, "short.", None), (303, line(90), None), (60, "", "s9")]
    return rows


def test_stages_equal_brute_force(spark, tmp_path):
    rows = corpus()
    at = tmp_path / "sf"
    df = docs(spark, rows)
    df.write.parquet(str(at / "documents.parquet"))
    now, made = spark.read.parquet(str(at / "documents.parquet")), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, now, str(at))
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        made.append({r["doc_id"]: r["text"] for r in now.collect()})
        assert all(r["n_chars"] == len(r["text"]) for r in now.collect())
    text = {i: t for i, t, _ in rows}
    clean = {i for i in text if i < 60 or i >= 1000 or i == 303}
    assert set(made[0]) == clean and all(made[0][i] == text[i] for i in clean)
    want = {i: t.replace("\nShared by all of us.", "") for i, t in made[0].items()}
    assert made[1] == want
    prints = {i: simhash.fingerprint(t.encode()) for i, t in made[1].items()}
    stay = {i for i in prints if not any(j < i and (prints[i] ^ prints[j]).bit_count() <= 4 for j in prints)}
    assert set(made[2]) == stay and {0, 303} <= stay and 1000 not in stay
    assert set(made[3]) <= set(made[2])
    mixed = Counter(r["doc_id"] for r in now.collect())
    assert max(mixed.values()) <= 3
    words = tokens.load(tokens.vocabulary_path())
    total = sum(len(tokens.token_ids(words, made[3][i])) // 2 * n for i, n in mixed.items())
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, str(at)).collect()
    assert sum(r["length"] for r in pieces) == total
    for r in pieces:
        ids = np.frombuffer(tokens.token_ids(words, made[3][r["doc_id"]]), "<u2").astype("<u4")
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    assert {r["sequence_id"] for r in pieces} == set(range(-(-total // packing.LENGTH)))
    whole = corpus_pipeline.run(spark, str(at))
    assert sum(r["length"] for r in whole.collect()) == total


def test_repeated_rows_nulls_and_other_columns(spark, tmp_path):
    rows = corpus()[:12]
    rows += [rows[3], rows[3], (None, rows[5][1].replace("a", "z"), None), (None, None, None), (7, None, "s1")]
    df = docs(spark, rows).selectExpr("*", "'x' as row", "1 as n_words", "2 as taken")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept.append(sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in now.collect()))
    assert kept[0].count(rows[3][0]) == 3 and kept[0].count(-1) == 1 and kept[1] == kept[0]
    assert kept[2].count(rows[3][0]) == 1 and kept[2].count(-1) == 1 and set(kept[3]) <= set(kept[2]) and set(kept[4]) == set(kept[3])


def test_empty(spark, tmp_path):
    docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
