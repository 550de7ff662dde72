import numpy as np
import pytest
from pyspark.sql import types as T

from pagemill.llm import golay, simhash

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def test_golay_decodes_three_errors_and_shares_keys():
    rng = np.random.default_rng(0)
    words = golay.codewords()
    assert min(int(np.bitwise_count(words[1:]).min()), 7) == 7
    message = rng.integers(0, 4096, 500)
    flips = np.array([sum(1 << int(b) for b in rng.choice(23, rng.integers(0, 4), replace=False)) for _ in message])
    assert (golay.decoder()[words[message] ^ flips] == message).all()
    owner, _ = golay.keys(rng.integers(0, 1 << 23, 500))
    assert set(np.bincount(owner)) == {1, 6}


def test_keys_meet_for_all_up_to_four_bits():
    rng = np.random.default_rng(1)
    for _ in range(600):
        a = rng.integers(0, 1 << 63, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, dtype=np.uint64)
        b = a
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b ^= np.uint64(1) << np.uint64(bit)
        _, x = simhash.candidate_keys(np.array([a]))
        _, y = simhash.candidate_keys(np.array([b]))
        assert len(np.intersect1d(x, y))


def brute(rows):
    fps = [simhash.fingerprint(None if t is None else t.encode()) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((doc, f"{fps[i]:016x}", min(ids, default=None)))
    return out


def texts():
    rng = np.random.default_rng(2)
    word = lambda: "w" + str(rng.integers(0, 5000))
    rows = []
    for i in range(40):
        base = [word() for _ in range(int(rng.integers(60, 400)))]
        rows.append((i * 10, " ".join(base)))
        for k in range(int(rng.integers(0, 4))):
            near = list(base)
            near[int(rng.integers(0, len(near)))] = word()
            rows.append((i * 10 + k + 1, " ".join(near)))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (1004, "ONE"), (1004, "ONE"), (None, "one"), (None, "lonely here")]
    rows.append((1005, "long " * 50000))
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "1 as fp", "2 as key", "3 as least")
    got = [tuple(r) for r in simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=order) == sorted(brute(rows), key=order)


def test_one_of_each_keeps_clashing_columns_and_shuffled_lookups_agree(spark, tmp_path):
    rows = texts()
    spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "'r' as __row", "'R' as ROW", "1 as fp").write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    out = simhash.one_of_each(df)
    assert out.columns == df.columns and {(r["__row"], r["ROW"]) for r in out.collect()} == {("r", "R")}
    want = {c for _, _, c in brute(rows)}
    assert len(out.collect()) == len({(c, None if c is not None else t) for (_, t), (_, _, c) in zip(rows, brute(rows))}) and {r["doc_id"] for r in out.collect()} == want
    prints = simhash.cut(simhash.with_fingerprints(df.select("doc_id", "text")))
    sent, shuffled = (sorted(map(str, simhash.classes(prints, prints["doc_id"], x).collect())) for x in (True, False))
    assert sent == shuffled


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("dense", [8, 8192])
def test_dense_groups_link_exactly(spark, dense):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 62, dtype=np.uint64)
    values = {int(centre)}
    for _ in range(400):
        v = int(centre)
        for bit in rng.choice(64, rng.integers(1, 9), replace=False):
            v ^= 1 << int(bit)
        values.add(v)
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    whole = spark.createDataFrame([(x,) for x in signed], "fp long").coalesce(1)
    found = [tuple(r) for r in simhash.links(whole, most=dense).collect()]
    from pagemill.llm.components import Forest

    got, want = Forest(), Forest()
    for a, b in found:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 4
        got.join(a, b)
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                want.join(a, b)
    assert [got.root(x) for x in signed] == [want.root(x) for x in signed]
