import pytest
from pyspark.sql import functions as F

from pagemill.llm import common


@pytest.mark.parametrize("small", [True, False, None])
def test_lookup_equals_a_left_join(spark, small):
    rows = [(i, "hot" if i % 3 else f"k{i % 50}") for i in range(3000)] + [(9000, None), (9001, "none")]
    df = spark.createDataFrame(rows, "salt long, key string")
    held = {}
    for _, k in rows:
        held[k] = held.get(k, 0) + 1
    table = common.cut(spark.createDataFrame([(k, n, f"v{k}") for k, n in held.items() if k not in (None, "none")], "key string, rows long, value string"))
    got = common.looked_up(df, table, "key", "rows", small)
    assert got.columns[-1] == "value" and set(got.columns) == {"salt", "key", "value"}
    assert sorted((r["salt"], r["value"]) for r in got.collect()) == sorted((i, f"v{k}" if k in held and k not in (None, "none") else None) for i, k in rows)
    assert common.looked_up(df.limit(0), table.limit(0), "key", "rows", small).count() == 0


def test_size_is_told(spark):
    table = common.cut(spark.range(100).select("id", F.repeat(F.lit("x"), F.lit(1000)).alias("s")))
    assert common.is_small(table) and not common.is_small(table, rows=99) and not common.is_small(table, size=100_000)


def test_free_names():
    assert common.free("row", "a", "ROW", "row_") == "row__"


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Nothing:
        def isEmpty(self):
            return True

        def getCheckpointDir(self):
            return self

        def sc(self):
            return self

    class Session:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            _jsc = Nothing()
            master = "spark://somewhere:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
