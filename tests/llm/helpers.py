"""Small fixtures and comparison with DuckDB for the tests of this folder."""

import duckdb
import pandas as pd
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def docs(spark, rows):
    """documents from (doc_id, text, source)."""
    full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    return spark.createDataFrame(full, DOCS)


def duck(sql, **tables):
    c = duckdb.connect()
    for name, df in tables.items():
        frame = df.toPandas() if not isinstance(df, pd.DataFrame) else df
        for col in ("doc_id", "n_chars", "page_id"):
            if col in frame:
                frame[col] = frame[col].astype("Int64")
        c.register(f"{name}_frame", frame)
        c.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_frame")
        for col in ("text", "source", "lang", "url", "html"):
            if col in frame:
                c.execute(f"ALTER TABLE {name} ALTER {col} TYPE VARCHAR")
    return c.sql(sql)


def rows(relation):
    if hasattr(relation, "collect"):
        cols, data = relation.columns, [tuple(r) for r in relation.collect()]
    else:
        cols, data = relation.columns, relation.fetchall()
    order = [cols.index(c) for c in sorted(cols)]
    return sorted((tuple(r[i] for i in order) for r in data), key=lambda r: tuple((x is not None, str(x)) for x in r))
