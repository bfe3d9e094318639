"""Run a query and its SQL side by side."""

from __future__ import annotations

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.7g}"
    return "~" if v is None else str(v)


def compare(spark, query, sql: str, sf_dir: str) -> None:
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(tuple(_value(r[c]) for c in names) for r in df.collect())
    rel = con.sql(sql)
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    want = sorted(tuple(_value(r[i]) for i in at) for r in rel.fetchall())
    assert len(got) == len(want)
    assert got == want
