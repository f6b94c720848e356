"""Queries beside their DuckDB equivalents."""

from __future__ import annotations

import math
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = Path("/root/testdata/sf0.001")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def compared(spark, query, sql: str) -> None:
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = query(spark, str(DATA))
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    kinds = {d[0]: str(d[1]) for d in found.description}
    assert sorted(names) == columns
    assert {c: TYPES.get(t, t) for c, t in df.dtypes if t in TYPES} == {c: kinds[c] for c, t in df.dtypes if t in TYPES}
    theirs = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())
    assert ours == theirs
