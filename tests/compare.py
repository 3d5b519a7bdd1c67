"""Side-by-side comparison of a named query with its DuckDB SQL."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TESTDATA", "/root/testdata")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _cell(v):
    if isinstance(v, float) or hasattr(v, "dtype") and str(getattr(v, "dtype", "")).startswith("float"):
        return "nan" if v != v else f"{float(v):.9g}"
    if v is None or v is pd.NaT or v is pd.NA:
        return "nan"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return str([_cell(x) for x in v])
    return str(v)


def canonical(df: pd.DataFrame) -> list[tuple[str, ...]]:
    cols = sorted(df.columns)
    return sorted(tuple(_cell(v) for v in row) for row in df[cols].astype(object).itertuples(index=False))


def check(spark, name: str, fn, sql: str, sf_dir: str) -> int:
    got = fn(spark, sf_dir).toPandas()
    want = duck(sf_dir).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns), (name, sorted(got.columns), sorted(want.columns))
    a, b = canonical(got), canonical(want)
    assert len(a) == len(b), (name, len(a), len(b))
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not wrong, (name, len(wrong), wrong[:3])
    return len(a)
