"""Comparison of a Spark result with DuckDB SQL over the same tables."""

from __future__ import annotations

import math

import duckdb

from evidencelake.sources.tables import TABLES


def plain(v):
    """A value that compares across engines."""
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 9) + 0.0
    return v.isoformat()[:26] if hasattr(v, "isoformat") else v


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def same(df, sql: str, c: duckdb.DuckDBPyConnection, may_be_empty: bool = False) -> None:
    """Asserts equal columns and rows, in any order, and that there are rows unless none may be right."""
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[x]) for x in columns) for r in df.collect()), key=repr)
    result = c.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(x)]) for x in columns) for r in result.fetchall()), key=repr)
    assert len(ours) == len(theirs) and (ours or may_be_empty)
    assert ours == theirs
