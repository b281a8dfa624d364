"""Registration of queries with their oracles."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    """Registers ``f(spark, sf_dir)`` under ``name``, and its DuckDB SQL if there is one."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put
