"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tallyloom.plans.tables import Tables, duck_sql

Query = Callable[[Tables], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = duck_sql(oracle)
        return fn

    return keep


def hash_sql(seed: int, *keys: str) -> str:
    """``splits.keyed_hash`` as SQL."""
    return "CAST('0x' || substr(md5('" + str(seed) + "/' || " + " || '/' || ".join(keys) + "), 1, 15) AS BIGINT)"
