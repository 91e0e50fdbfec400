"""Named queries over the test tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mintweave.sources.bindings import SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``tables`` name the shared CTEs its SQL starts from."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            body = sql.strip()
            ctes = [SQL[t] for t in tables]
            if body.upper().startswith("WITH "):
                ORACLES[name] = "WITH " + ("RECURSIVE " if "RECURSIVE" in body[:20].upper() else "") + ",\n".join(
                    [*ctes, body[5:].lstrip().removeprefix("RECURSIVE").lstrip()]
                )
            else:
                ORACLES[name] = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
        return fn

    return add
