"""Registration of queries with the reference SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
REFERENCE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``(spark, sf_dir) -> DataFrame`` under ``name``."""
    def register(build):
        if name in QUERIES:
            raise ValueError(f"duplicate query name: {name}")
        QUERIES[name] = build
        if sql is not None:
            REFERENCE_SQL[name] = sql
        return build
    return register


def rounded(expression: str, decimals: int = 6) -> str:
    """SQL twin of ``functions.rounding.stable_round``."""
    whole = 2 ** 53 // 10 ** decimals
    return (f"(CASE WHEN abs({expression}) < {whole}e0 THEN floor(({expression}) * 1e{decimals} "
            f"+ 0.500001e0) / 1e{decimals} ELSE ({expression}) END)")


def with_tables(*ctes: str, body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body.strip()
