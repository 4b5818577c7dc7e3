"""Registry of the section-2 queries: key -> (Spark builder, DuckDB oracle SQL).

Every builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
driver's tables (or views Spark derives from them).  The SQL is the same
computation written for DuckDB; keys without SQL are checked on rows only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql.strip()
        return fn
    return deco


def with_ctes(body: str, *ctes: str) -> str:
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body


def load_all() -> None:
    """Import every module that registers queries."""
    from . import (cleaning, content, encoding, evaluation, featuring, modeling,  # noqa: F401
                   profiling, selection, sources, streams, weblogs, windowing)
