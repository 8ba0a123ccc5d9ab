"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None).

A builder takes (spark, sf_dir) and returns a lazy DataFrame over the
given tables. The oracle SQL, when present, computes the same result in
DuckDB from the base tables; `None` marks a fit-dependent query that only
gets a row-count check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from . import (  # noqa: F401
        q_flagship, q_ingest, q_joins, q_spatial, q_profile, q_scoring, q_models,
    )
