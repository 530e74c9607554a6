"""Named queries: ``QUERIES[name](spark, sf_dir) -> DataFrame`` and, where the
query is SQL-expressible, ``ORACLES[name]`` — the same result stated as DuckDB
SQL over the driver tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    # importing the modules registers their queries
    from facetwise.plans import q_core  # noqa: F401
    from facetwise.plans import q_sales  # noqa: F401
    from facetwise.plans import q_canon  # noqa: F401
    from facetwise.plans import fixtures, q_stone  # noqa: F401
    from facetwise.plans import q_decision  # noqa: F401
    from facetwise.plans import q_matrix  # noqa: F401
    from facetwise.plans import q_stream  # noqa: F401
    from facetwise.plans import q_pairs  # noqa: F401
    from facetwise.plans import q_reports  # noqa: F401
    from facetwise.plans import q_ingest  # noqa: F401
