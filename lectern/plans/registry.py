"""All registered queries of the engine and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.sources.domain import Domain, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "search_bm25_topk"


def query(sql: str | None = None, tables: str = ""):
    """Registers a function of a Domain; sql is its DuckDB equivalent over the named library tables."""

    def add(f: Callable[[Domain], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = with_tables(*tables.split(), body=sql) if tables else sql
        return f

    return add


from lectern.plans import catalogue, pages, reading, searching, upkeep  # noqa: E402, F401
