"""Query registry: one Spark query and (where SQL can express it) one DuckDB oracle per
operator of the inventory, keyed ``<ID>_<short_name>``.

Each Spark callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole driver tables.  Each oracle is a DuckDB query over the same parquet tables,
starting from the canonical ``sales`` CTE.  Column names match one to one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillroll.sources.tables import SALES_SQL, sales

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn

    return deco


def with_sales(body: str) -> str:
    """Prefix an oracle body with the canonical sales CTE (merging a leading WITH)."""
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH sales AS (\n{SALES_SQL}\n),\n{body[5:]}"
    return f"WITH sales AS (\n{SALES_SQL}\n)\n{body}"


def sales_of(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return sales(spark, sf_dir, cols)


def load_all() -> None:
    """Import every module that registers queries."""
    from tillroll.plans import (  # noqa: F401
        q_anomaly, q_audit, q_basket, q_clean, q_context, q_forecast, q_kpi, q_reports, q_sources,
    )
