"""All registered market-data queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidebar.plans import market, operations, research, surface

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "pair_events"


def queries() -> dict[str, Query]:
    return market.QUERIES | research.QUERIES | operations.QUERIES | surface.QUERIES


def oracle_sql() -> dict[str, str]:
    return market.SQL | research.SQL | operations.SQL | surface.SQL
