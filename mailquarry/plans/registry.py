"""Registry of the archive queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mailquarry.plans import events, extra, more, orders, texts


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facets of the order archive."""
    return orders.facet_all(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**orders.QUERIES, **events.QUERIES, **texts.QUERIES, **more.QUERIES, **extra.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**orders.SQL, **events.SQL, **texts.SQL, **more.SQL, **extra.SQL}
