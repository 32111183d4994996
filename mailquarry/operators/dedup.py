"""Duplicates, merges and incremental imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_messages(docs: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One message of each key, the first in order: a partial aggregate, not a sort of whole groups."""
    rest = [c for c in docs.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return docs.groupBy(*keys).agg(first.alias("_f")).select(*keys, *[F.col(f"_f.{c}").alias(c) for c in rest])


def merged(mine: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """mine and those of other's messages that mine does not hold."""
    return mine.unionByName(other.join(mine.select(*keys), keys, "left_anti").select(*mine.columns))


def not_imported(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return incoming.join(existing.select(*keys), keys, "left_anti")


def advanced_cursor(cursor: DataFrame, seen: DataFrame) -> DataFrame:
    """(account, folder, last_uid): the larger of the stored and the newly seen id."""
    return cursor.unionByName(seen.select("account", "folder", F.col("uid").alias("last_uid"))).groupBy("account", "folder").agg(F.max("last_uid").alias("last_uid"))
