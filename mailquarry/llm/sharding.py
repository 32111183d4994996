"""Shards by a Feistel permutation of global row numbers with cycle walking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquarry.llm.common import cut, fresh
from mailquarry.llm.ordering import numbered

SHARDS, KEY, ROUNDS = 24, 0x5EED, 6
_MASK = (1 << 64) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(rows: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The place of each row number of 0..n-1 in a keyed permutation of them.

    A balanced Feistel network permutes the least even power of two that holds n; a result beyond n is put through
    again until it is below (cycle walking), which keeps it a permutation of 0..n-1.
    """
    half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
    low = np.uint64((1 << int(half)) - 1)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & _MASK) for r in range(1, ROUNDS + 1)]
    out = rows.astype(np.uint64)
    left = np.arange(out.size)
    with np.errstate(over="ignore"):
        while left.size:
            a, b = out[left] >> half, out[left] & low
            for k in keys:
                a, b = b, a ^ (_mixed(b + k) & low)
            out[left] = (a << half) | b
            left = left[out[left] >= np.uint64(n)]
    return out.astype(np.int64)


def _place(n: int, key: int):
    @F.pandas_udf("long")
    def place(rows: pd.Series) -> pd.Series:
        return pd.Series(permuted(rows.to_numpy(), n, key))

    return place


def sharded(docs: DataFrame, shards: int = SHARDS, key: int = KEY, content: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """docs with `shard` and `slot`: row counts of shards differ by one at most, slots of a shard are 0, 1, 2 ... .

    Rows are numbered in the order of a hash of their content (default doc_id and text, as columns are named), so numbers
    depend neither on files nor on partitions; equal rows may swap. place = permutation(number), shard = place mod
    shards, slot = place div shards: both can be computed for any row number, and the shuffle is the same in every run.
    Null and empty values hash like any other; an empty table gives no rows. If docs has columns of these names, the new
    ones get an underscore in front.
    """
    content = content or [c for c in ("doc_id", "text") if c in docs.columns]
    shard, slot = fresh(docs, "shard"), fresh(docs, "slot")
    packed = docs.select(F.struct("*").alias("row"), F.xxhash64(*content).alias("_hash"), F.col(content[0]).alias("_first"))
    rows, n = numbered(packed, "_hash", "_row", [F.col("_first"), *(F.col(f"row.{t}") for t in ties or [])])
    placed = rows.withColumn("_place", _place(n, key)("_row"))
    return placed.select("row.*", (F.col("_place") % shards).cast("int").alias(shard), F.floor(F.col("_place") / shards).cast("long").alias(slot))


def shard_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law (`rows`), shard, slot, grown_shard of every row; texts are not shuffled."""
    text = F.coalesce(F.encode("text", "UTF-8"), F.encode(F.lit(""), "UTF-8"))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64("text").alias("_text"))
    out = sharded(cut(narrow), shards, content=["doc_id", "_text"], ties=["size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
