"""Row numbers and neighbours over a whole table, without one task that holds all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket should have, and the largest number of buckets.
BUCKET_ROWS, MOST_BUCKETS = 1000, 65_536


def bucket_bits(n: int, rows: int = BUCKET_ROWS) -> int:
    return min(max(n // rows, 1).bit_length(), MOST_BUCKETS.bit_length() - 1)


def hash_bucket(key: Column, bits: int) -> Column:
    """The top bits of a 64-bit hash, as unsigned number."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def numbered(df: DataFrame, key: str, name: str, ties: list[Column]) -> tuple[DataFrame, int]:
    """Adds global row numbers from 0 in the order of (unsigned top bits, key, ties); key is a 64-bit hash column.

    Rows are counted by hash bucket (a bounded table), buckets get their first number, and only the rank inside of a
    bucket needs a sort. Rows equal in key and ties may swap numbers. Returns the table and its number of rows.
    """
    n = df.count()
    bits = bucket_bits(n)
    with_bucket = df.withColumn("_bucket", hash_bucket(F.col(key), bits))
    sizes = with_bucket.groupBy("_bucket").count().collect()  # at most MOST_BUCKETS rows
    first, at = [], 0
    for r in sorted(sizes, key=lambda r: r["_bucket"]):
        first.append((r["_bucket"], at))
        at += r["count"]
    starts = df.sparkSession.createDataFrame(first or [(0, 0)], "_bucket long, _start long")
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(F.col(key), *ties)) - 1
    out = with_bucket.withColumn("_rank", rank).join(F.broadcast(starts), "_bucket").withColumn(name, F.col("_start") + F.col("_rank"))
    return out.drop("_bucket", "_start", "_rank"), n


def bounds_of(df: DataFrame, order: str, n: int, rows: int = 1000, most: int = 16_384) -> list[int]:
    """Values of an integer column that cut it into ranges of about `rows` rows (approximate quantiles, bounded list)."""
    parts = min(max(n // rows, 1), most)
    if parts < 2:
        return []
    cuts = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10 * parts)).first()[0]
    return sorted({x for x in cuts or [] if x is not None})


def range_of(value: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below the value, by binary search in codegen-free but logarithmic steps; null: 0."""
    if not bounds:
        return F.lit(0)
    table = F.array(*[F.lit(int(b)) for b in bounds])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda acc, s: F.when((acc + s <= len(bounds)) & (F.get(table, acc + s - 1) <= value), acc + s).otherwise(acc))
    return F.coalesce(found, F.lit(0))


def with_next(df: DataFrame, order: str, ties: list[str], carried: list[str], dealt_with: Callable[[DataFrame], DataFrame] = lambda dealt: dealt) -> DataFrame:
    """Adds next_<c> for each carried column: its value in the next row in descending order; the last row gets the first's.

    The table is cut into ranges of the order column. Each range also gets a copy of the row that follows it (the first
    of the next range below; after the last range the first of all), so one shuffle by range suffices and no task sees
    more than a range. Rows are ordered by (order desc nulls last, ties). dealt_with may add columns, carried ones too,
    to rows that have been shuffled.
    """
    stats = df.agg(F.count("*")).first()[0]
    bounds = bounds_of(df.select(order), order, stats)
    by_range = df.withColumn("_range", range_of(F.col(order), bounds))
    tops = by_range.groupBy("_range").agg(F.max(order).alias("top")).orderBy(F.desc("_range")).collect()  # bounded by the bounds
    top_of: list[int | None] = [None] * (len(bounds) + 1)
    above_of = [0] * (len(bounds) + 1)
    for i, r in enumerate(tops):
        top_of[r["_range"]], above_of[r["_range"]] = r["top"], tops[i - 1]["_range"]
    top = F.get(F.array(*[F.lit(t).cast("long") for t in top_of]), F.col("_range"))
    above = F.get(F.array(*[F.lit(t) for t in above_of]), F.col("_range"))
    here = F.struct(F.col("_range").alias("_at"), F.lit(False).alias("_copy"))
    target = F.when(F.col(order).eqNullSafe(top), F.array(here, F.struct(above.alias("_at"), F.lit(True).alias("_copy")))).otherwise(F.array(here))
    line = [F.col("_copy"), F.desc_nulls_last(order), *map(F.col, ties)]
    dealt = by_range.select("*", F.explode(target).alias("_to")).select(*df.columns, "_to.*").repartition("_at").sortWithinPartitions("_at", *line)
    span = Window.partitionBy("_at").orderBy(*line)
    led = dealt_with(dealt).select("*", *[F.lead(c).over(span).alias(f"next_{c}") for c in carried])
    return led.where(~F.col("_copy")).drop("_at", "_copy")
