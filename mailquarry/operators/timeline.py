"""Histograms and intervals over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Messages with this date have none; histograms leave them out.
INVALID_DATE = "1960-01-01 00:00:00"


def valid(docs: DataFrame, column: str = "date") -> DataFrame:
    return docs.where(F.col(column) != F.lit(INVALID_DATE).cast("timestamp_ntz"))


def spine(docs: DataFrame, unit: str, column: str = "date") -> DataFrame:
    """A row for each unit (month, year) from the first message to the last."""
    ends = docs.agg(F.date_trunc(unit, F.min(column)).alias("a"), F.date_trunc(unit, F.max(column)).alias("b")).where("a is not null")
    return ends.select(F.explode(F.expr(f"sequence(a, b, interval 1 {unit})")).alias("at")).select(F.col("at").cast("timestamp_ntz").alias("bucket"))


def buckets(docs: DataFrame, unit: str = "month", layers: tuple[str, ...] = (), column: str = "date") -> DataFrame:
    """Messages by calendar unit [start, next), empty buckets kept; with layers, for each of their values."""
    counts = docs.groupBy(F.date_trunc(unit, column).cast("timestamp_ntz").alias("bucket"), *layers).agg(F.count("*").alias("n"))
    frame = spine(docs, unit, column)
    if layers:
        frame = counts.select(*layers).distinct().crossJoin(F.broadcast(frame))  # layers x units, not rows
    return frame.join(counts, ["bucket", *layers], "left").select("bucket", *layers, F.coalesce("n", F.lit(0)).alias("n"))


def histogram(docs: DataFrame, unit: str = "month", column: str = "date") -> DataFrame:
    """Counts of intervals (low, high]; the very first bound is inclusive. The first bound is the unit of the first date."""
    start = docs.agg(F.date_trunc(unit, F.min(column)).alias("start"))
    moved = docs.crossJoin(F.broadcast(start)).select(F.when((F.col(column) == F.date_trunc(unit, column)) & (F.col(column) > F.col("start")), F.date_trunc(unit, F.col(column).cast("timestamp") - F.expr("interval 1 microsecond"))).otherwise(F.date_trunc(unit, column)).cast("timestamp_ntz").alias("bucket"))
    return moved.groupBy("bucket").agg(F.count("*").alias("n"))


def equal_slices(docs: DataFrame, n: int, column: str = "date") -> DataFrame:
    """Counts in n slices of equal length between the first and the last date; the last date falls into the last slice."""
    at = F.unix_micros(F.col(column).cast("timestamp"))
    ends = docs.agg(F.min(at).alias("a"), F.max(at).alias("b"))
    slot = F.least(F.floor((at - F.col("a")) * n / F.greatest(F.col("b") - F.col("a"), F.lit(1))), F.lit(n - 1))
    return docs.crossJoin(F.broadcast(ends)).groupBy(slot.cast("int").alias("slot")).agg(F.count("*").alias("n"))


def backward(docs: DataFrame, days: int, group: tuple[str, ...] = (), column: str = "date") -> DataFrame:
    """Counts by the number of quanta of `days` before the latest message of all (0 is the latest quantum)."""
    end = docs.agg(F.max(column).alias("end"))
    gap = F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col(column).cast("timestamp"))
    slot = F.floor(gap / (days * 86_400_000_000)).cast("int")
    return docs.crossJoin(F.broadcast(end)).groupBy(*group, slot.alias("slot")).agg(F.count("*").alias("n"))


def screened(docs: DataFrame, contact: str, days: int, last: int, least: int, column: str = "date") -> DataFrame:
    """Contacts with at least `least` messages in each of the last `last` quanta."""
    recent = backward(docs, days, (contact,), column).where(F.col("slot") < last)
    return recent.where(F.col("n") >= least).groupBy(contact).agg(F.count("*").alias("n_quanta")).where(F.col("n_quanta") == last).select(contact)


def sliding_months(docs: DataFrame, size: int, step: int, column: str = "date") -> DataFrame:
    """Windows of `size` months that start every `step` months from the first; a message lies in size/step windows at most.

    Windows are numbered from the first month, so a message's windows follow from its month without a range join.
    """
    months = lambda c: F.year(c) * 12 + F.month(c) - 1
    first = docs.agg(F.min(months(F.col(column))).alias("first"), F.max(months(F.col(column))).alias("last"))
    at = months(F.col(column)) - F.col("first")
    windows = F.sequence(F.greatest(F.ceil((at - size + 1) / step), F.lit(0)).cast("int"), F.floor(at / step).cast("int"))
    hits = docs.crossJoin(F.broadcast(first)).where(F.ceil((at - size + 1) / step) <= F.floor(at / step)).select("first", F.explode(windows).alias("window"))
    start = F.col("first") + F.col("window") * step
    return hits.groupBy("first", "window").agg(F.count("*").alias("n")).select("window", F.make_date(F.floor(start / 12).cast("int"), (start % 12 + 1).cast("int"), F.lit(1)).cast("timestamp_ntz").alias("start"), "n")


def top_layers(docs: DataFrame, layer: str, k: int = 20, unit: str = "month", column: str = "date") -> DataFrame:
    """Series of the k largest values of a layer (by messages, then by name)."""
    top = docs.groupBy(layer).agg(F.count("*").alias("_all")).orderBy(F.desc("_all"), layer).limit(k).select(layer)
    return docs.join(F.broadcast(top), layer).groupBy(layer, F.date_trunc(unit, column).cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("n"))


def in_out_series(directed: DataFrame, layer: str, unit: str = "month") -> DataFrame:
    return directed.groupBy(layer, F.date_trunc(unit, "date").cast("timestamp_ntz").alias("bucket")).agg(F.count_if("received").alias("n_in"), F.count_if("sent").alias("n_out"))


def normalised(series: DataFrame, group: list[str], n: str = "n") -> DataFrame:
    """A series as shares of its group's sum, and its group's largest bucket."""
    sums = series.groupBy(*group).agg(F.sum(n).alias("_sum"), F.max(n).alias("largest"))
    return series.join(sums, group).withColumn("share", F.col(n) / F.col("_sum")).drop("_sum")


def damped_score(docs: DataFrame, key: str, column: str = "date") -> DataFrame:
    """Sum over months of the square root of the month's messages: steady contact outweighs bursts."""
    monthly = docs.groupBy(key, F.date_trunc("month", column).alias("m")).agg(F.count("*").alias("n"))
    return monthly.groupBy(key).agg(F.sum(F.sqrt("n")).alias("score"), F.sum("n").alias("n"))


def quarter_start(at: Column) -> Column:
    return F.date_trunc("quarter", at)


def cleaned_dates(messages: DataFrame, partition: str = "folder", order: str = "msg_no") -> DataFrame:
    """Repairs dates at import: sent, else received, else that of the message before plus a millisecond, else INVALID_DATE."""
    from pyspark.sql import Window

    known = F.coalesce("sent_date", "received_date")
    span = Window.partitionBy(partition).orderBy(order)
    last = F.last(known, ignorenulls=True).over(span.rowsBetween(Window.unboundedPreceding, -1))
    date = F.coalesce(known, (last.cast("timestamp") + F.expr("interval 1 millisecond")).cast("timestamp_ntz"), F.lit(INVALID_DATE).cast("timestamp_ntz"))
    return messages.withColumn("date", date).withColumn("hacky_date", known.isNull() | (F.year(date) < 1960) | (F.year(date) > 2020))
