"""Threads: exact keys, sessions with gaps, and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def participant_key(addrs: DataFrame, roles: tuple[str, ...] = ("to", "cc", "from")) -> DataFrame:
    """(doc_id, people): the sorted distinct contacts of a message, as one string. A message's list is bounded by its header."""
    own = addrs.where(F.col("role").isin(list(roles)))
    return own.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("contact")), ",").alias("people"))


def exact_threads(messages: DataFrame, addrs: DataFrame, subject: Column) -> DataFrame:
    """(thread_key, n_docs, first_date, first_doc): messages of equal subject and participants."""
    keyed = messages.join(participant_key(addrs), "doc_id", "left").select("doc_id", "date", F.sha2(F.concat_ws("|", subject, "people"), 256).alias("thread_key"))
    first = F.min(F.struct("date", "doc_id"))
    return keyed.groupBy("thread_key").agg(F.count("*").alias("n_docs"), first.alias("f")).select("thread_key", "n_docs", F.col("f.date").alias("first_date"), F.col("f.doc_id").alias("first_doc"))


def sessions(docs: DataFrame, key: list[str], gap_days: int = 30, column: str = "date", order: str = "doc_id") -> DataFrame:
    """docs with session: a new one starts when a key's message comes gap_days or more after the one before."""
    span = Window.partitionBy(*key).orderBy(column, order)
    before = F.lag(column).over(span)
    starts = before.isNull() | (F.unix_micros(F.col(column).cast("timestamp")) - F.unix_micros(before.cast("timestamp")) >= gap_days * 86_400_000_000)
    marked = docs.withColumn("_new", starts.cast("int"))
    return marked.withColumn("session", F.sum("_new").over(span.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def thread_headers(docs: DataFrame, key: list[str], gap_days: int = 30) -> DataFrame:
    """The first message of each session and the session's size."""
    return sessions(docs, key, gap_days).groupBy(*key, "session").agg(F.min(F.struct("date", "doc_id")).alias("f"), F.count("*").alias("n_docs")).select(*key, "session", F.col("f.doc_id").alias("doc_id"), F.col("f.date").alias("date"), "n_docs")
