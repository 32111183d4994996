"""Queries over events seen as dated messages, and streams of them."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquarry.functions.dates import sloppy_ranges
from mailquarry.operators import export, facets, search, threads, timeline
from mailquarry.sources.archive import event_messages, table
from mailquarry.streaming import windows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


@query("select event_id as doc_id from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-12'")
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = event_messages(spark, sf_dir)
    for t in search.day_range(date(2024, 1, 5), date(2024, 1, 11)):
        found = found.where(t)
    return found.select("doc_id")


@query("select event_id as doc_id from events where year(ts) = 2024 and month(ts) = 1 and day(ts) = 31 union all select event_id from events where year(ts) = 2024 and month(ts) = 1 and day(ts) = 15")
def date_part(spark, sf_dir):
    m = event_messages(spark, sf_dir)
    return search.date_parts(m, 2024, 1, 31).unionByName(search.date_parts(m, 2024, 1, 15)).select("doc_id")


@query("select arg_min(event_id, (abs(epoch_us(ts) - epoch_us(timestamp '2024-01-17')), event_id)) as doc_id, (min(abs(epoch_us(ts) - epoch_us(timestamp '2024-01-17'))) // 1000)::bigint as gap_ms from events")
def closest_date(spark, sf_dir):
    return search.closest(event_messages(spark, sf_dir), date(2024, 1, 17))


@query("select event_id as doc_id from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-13' or ts >= timestamp '2024-01-20' and ts < timestamp '2024-01-21'")
def sloppy_dates(spark, sf_dir):
    test = F.lit(False)
    for low, high in sloppy_ranges("10 jan 2024 - 12 jan 2024; jan 20 2024"):
        one = F.lit(True)
        for t in search.day_range(low, high):
            one = one & t
        test = test | one
    return event_messages(spark, sf_dir).where(test).select("doc_id")


@query("select doc_id from (select event_id as doc_id, row_number() over (order by ts, event_id) - 1 as r from events) where r between 2 and 10 or r = 14 or r between 100 and 120")
def doc_numbers(spark, sf_dir):
    return search.by_numbers(event_messages(spark, sf_dir), ["date", "doc_id"], "2-10, 14, 100-120").select("doc_id")


@query("select event_id as doc_id, ts as date from events order by ts, event_id limit 50 offset 150")
def paging(spark, sf_dir):
    return search.page(event_messages(spark, sf_dir), ["date", "doc_id"], 3, 50).select("doc_id", "date")


@query("select event_id as doc_id, ts as date from events order by ts desc, event_id limit 100")
def most_recent(spark, sf_dir):
    return event_messages(spark, sf_dir).orderBy(F.desc("date"), "doc_id").limit(100).select("doc_id", "date")


@query("select user_id as contact, ((epoch_us((select max(ts) from events)) - epoch_us(ts)) // (7 * 86400000000))::int as slot, count(*) as n from events group by 1, 2")
def backward_quantum(spark, sf_dir):
    return timeline.backward(event_messages(spark, sf_dir), 7, ("contact",))


@query("b as (select user_id as contact, (epoch_us((select max(ts) from events)) - epoch_us(ts)) // (7 * 86400000000) as slot, count(*) as n from events group by 1, 2) select contact from b where slot < 4 and n >= 12 group by 1 having count(*) = 4".replace("b as", "with b as", 1))
def screening(spark, sf_dir):
    return timeline.screened(event_messages(spark, sf_dir), "contact", 7, 4, 12)


@query("select user_id as contact, count(distinct (epoch_us((select max(ts) from events)) - epoch_us(ts)) // (7 * 86400000000)) as n_quanta from events group by 1")
def quanta_per_name(spark, sf_dir):
    slots = timeline.backward(event_messages(spark, sf_dir), 7, ("contact",))
    return slots.groupBy("contact").agg(F.count("*").alias("n_quanta"))


@query("with o as (select year(o_orderdate) * 12 + month(o_orderdate) - 1 as m from orders), f as (select min(m) as a, max(m) as b from o), w as (select unnest(range(0, (select b - a from f) + 1)) as w) select w::int as window, make_date(((a + w * 2) // 12)::bigint, ((a + w * 2) % 12 + 1)::bigint, 1::bigint)::timestamp as start, count(*) as n from o, f, w where m >= a + w * 2 and m < a + w * 2 + 3 group by w, a")
def sliding_months(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("date"))
    return timeline.sliding_months(docs, 3, 2)


@query("with s as (select user_id, event_id, ts, lag(ts) over (partition by user_id order by ts, event_id) as b from events), m as (select *, sum(case when b is null or epoch_us(ts) - epoch_us(b) >= 86400000000 then 1 else 0 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as session from s) select user_id as contact, session::bigint as session, count(*) as n_docs from m group by 1, 2")
def event_sessions(spark, sf_dir):
    return threads.sessions(event_messages(spark, sf_dir), ["contact"], 1).groupBy("contact", "session").agg(F.count("*").alias("n_docs"))


@query("select event_id as doc_id, 'k' as path, json_extract_string(props, '$.k') as value from events")
def json_flatten(spark, sf_dir):
    return export.json_leaves(event_messages(spark, sf_dir), "props", "doc_id")


@query("with s as (select date_trunc('day', ts) as d, event_type, count(*) as n from events group by 1, 2) select max(n)::bigint as largest, min(n)::bigint as smallest from s")
def largest_bucket(spark, sf_dir):
    return timeline.buckets(event_messages(spark, sf_dir), "day", ("folder",)).where("n > 0").agg(F.max("n").alias("largest"), F.min("n").alias("smallest"))


@query("with c as (select user_id, event_type, count(*) as n from events group by 1, 2), t as (select *, sum(n) over (partition by user_id) as t from c) select user_id as contact, round(-sum(n / t * ln(n / t)), 6) as entropy from t group by 1")
def contact_entropy(spark, sf_dir):
    counts = event_messages(spark, sf_dir).groupBy("contact", "folder").agg(F.count("*").alias("n"))
    return facets.entropy(counts, ["contact"], "n").select("contact", F.round("entropy", 6).alias("entropy"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return windows.event_stream(spark, f"{sf_dir}/events.parquet*", schema)


def _named(name: str) -> str:
    return f"{name}_{uuid.uuid4().hex}"


@query("select time_bucket(interval 1 day, ts) as start, event_type, count(*) as n from events group by 1, 2")
def stream_windowed(spark, sf_dir):
    out = windows.drained(windows.windowed_counts(_stream(spark, sf_dir)), _named("windowed"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("select distinct user_id, event_type, value from events")
def stream_first_copies(spark, sf_dir):
    stream = windows.first_copies(_stream(spark, sf_dir), ["user_id", "event_type", "value"], "60 days")
    return windows.drained(stream.select("user_id", "event_type", "value"), _named("copies"), "append")


@query(None)
def stream_sessions(spark, sf_dir):
    return windows.drained(windows.sessions(_stream(spark, sf_dir)), _named("sessions"), "complete")


@query(None)
def stream_contact_state(spark, sf_dir):
    return windows.drained(windows.running_counts(_stream(spark, sf_dir)), _named("state"), "update")
