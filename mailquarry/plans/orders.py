"""Queries over orders seen as messages, each with the SQL that checks it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquarry.functions import text as T
from mailquarry.operators import dedup, facets, graph, groups, people, search, threads, timeline
from mailquarry.sources.archive import ORDER_SQL, Archive, order_archive, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"with {ORDER_SQL}{', ' if not sql.lstrip().lower().startswith('select') else ' '}{sql}"
        return f

    return register


FACETS = {
    "person": "select 'person' as facet, contact as value, count(distinct doc_id) as n_docs from addrs join contacts using (contact) where not is_self group by contact",
    "folder": "select 'folder' as facet, folder as value, count(*) as n_docs from messages group by folder",
    "direction": "select 'direction' as facet, d as value, count(*) as n_docs from (select 'in' as d from directed where received union all select 'out' from directed where sent) group by d",
    "do_not_transfer": "select 'do_not_transfer' as facet, case when do_not_transfer then 'yes' else 'no' end as value, count(*) as n_docs from messages group by 2",
    "reviewed": "select 'reviewed' as facet, case when reviewed then 'yes' else 'no' end as value, count(*) as n_docs from messages group by 2",
    "extension": "select 'extension' as facet, ext as value, count(distinct doc_id) as n_docs from attachments group by ext",
    "annotation": "select 'annotation' as facet, coalesce(lower(comment), 'none') as value, count(*) as n_docs from messages group by 2",
}


@query(" union all ".join(FACETS.values()))
def facet_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.all_facets(order_archive(spark, sf_dir))


@query(FACETS["person"])
def facet_person(spark, sf_dir):
    return facets.by_person(order_archive(spark, sf_dir))


@query(FACETS["folder"])
def facet_folder(spark, sf_dir):
    return facets.by_folder(order_archive(spark, sf_dir).messages)


@query(FACETS["direction"])
def facet_direction(spark, sf_dir):
    return facets.by_direction(order_archive(spark, sf_dir).directed())


@query(FACETS["reviewed"] + " union all " + FACETS["do_not_transfer"])
def facet_flags(spark, sf_dir):
    m = order_archive(spark, sf_dir).messages
    return facets.by_flag(m, "reviewed").unionByName(facets.by_flag(m, "do_not_transfer"))


@query(FACETS["extension"])
def facet_extension(spark, sf_dir):
    return facets.by_extension(order_archive(spark, sf_dir))


@query(FACETS["annotation"])
def facet_annotation(spark, sf_dir):
    return facets.by_annotation(order_archive(spark, sf_dir).messages)


def _ids(df: DataFrame) -> DataFrame:
    return df.select("doc_id")


@query("select doc_id from directed where lower(folder) in ('1-urgent', '2-high') and lower(comment) = 'building' and sent and reviewed and date >= timestamp '1996-01-01' and date < timestamp '1999-01-01'")
def search_and(spark, sf_dir):
    r = search.Request(folder="1-URGENT; 2-high", annotation="Building", direction="out", flags={"reviewed": True}, start=date(1996, 1, 1), end=date(1998, 12, 31))
    return _ids(search.select(order_archive(spark, sf_dir), r))


@query("select doc_id from directed where (lower(folder) = '5-low' or reviewed or sent) and date >= timestamp '1997-03-01' and date < timestamp '1997-04-01'")
def search_or_date_anded(spark, sf_dir):
    return _ids(search.select_any(order_archive(spark, sf_dir), [F.lower("folder") == "5-low", F.col("reviewed"), F.col("sent")], date(1997, 3, 1), date(1997, 3, 31)))


@query("select distinct doc_id from addrs join contacts using (contact) where role = 'to' and lower(name) in (select lower(s_name) from supplier where s_suppkey in (1, 3))")
def search_correspondent_roles(spark, sf_dir):
    asked = tuple(r[0] for r in table(spark, sf_dir, "supplier").where("s_suppkey in (1, 3)").select("s_name").collect())
    return _ids(search.select(order_archive(spark, sf_dir), search.Request(correspondents=asked, roles=("to",))))


@query("select doc_id from (select distinct doc_id, contact from addrs where contact in ('s1', 's2')) group by doc_id having count(*) = 2")
def search_all_persons(spark, sf_dir):
    asked = tuple(r[0] for r in order_archive(spark, sf_dir).contacts.where("contact in ('s1', 's2')").select("email").collect())
    return _ids(search.select(order_archive(spark, sf_dir), search.Request(all_persons=asked)))


@query("select doc_id from messages where doc_id not in (select doc_id from addrs join contacts using (contact) where is_list)")
def search_mailing_list_no(spark, sf_dir):
    return _ids(search.select(order_archive(spark, sf_dir), search.Request(mailing_list="no")))


@query("select doc_id from messages where doc_id in (select doc_id from addrs join contacts using (contact) where is_list)")
def search_mailing_list_yes(spark, sf_dir):
    return _ids(search.select(order_archive(spark, sf_dir), search.Request(mailing_list="yes")))


@query("select distinct doc_id from attachments where ext = 'r' and size > 0 and (size < 5120 or size >= 20480 and size < 102400) and regexp_matches(filename, '^[12][.]')")
def search_attachment_one_blob(spark, sf_dir):
    return _ids(search.select(order_archive(spark, sf_dir), search.Request(attachment_regex="^[12][.]", attachment_extension="R", attachment_sizes=("1", "3"))))


@query("select doc_id, pos, filename, ext, size from attachments where ext in ('a', 'n') and size >= 5120 and size < 20480")
def blob_listing(spark, sf_dir):
    return search.attachments(order_archive(spark, sf_dir), search.Request(attachment_extension="a;n", attachment_sizes=("2",)))


@query("select doc_id from messages where contains(lower(comment), 'hold')")
def annotation_contains(spark, sf_dir):
    return _ids(search.select(order_archive(spark, sf_dir), search.Request(annotation_contains="HOLD")))


@query("select doc_id from messages where doc_id in (1, 5, 7, 34)")
def search_ids(spark, sf_dir):
    return _ids(search.select(order_archive(spark, sf_dir), search.Request(ids=(1, 5, 7, 34))))


@query("u as (select filename, size, count(*) as n from attachments group by 1, 2) select sum(n)::bigint as n_all, count(*) as n_unique, sum(n * size)::bigint as bytes_all, sum(size)::bigint as bytes_unique from u")
def blob_dedup_stats(spark, sf_dir):
    return facets.blob_stats(order_archive(spark, sf_dir))


@query("select contact, count(*) filter (where role = 'from' and received) as n_in, count(*) filter (where role <> 'from' and sent) as n_out, count(*) as n_all from addrs join directed using (doc_id) group by contact")
def contacts_frequencies(spark, sf_dir):
    return facets.contact_frequencies(order_archive(spark, sf_dir))


@query("h as (select distinct doc_id, case when role = 'from' then 'from' else 'to' end as side, contact from addrs) select contact, count(*) filter (where side = 'from' and received) as n_in, count(*) filter (where side = 'to' and sent) as n_out, count(*) filter (where side = 'to' and not sent) as n_mention from h join directed using (doc_id) where contact not in (select contact from contacts where is_self) group by contact")
def contact_counts_in_out_mention(spark, sf_dir):
    return facets.in_out_mentions(order_archive(spark, sf_dir))


@query("select contact, count(*) as n_all from addrs group by contact having count(*) <= 5")
def contacts_below_threshold(spark, sf_dir):
    counts = order_archive(spark, sf_dir).addrs.groupBy("contact").agg(F.count("*").alias("n_all"))
    return facets.at_most(counts, "n_all", 5)


@query("select contact, count(*) as n_all from addrs group by contact order by n_all desc, contact limit 100")
def contacts_sorted_top(spark, sf_dir):
    return people.contact_ranks(order_archive(spark, sf_dir).addrs.groupBy("contact").agg(F.count("*").alias("n_all")), "n_all", 100)


@query("h as (select distinct contact, doc_id, date, case when role = 'from' and received then 'in' when role <> 'from' and sent then 'out' end as direction from addrs join directed using (doc_id)) select contact, direction, min(date) as first_date, max(date) as last_date, count(*) as n_docs from h where direction is not null group by 1, 2")
def contact_dates(spark, sf_dir):
    return facets.contact_dates(order_archive(spark, sf_dir))


@query("select count(*) as n_contacts, count(distinct name) as n_names, count(distinct email) as n_emails, count(*) filter (where is_self) as n_own, count(*) filter (where is_list) as n_lists from contacts")
def address_book_stats(spark, sf_dir):
    return facets.address_book_stats(order_archive(spark, sf_dir))


@query("select count(*) as n_docs, count(*) filter (where sent) as n_sent, count(*) filter (where received) as n_received, min(date) as first_date, max(date) as last_date from directed")
def archive_stats(spark, sf_dir):
    return facets.archive_stats(order_archive(spark, sf_dir))


@query("t as (select r_name || '|' || n_name || '|' || c_mktsegment as p, n_name || '|' || c_mktsegment as q, c_mktsegment as s from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey) select type, count(*) as n from (select p as type from t union all select q from t union all select s from t) group by type")
def type_rollup(spark, sf_dir):
    get = lambda n: table(spark, sf_dir, n)
    rows = get("orders").join(get("customer"), F.col("c_custkey") == F.col("o_custkey")).join(get("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(get("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return facets.type_rollup(rows.select(F.concat_ws("|", "r_name", "n_name", "c_mktsegment").alias("path")), "path")


@query("c as (select folder, comment, count(*) as n from messages group by 1, 2), p as (select folder, n, sum(n) over (partition by folder) as t from c) select folder, round(-sum(n / t * ln(n / t)), 6) as entropy from p group by folder")
def entity_entropy(spark, sf_dir):
    counts = order_archive(spark, sf_dir).messages.groupBy("folder", "comment").agg(F.count("*").alias("n"))
    return facets.entropy(counts, ["folder"], "n").select("folder", F.round("entropy", 6).alias("entropy"))


def _own_keys(m: DataFrame) -> DataFrame:
    return m.select("doc_id", F.date_trunc("day", "date").cast("timestamp_ntz").alias("day"), "folder", "comment")


@query("select date_trunc('day', date)::timestamp as day, folder, comment, min(doc_id) as doc_id from messages group by 1, 2, 3")
def dedup_messages(spark, sf_dir):
    return dedup.distinct_messages(_own_keys(order_archive(spark, sf_dir).messages), ["day", "folder", "comment"], [F.col("doc_id")])


@query("k as (select doc_id, folder from messages where doc_id % 3 <> 0), o as (select doc_id, folder from messages where doc_id % 2 = 0) select doc_id, folder from k union all select doc_id, folder from o where doc_id not in (select doc_id from k)")
def merge_archives(spark, sf_dir):
    m = order_archive(spark, sf_dir).messages.select("doc_id", "folder")
    return dedup.merged(m.where("doc_id % 3 <> 0"), m.where("doc_id % 2 = 0"), ["doc_id"])


@query("select doc_id from messages where folder in ('1-URGENT', '2-HIGH') and doc_id not in (select doc_id from messages where reviewed)")
def skip_existing(spark, sf_dir):
    m = order_archive(spark, sf_dir).messages
    return _ids(dedup.not_imported(m.where(F.col("folder").isin("1-URGENT", "2-HIGH")), m.where("reviewed"), ["doc_id"]))


@query("select 'own' as account, folder, max(doc_id) as last_uid from messages group by folder")
def import_cursor(spark, sf_dir):
    m = order_archive(spark, sf_dir).messages.select(F.lit("own").alias("account"), "folder", F.col("doc_id").alias("uid"))
    before = m.where("uid < 100").groupBy("account", "folder").agg(F.max("uid").alias("last_uid"))
    return dedup.advanced_cursor(before, m.where("uid >= 100"))


# Time


@query("s as (select unnest(generate_series(date_trunc('month', (select min(date) from messages)), date_trunc('month', (select max(date) from messages)), interval 1 month)) as bucket), c as (select date_trunc('month', date) as bucket, count(*) as n from messages group by 1) select bucket::timestamp as bucket, coalesce(n, 0) as n from s left join c using (bucket)")
def month_buckets_gapfill(spark, sf_dir):
    return timeline.buckets(order_archive(spark, sf_dir).messages, "month")


@query("select date_trunc('year', date)::timestamp as bucket, folder, count(*) as n from messages group by 1, 2")
def year_buckets_by_folder(spark, sf_dir):
    return timeline.buckets(order_archive(spark, sf_dir).messages, "year", ("folder",))


@query("b as (select *, date_trunc('month', min(date) over ()) as a from messages) select (case when date = date_trunc('month', date) and date > a then date_trunc('month', date - interval 1 microsecond) else date_trunc('month', date) end)::timestamp as bucket, count(*) as n from b group by 1")
def histogram_lo_hi(spark, sf_dir):
    return timeline.histogram(order_archive(spark, sf_dir).messages)


@query("e as (select min(epoch_us(date)) as a, max(epoch_us(date)) as b from messages) select least((epoch_us(date) - a) * 10 // greatest(b - a, 1), 9)::int as slot, count(*) as n from messages, e group by 1")
def equal_slices(spark, sf_dir):
    return timeline.equal_slices(order_archive(spark, sf_dir).messages, 10)


@query("t as (select comment, count(*) as k from messages group by 1 order by k desc, comment limit 3) select comment, date_trunc('month', date)::timestamp as bucket, count(*) as n from messages where comment in (select comment from t) group by 1, 2")
def stacked_top(spark, sf_dir):
    return timeline.top_layers(order_archive(spark, sf_dir).messages, "comment", 3)


@query("select folder, date_trunc('month', date)::timestamp as bucket, count(*) filter (where received) as n_in, count(*) filter (where sent) as n_out from directed group by 1, 2")
def facet_in_out_series(spark, sf_dir):
    return timeline.in_out_series(order_archive(spark, sf_dir).directed(), "folder")


@query("s as (select folder, date_trunc('year', date)::timestamp as bucket, count(*) as n from messages group by 1, 2) select bucket, folder, n, max(n) over (partition by folder) as largest, round(n / sum(n) over (partition by folder), 6) as share from s")
def normalised_series(spark, sf_dir):
    series = timeline.buckets(order_archive(spark, sf_dir).messages, "year", ("folder",))
    return timeline.normalised(series, ["folder"]).withColumn("share", F.round("share", 6))


@query("m as (select contact, date_trunc('month', date) as m, count(*) as n from addrs join messages using (doc_id) group by 1, 2) select contact, round(sum(sqrt(n)), 6) as score, sum(n)::bigint as n from m group by contact")
def sqrt_score(spark, sf_dir):
    a = order_archive(spark, sf_dir)
    return timeline.damped_score(a.addrs.join(a.messages, "doc_id"), "contact").withColumn("score", F.round("score", 6))


@query("select date_trunc('quarter', date)::timestamp as quarter, count(*) as n from messages group by 1")
def quarters(spark, sf_dir):
    return order_archive(spark, sf_dir).messages.groupBy(timeline.quarter_start(F.col("date")).cast("timestamp_ntz").alias("quarter")).agg(F.count("*").alias("n"))


# Threads


@query("p as (select doc_id, string_agg(distinct contact, ',' order by contact) as people from addrs group by doc_id), k as (select sha256(concat_ws('|', comment, people)) as thread_key, date, doc_id from messages join p using (doc_id)) select thread_key, count(*) as n_docs, min(date) as first_date, arg_min(doc_id, (date, doc_id)) as first_doc from k group by 1")
def threads_exact(spark, sf_dir):
    a = order_archive(spark, sf_dir)
    return threads.exact_threads(a.messages, a.addrs, F.col("comment"))


_SESSIONS = "f as (select contact, m.doc_id, m.date from addrs join messages m using (doc_id) where role = 'from'), l as (select *, lag(date) over (partition by contact order by date, doc_id) as b from f), s as (select *, sum(case when b is null or epoch_us(date) - epoch_us(b) >= 30 * 86400000000 then 1 else 0 end) over (partition by contact order by date, doc_id rows between unbounded preceding and current row) as session from l)"


@query(f"{_SESSIONS} select contact, doc_id, session::bigint as session from s")
def thread_sessions_30d(spark, sf_dir):
    a = order_archive(spark, sf_dir)
    own = a.addrs.where("role = 'from'").join(a.messages.select("doc_id", "date"), "doc_id")
    return threads.sessions(own, ["contact"]).select("contact", "doc_id", "session")


@query(f"{_SESSIONS} select contact, session::bigint as session, arg_min(doc_id, (date, doc_id)) as doc_id, min(date) as date, count(*) as n_docs from s group by 1, 2")
def thread_headers(spark, sf_dir):
    a = order_archive(spark, sf_dir)
    return threads.thread_headers(a.addrs.where("role = 'from'").join(a.messages.select("doc_id", "date"), "doc_id"), ["contact"])


# People


@query("select contact, round(100 * (case when len(string_split(name, ' ')) = 2 then 100 else 0 end + case when regexp_matches(name, '^[A-Z]') then 10 else 0 end) + length(name), 0)::bigint as score from contacts")
def best_name_scores(spark, sf_dir):
    return order_archive(spark, sf_dir).contacts.select("contact", people.name_score(F.col("name")).cast("bigint").alias("score"))


@query("p as (select a.contact as a, b.contact as b, 0.1 as w from contacts a join contacts b using (org) where a.contact < b.contact and org in (select org from contacts group by org having count(*) <= 100) union all select a.contact, b.contact, 0.25 from contacts a join contacts b using (last_name) where a.contact < b.contact and last_name in (select last_name from contacts group by last_name having count(*) <= 100)) select a, b, round(sum(w), 6)::double as affinity from p group by 1, 2")
def affinity_pairs(spark, sf_dir):
    return people.affinity(order_archive(spark, sf_dir).contacts)


@query("select m.doc_id, 'no recipient' as error from messages m where doc_id not in (select doc_id from addrs where role <> 'from')")
def data_errors(spark, sf_dir):
    a = order_archive(spark, sf_dir)
    return people.data_errors(a.messages, a.addrs)


@query("t as (select distinct doc_id, contact from addrs where role <> 'from'), k as (select doc_id, count(*) as k from t group by 1) select contact, max(date) as last_date, count(*) as n_docs, max(date) filter (where k = 1) as last_alone from t join k using (doc_id) join messages using (doc_id) group by contact")
def contacts_last_seen(spark, sf_dir):
    a = order_archive(spark, sf_dir)
    return people.last_seen(a.addrs, a.messages)


@query("o as (select doc_id, sent, coalesce(r, false) or sent as mine from directed left join marks using (doc_id)), f as (select distinct doc_id, contact from addrs join o using (doc_id) where role <> 'from' and not mine), k as (select doc_id, count(*) as k from f group by 1), s as (select contact, max((k = 1)::int) as alone from f join k using (doc_id) group by 1) select c.contact, (case when l.contact is not null then 8 else 0 end + case when c.contact in (select contact from addrs where role = 'from') then 4 when alone = 1 then 1 when alone = 0 then 2 else 0 end)::int as state from (select distinct contact from addrs) c left join s using (contact) left join (select contact from contacts where is_list) l using (contact)")
def mailing_list_state(spark, sf_dir):
    a = order_archive(spark, sf_dir)
    own = a.contacts.where("is_self").select("contact")
    to_me = a.addrs.where("role <> 'from'").join(own, "contact").select("doc_id").distinct().withColumn("to_me", F.lit(True))
    directed = a.directed().join(to_me, "doc_id", "left").withColumn("to_me", F.coalesce("to_me", F.lit(False)))
    return people.mailing_list_states(a.addrs, directed, a.contacts.where("is_list"))


@query("f as (select contact, min(doc_id) as first from addrs where role = 'from' group by 1) select contact, row_number() over (order by first, contact) as id from f")
def first_seen_ids(spark, sf_dir):
    return people.first_seen_ids(order_archive(spark, sf_dir).addrs.where("role = 'from'"), "contact", "doc_id")


# Groups and graphs

BASKETS = "bk as (select doc_id, list_sort(list(distinct contact)) as members from addrs join contacts using (contact) where not is_self and not is_list group by doc_id), bd as (select bk.*, date from bk join messages using (doc_id)), mo as (select members, date_trunc('month', date) as m, count(*) as c from bd group by 1, 2), wb as (select members, sum(sqrt(c)) * least(len(members), 10) as weight, sum(c)::bigint as n from mo group by members)"
TOP = BASKETS + ", gs as (select (s_suppkey // 2)::int as group_id, list_sort(list('s' || s_suppkey)) as members from supplier group by 1)"


@query(f"{BASKETS} select doc_id, array_to_string(members, ',') as members from bk")
def baskets(spark, sf_dir):
    return groups.baskets(order_archive(spark, sf_dir)).select("doc_id", F.array_join("members", ",").alias("members"))


@query(f"{BASKETS} select array_to_string(members, ',') as members, round(weight, 6) as weight, n from wb")
def basket_weights(spark, sf_dir):
    return groups.weighted(groups.baskets(order_archive(spark, sf_dir))).select(F.array_join("members", ",").alias("members"), F.round("weight", 6).alias("weight"), "n")


@query(f"{BASKETS} select contact, count(*) as n from (select unnest(members) as contact from wb) group by 1 having count(*) > 300")
def hyperconnected(spark, sf_dir):
    return groups.hubs(groups.weighted(groups.baskets(order_archive(spark, sf_dir))), 300)


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers, in groups of two neighbours."""
    pair = F.floor(F.col("s_suppkey") / 2).cast("int").alias("group_id")
    return table(spark, sf_dir, "supplier").groupBy(pair).agg(F.array_sort(F.collect_list(F.concat(F.lit("s"), "s_suppkey"))).alias("members"))


def _with_freq(spark: SparkSession, sf_dir: str, a: Archive) -> DataFrame:
    g = _groups(spark, sf_dir)
    freq = groups.containment_frequency(g, groups.weighted(groups.baskets(a)))
    return g.join(freq, "group_id", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))


@query(f"{TOP} select group_id, sum(n)::bigint as freq from gs, wb where list_has_all(wb.members, gs.members) group by 1")
def group_freq_containment(spark, sf_dir):
    return groups.containment_frequency(_groups(spark, sf_dir), groups.weighted(groups.baskets(order_archive(spark, sf_dir))))


@query(f"{TOP}, fr as (select group_id, len(gs.members) as k, coalesce(sum(n) filter (where list_has_all(wb.members, gs.members)), 0)::bigint as freq from gs, wb group by 1, 2) select group_id, freq, (k * freq)::bigint as linear, (k * k * freq)::bigint as square, round(pow(1.4, k) * freq, 6) as exponential from fr")
def group_utility(spark, sf_dir):
    return groups.utilities(_with_freq(spark, sf_dir, order_archive(spark, sf_dir)))


@query(f"{TOP}, fl as (select distinct doc_id, contact from addrs join contacts using (contact) where not is_self and not is_list), p as (select contact, count(*) / (select count(*) from messages)::double as p from fl group by 1), fr as (select group_id, gs.members, coalesce(sum(n) filter (where list_has_all(wb.members, gs.members)), 0)::double as freq from gs, wb group by 1, 2), q as (select group_id, freq, exp(sum(ln(p))) as pp from (select group_id, freq, unnest(members) as contact from fr) join p using (contact) group by 1, 2) select group_id, round((freq - (select count(*) from messages) * pp) / sqrt((select count(*) from messages) * pp * (1 - pp)), 6) as z from q")
def group_zscore(spark, sf_dir):
    a = order_archive(spark, sf_dir)
    flat = groups.baskets(a).select("doc_id", F.explode("members").alias("contact"))
    return groups.z_scores(_with_freq(spark, sf_dir, a), flat, a.messages.count())


@query(f"{TOP}, j as (select doc_id, group_id, len(list_intersect(bk.members, gs.members))::double as c, len(bk.members) as a, len(gs.members) as b from bk, gs where list_has_any(bk.members, gs.members)) select doc_id, arg_max(group_id, (c / (a + b - c), -group_id)) as group_id, round(max(c / (a + b - c)), 6) as jaccard from j group by doc_id")
def closest_group(spark, sf_dir):
    return groups.closest_group(groups.baskets(order_archive(spark, sf_dir)), _groups(spark, sf_dir))


@query(f"{TOP}, v as (select contact, count(*) as volume from addrs group by 1) select group_id, sum(volume)::bigint as mass from (select group_id, unnest(members) as contact from gs) join v using (contact) group by 1")
def group_mass(spark, sf_dir):
    volumes = order_archive(spark, sf_dir).addrs.groupBy("contact").agg(F.count("*").alias("volume"))
    return groups.mass(_groups(spark, sf_dir), volumes)


SETS = f"{BASKETS}, d1 as (select array_to_string(members, ',') as g, members, len(members) as k, n as freq from wb), el as (select g, k, freq, unnest(members) as c from d1)"
PAIRS = f"{SETS}, ct as (select x.g as small, y.g as large, round((y.k - x.k) / y.k::double * (x.freq - y.freq) / x.freq, 6) as error, y.k as k from el x join el y using (c) where x.k < y.k group by x.g, y.g, x.k, y.k, x.freq, y.freq having count(*) = x.k)"


def _basket_groups(spark, sf_dir):
    """All distinct baskets as groups."""
    w = groups.weighted(groups.baskets(order_archive(spark, sf_dir)))
    return w.select(F.array_join("members", ",").alias("group_id"), "members", F.col("n").alias("freq"))


@query(f"{PAIRS} select small, large, error from ct")
def subsumption(spark, sf_dir):
    return groups.subsumption(_basket_groups(spark, sf_dir))


@query(f"{PAIRS} select small as child, arg_min(large, (error, k, large)) as parent from ct group by small")
def group_hierarchy(spark, sf_dir):
    return groups.hierarchy(_basket_groups(spark, sf_dir))


@query(f"{TOP} select count(*) as n_groups, max(len(members))::int as largest, min(len(members))::int as smallest, round(avg(len(members)), 6) as mean_size, (select count(*) from (select unnest(members) as c from gs group by 1)) as n_people, 0::bigint as n_shared from gs")
def group_statistics(spark, sf_dir):
    return groups.statistics(_groups(spark, sf_dir))


@query(None)
def grouper_greedy(spark, sf_dir):
    return groups.greedy_groups(groups.weighted(groups.baskets(order_archive(spark, sf_dir))), 60, 20)


NODES = "tn as (select contact from (select contact, count(*) as n from addrs where contact not in (select contact from contacts where is_self) group by 1 order by n desc, contact limit 60)), fo as (select distinct doc_id, contact from addrs where contact in (select contact from tn)), sg as (select a.contact as a, b.contact as b, count(*) as weight from fo a join fo b using (doc_id) where a.contact < b.contact group by 1, 2 having count(*) >= 5)"


def _graph(spark, sf_dir) -> DataFrame:
    a = order_archive(spark, sf_dir)
    counts = a.addrs.join(a.contacts.where("is_self").select("contact"), "contact", "left_anti").groupBy("contact").agg(F.count("*").alias("n_all"))
    return graph.social_graph(a.addrs.select("doc_id", "contact"), people.contact_ranks(counts, "n_all", 60))


@query(f"{NODES} select a, b, weight from sg")
def social_graph(spark, sf_dir):
    return _graph(spark, sf_dir)


@query(f"{NODES}, dg as (select node, count(*) as degree from (select a as node from sg union all select b from sg) group by 1) select degree, count(*) as n_nodes from dg group by 1")
def degree_distribution(spark, sf_dir):
    return graph.degree_distribution(_graph(spark, sf_dir))


@query(f"{NODES}, e as (select a, b from sg union select b, a from sg), dg as (select a as node, count(*) as d from e group by 1), tr as (select x.a as node, count(*) as t from e x join e y on x.b = y.a join e z on y.b = z.b and z.a = x.a where x.a <> y.b group by 1) select node, round(case when d > 1 then coalesce(t, 0) / (d * (d - 1)::double) else 0 end, 6) as coefficient from dg left join tr using (node)")
def clustering_coeff(spark, sf_dir):
    return graph.clustering(_graph(spark, sf_dir))


# Addresses and exports


@query("select contact, split_part(email, '@', 1) as account, split_part(split_part(email, '@', 2), '.', 2) as org from contacts")
def org_of_email(spark, sf_dir):
    c = order_archive(spark, sf_dir).contacts
    return c.select("contact", T.user_of(F.col("email")).alias("account"), T.org_of(F.col("email")).alias("org"))


@query("select contact, split_part(email, '@', 1) || '@' || substr(sha256('k' || split_part(email, '@', 2)), 1, 8) as masked from contacts")
def mask_domain(spark, sf_dir):
    return order_archive(spark, sf_dir).contacts.select("contact", T.masked_email(F.col("email"), "k").alias("masked"))


@query("select contact, regexp_replace(upper(substr(split_part(email, '@', 1), 1, 1)) || substr(split_part(split_part(email, '@', 1), '.', 1), 2), '', '') as first_name from contacts")
def name_from_email(spark, sf_dir):
    c = order_archive(spark, sf_dir).contacts
    local = F.split(T.user_of(F.col("email")), "[.]")
    return c.select("contact", F.concat(F.upper(F.substring(local[0], 1, 1)), F.substring(local[0], F.lit(2), F.length(local[0]))).alias("first_name"))


@query("select doc_id, sha256(doc_id || '|' || folder || '|' || coalesce(comment, '')) as signature from messages")
def signature_hash(spark, sf_dir):
    return order_archive(spark, sf_dir).messages.select("doc_id", T.signature(F.col("doc_id"), F.col("folder"), F.col("comment")).alias("signature"))
