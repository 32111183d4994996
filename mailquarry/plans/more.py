"""Further archive queries: types, intervals, groups by likeness, names, clues, cards."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquarry.operators import clues, facets, groups, ner, people, search, timeline
from mailquarry.plans.orders import PAIRS, SETS, TOP, _basket_groups, _groups
from mailquarry.plans.texts import LEX, TOKENS, _lexicon
from mailquarry.sources.archive import DOCUMENT_SQL, ORDER_SQL, document_messages, event_messages, order_archive, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None, base: str = ORDER_SQL):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (f"with {base}{' ' if sql.lstrip().lower().startswith('select') else ', '}{sql}") if base else sql
        return f

    return register


@query("select doc_id, filename from attachments where ext in ('a', 'r')")
def attachment_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = order_archive(spark, sf_dir).attachments
    return a.where(search.of_types(["Others", "Graphics"]) & (F.col("ext") != "n")).select("doc_id", "filename")


@query("select doc_id from docs where regexp_matches(body, '[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}|3[0-9]{3}[-. ][0-9]{6}[-. ][0-9]{5}|[45][0-9]{3}([-. ][0-9]{4}){3}|6011([-. ][0-9]{4}){3}')", DOCUMENT_SQL)
def sensitive_messages(spark, sf_dir):
    return document_messages(spark, sf_dir).where(search.sensitive()).select("doc_id")


@query("select email, count(distinct doc_id) as n_docs from addrs join contacts using (contact) where contact in ('s1', 'c2') group by 1 union all select 'nobody@example.com', 0")
def docs_per_address(spark, sf_dir):
    a = order_archive(spark, sf_dir)
    asked = [r[0] for r in a.contacts.where("contact in ('s1', 'c2')").select("email").collect()]
    return search.by_address(a, [*asked, "nobody@example.com"])


@query("select doc_id from directed where sent and date >= timestamp '1997-01-01' and date < timestamp '1998-01-01'")
def import_filter(spark, sf_dir):
    return search.import_filter(order_archive(spark, sf_dir), start=date(1997, 1, 1), end=date(1997, 12, 31), sent_only=True).select("doc_id")


_INTERVALS = "iv as (select i::int as interval_id, timestamp '1996-01-01' + to_days((i * 20)::int) as start, timestamp '1996-01-01' + to_days((i * 20 + 45)::int) as fin from range(0, 30) r(i))"


@query(f"{_INTERVALS} select interval_id, doc_id from messages, iv where date >= start and date <= fin")
def overlapping_intervals(spark, sf_dir):
    start = F.expr("cast('1996-01-01' as timestamp_ntz)")
    iv = spark.range(30).select(F.col("id").cast("int").alias("interval_id"), (start + F.make_dt_interval(F.col("id").cast("int") * 20)).alias("start"), (start + F.make_dt_interval(F.col("id").cast("int") * 20 + 45)).alias("end"))
    return search.in_intervals(order_archive(spark, sf_dir).messages, iv)


@query("select distinct 'folder' as kind, folder as value from messages union all select distinct 'comment', comment from messages where comment is not null union all select distinct 'filename', filename from attachments union all select distinct 'ext', ext from attachments")
def listings(spark, sf_dir):
    return search.listings(order_archive(spark, sf_dir))


@query("m as (select m.doc_id, folder as name, date, comment as thread, f.contact as sender, t.contact as recipient from messages m join addrs f on f.doc_id = m.doc_id and f.role = 'from' join addrs t on t.doc_id = m.doc_id and t.pos = 1 and t.role = 'to'), q as (select doc_id as query_id, * from m where doc_id in (10, 20, 30)), h as (select query_id, m.doc_id, case when m.doc_id = q.doc_id then 1 when m.thread = q.thread then 2 when m.sender = q.sender and m.recipient = q.recipient then 3 when m.sender = q.sender then 4 when m.recipient = q.recipient then 5 end as level from m join q using (name) where abs(epoch_us(m.date) - epoch_us(q.date)) <= 183 * 86400000000 and m.doc_id <> q.doc_id) select query_id, doc_id, level::int as level from h where level = (select min(level) from h h2 where h2.query_id = h.query_id)")
def nearest_context(spark, sf_dir):
    a = order_archive(spark, sf_dir)
    sender = a.addrs.where("role = 'from'").select("doc_id", F.col("contact").alias("sender"))
    first = a.addrs.where("role = 'to' and pos = 1").select("doc_id", F.col("contact").alias("recipient"))
    m = a.messages.join(sender, "doc_id").join(first, "doc_id").select("doc_id", F.col("folder").alias("name"), "date", F.col("comment").alias("thread"), "sender", "recipient")
    q = m.where(F.col("doc_id").isin(10, 20, 30)).withColumn("query_id", F.col("doc_id"))
    others = m.join(q.select("doc_id"), "doc_id", "left_anti")
    own = q.select("query_id", "doc_id")
    return search.nearest_context(others, q).join(own, ["query_id", "doc_id"], "left_anti")


@query("e as (select email from contacts where contact in ('s1', 'c3')) select email from contacts where contact in (select contact from contacts join e using (email))")
def all_addresses(spark, sf_dir):
    c = order_archive(spark, sf_dir).contacts
    return people.all_addresses_of(c.where("contact in ('s1', 'c3')").select("email"), c.select("contact", "email"))


@query("o as (select distinct doc_id from addrs join contacts using (contact) where is_self) select distinct contact from addrs where contact not in (select contact from addrs where doc_id not in (select doc_id from o))")
def reachable_people(spark, sf_dir):
    a = order_archive(spark, sf_dir)
    return people.reachable_people(a.addrs, a.contacts)


@query("select contact, count(*) as n from addrs where contact not in (select contact from contacts where is_self) group by 1")
def without_own(spark, sf_dir):
    a = order_archive(spark, sf_dir)
    return people.own_addresses(a.addrs, a.contacts)[1].groupBy("contact").agg(F.count("*").alias("n"))


@query(f"{SETS}, sm as (select x.g as a, y.g as b, count(*)::double / (x.k + y.k - count(*)) as j from el x join el y using (c) where x.g < y.g group by x.g, y.g, x.k, y.k) select a, b, round(j, 6) as jaccard from sm where j >= 0.5")
def similar_groups(spark, sf_dir):
    sets = groups.member_sets(order_archive(spark, sf_dir))
    return groups.similar_pairs(sets.select(F.array_join("members", ",").alias("group_id"), "members"), 0.5)


@query(f"{PAIRS} select g as group_id from d1 where g not in (select small from ct)")
def maximal_groups(spark, sf_dir):
    return groups.without_subsets(_basket_groups(spark, sf_dir)).select("group_id")


@query(f"{TOP}, v as (select contact, count(*) as volume from addrs group by 1), ex as (select group_id, len(members) as k, unnest(members) as contact from gs), b as (select group_id, k, arg_max(contact, (volume, contact)) as contact from ex join v using (contact) group by 1, 2) select group_id, case when k > 1 then name || '+' || (k - 1) else name end as label from b join contacts using (contact)")
def group_names(spark, sf_dir):
    a = order_archive(spark, sf_dir)
    return groups.named(_groups(spark, sf_dir), a.addrs.groupBy("contact").agg(F.count("*").alias("volume")), a.contacts)


@query(f"{TOP}, j as (select doc_id, group_id, len(list_intersect(bk.members, gs.members))::double as c, len(bk.members) as a, len(gs.members) as b from bk, gs where list_has_any(bk.members, gs.members)), cl as (select doc_id, arg_max(group_id, (c / (a + b - c), -group_id)) as group_id from j group by doc_id) select coalesce(group_id, -1)::int as group_id, count(*) as n_docs from bk left join cl using (doc_id) group by 1")
def facet_group(spark, sf_dir):
    return groups.by_group(groups.baskets(order_archive(spark, sf_dir)), _groups(spark, sf_dir)).withColumn("group_id", F.coalesce("group_id", F.lit(-1)))


@query("c as (select contact, count(*) as n from addrs group by 1) select round(avg(n), 6) as mean, round(stddev_pop(n), 6) as deviation from c")
def frequency_spread(spark, sf_dir):
    return facets.spread(order_archive(spark, sf_dir).addrs.groupBy("contact").agg(F.count("*").alias("n")), "n")


@query("select count(*) as n_all, 0::bigint as n_images, 0::bigint as n_documents from attachments")
def attachment_counts(spark, sf_dir):
    return facets.attachment_counts(order_archive(spark, sf_dir).attachments)


@query("select quantile_disc(l_linenumber, 0.5)::bigint as median from lineitem", "")
def median_of_counts(spark, sf_dir):
    return facets.median_of_counts(table(spark, sf_dir, "lineitem"), "l_linenumber")


@query(f"{TOKENS}, {LEX} select doc_id, (1 + coalesce(s, 0))::bigint as score from docs left join (select doc_id, sum(case when category = 'endings' then 10 else 2 end) as s from lx group by 1) using (doc_id)", DOCUMENT_SQL)
def sentiment_scores(spark, sf_dir):
    return clues.sentiment_scores(document_messages(spark, sf_dir), _lexicon(spark, sf_dir), ["endings"])


@query(None)
def best_clues(spark, sf_dir):
    docs = document_messages(spark, sf_dir)
    found = clues.sentences(docs, "body").join(docs.select("doc_id", "folder"), "doc_id")
    return clues.best_clues(found, "then", ["from", "with"], ["folder"])


@query("select letter, count(*) as n from (select unnest(string_split(lower(n_name), '')) as letter from nation) where regexp_matches(letter, '[a-z]') group by 1", "")
def letter_counts(spark, sf_dir):
    return clues.letter_counts(table(spark, sf_dir, "nation"), "n_name")


@query("select folder, arg_min(date_trunc('month', date), (date, doc_id))::timestamp as month, count(*) as n_docs, count(distinct comment) as n_terms from messages group by 1")
def cluster_cards(spark, sf_dir):
    m = order_archive(spark, sf_dir).messages
    first = F.min(F.struct("date", "doc_id"))
    return m.groupBy("folder").agg(F.date_trunc("month", first["date"]).cast("timestamp_ntz").alias("month"), F.count("*").alias("n_docs"), F.countDistinct("comment").alias("n_terms"))


@query("select folder, date_trunc('month', date)::timestamp as bucket, comment, count(*) as n from messages group by 1, 2, 3")
def layered_series(spark, sf_dir):
    m = order_archive(spark, sf_dir).messages
    return timeline.buckets(m, "month", ("folder", "comment")).where("n > 0").select("folder", "bucket", "comment", "n")


@query("select event_id as doc_id, row_number() over (order by user_id, ts, event_id)::int as row_no from events qualify row_no <= 25", "")
def saved_rows(spark, sf_dir):
    return search.page(event_messages(spark, sf_dir), ["contact", "date", "doc_id"], 0, 25).select("doc_id", "contact", "date").withColumn("row_no", F.row_number().over(_order("contact", "date", "doc_id"))).select("doc_id", "row_no")


def _order(*columns: str):
    from pyspark.sql import Window

    return Window.orderBy(*columns)  # over one page


def _gazette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of nations and regions as places, of customers' segments as organisations."""
    places = table(spark, sf_dir, "nation").select(F.initcap("n_name").alias("title")).unionByName(table(spark, sf_dir, "region").select(F.initcap("r_name").alias("title")))
    trades = table(spark, sf_dir, "customer").select(F.concat(F.initcap("c_mktsegment"), F.lit(" Company")).alias("title")).distinct()
    return places.withColumn("type", F.lit("PLACE")).unionByName(trades.withColumn("type", F.lit("ORGANISATION")))


@query(None)
def ner_em_train(spark, sf_dir):
    return ner.type_table(ner.train(_gazette(spark, sf_dir)))


@query(None)
def ner_label(spark, sf_dir):
    gazette = _gazette(spark, sf_dir)
    texts = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    return ner.span_lines(ner.recognised(texts, "body", ner.train(gazette), gazette))
