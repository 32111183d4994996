"""Smaller archive queries: attachments, text functions, curation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquarry.functions import text as T
from mailquarry.operators import curation, entities, facets, fulltext, groups, people, search
from mailquarry.plans.orders import TOP, _groups
from mailquarry.plans.texts import SINGLE, TOKENS, _capital_words
from mailquarry.sources.archive import DOCUMENT_SQL, ORDER_SQL, document_messages, order_archive, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None, base: str = ORDER_SQL):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (f"with {base}{' ' if sql.lstrip().lower().startswith('select') else ', '}{sql}") if base else sql
        return f

    return register


@query("select distinct doc_id from attachments where filename in ('1.a', '7.r')")
def blob_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.attachments(order_archive(spark, sf_dir), search.Request(attachment_name="1.a; 7.R")).select("doc_id").distinct()


@query("select doc_id, pos, filename from attachments where (doc_id, pos) in (select (l_orderkey, l_linenumber) from lineitem where l_linestatus = 'F')")
def blob_keywords(spark, sf_dir):
    a = order_archive(spark, sf_dir)
    keys = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.col("l_linestatus").alias("keyword"))
    return curation.with_keywords(a.attachments, keys, ["f"]).select("doc_id", "pos", "filename")


@query("select doc_id, count(*) as n, string_agg(filename, ',' order by filename) as names from attachments group by 1")
def blob_names(spark, sf_dir):
    a = order_archive(spark, sf_dir).attachments
    return a.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("filename")), ",").alias("names"))


@query("select contact, count(*) as n_out from addrs join contacts using (contact) where is_self and role = 'from' group by 1")
def own_out_counts(spark, sf_dir):
    a = order_archive(spark, sf_dir)
    return people.own_addresses(a.addrs, a.contacts)[0].where("role = 'from'").groupBy("contact").agg(F.count("*").alias("n_out"))


@query("select doc_id, contact from addrs where role = 'to' and contact not in (select contact from contacts where is_self)")
def participants_except_own(spark, sf_dir):
    a = order_archive(spark, sf_dir)
    return people.own_addresses(a.addrs, a.contacts)[1].where("role = 'to'").select("doc_id", "contact")


@query("m as (select sha256(doc_id::varchar) as signature, folder, comment, reviewed from messages), o as (select signature, max(folder) as f from m where folder like '1%' group by 1) select signature, coalesce('kept ' || f, folder) as folder from m left join o using (signature)")
def curation_transfer(spark, sf_dir):
    m = order_archive(spark, sf_dir).messages.select(F.sha2(F.col("doc_id").cast("string"), 256).alias("signature"), "folder")
    other = m.where("folder like '1%'").withColumn("folder", F.concat(F.lit("kept "), "folder"))
    return curation.transferred(m, other, "signature", ["folder"])


@query("select folder, arg_max(doc_id, date) as doc_id, max(date) as date from (select folder, max(doc_id) as doc_id, date from messages group by 1, 3) group by folder")
def latest_records(spark, sf_dir):
    m = order_archive(spark, sf_dir).messages.groupBy("folder", "date").agg(F.max("doc_id").alias("doc_id"))
    return curation.upserted(m.where("doc_id % 2 = 0"), m.where("doc_id % 2 = 1"), "folder", "date")


@query("w as (select unnest(string_split(lower(name), '#')) as word, lower(org) as variant from contacts) select word, variant, count(*)::bigint as weight from w where word <> variant group by 1, 2")
def variant_weights(spark, sf_dir):
    c = order_archive(spark, sf_dir).contacts
    rows = c.select(F.replace("name", F.lit("#"), F.lit(" ")).alias("title"), F.col("org").alias("variant"), F.lit(1).alias("weight"))
    return curation.variant_weights(rows)


@query(f"{TOP}, j as (select doc_id, group_id, len(list_intersect(bk.members, gs.members))::double as c, len(bk.members) as a, len(gs.members) as b from bk, gs where list_has_any(bk.members, gs.members)), cl as (select doc_id, arg_max(group_id, (c / (a + b - c), -group_id)) as group_id, round(max(c / (a + b - c)), 6) as jaccard from j group by doc_id) select comment as term, group_id, round(sum(jaccard), 6) as weight from messages join cl using (doc_id) where comment is not null group by 1, 2")
def term_colours(spark, sf_dir):
    a = order_archive(spark, sf_dir)
    own = groups.closest_group(groups.baskets(a), _groups(spark, sf_dir))
    return curation.term_colours(a.messages.where("comment is not null").select("doc_id", F.col("comment").alias("term")), own)


@query(f"{TOKENS}, rt as (select term, count(*) as score from po group by 1), ow as (select distinct doc_id, term from po where length(term) >= 2), rk as (select term, row_number() over (partition by doc_id order by score desc, term) as r from ow join rt using (term)) select distinct term from rk where r <= 4", DOCUMENT_SQL)
def covered_terms(spark, sf_dir):
    found = fulltext.postings(document_messages(spark, sf_dir), "body")
    return curation.covered_terms(found, found.groupBy("term").agg(F.count("*").alias("score")))


@query(f"{SINGLE}, ty as (select entity, case when length(entity) % 2 = 0 then 'even' else 'odd' end as type from en group by 1) select type, count(distinct entity) as n_names, count(distinct doc_id) as n_docs from en join ty using (entity) group by 1", DOCUMENT_SQL)
def names_by_type(spark, sf_dir):
    found = _capital_words(spark, sf_dir)
    types = found.select("entity", F.when(F.length("entity") % 2 == 0, "even").otherwise("odd").alias("type")).distinct()
    return curation.names_by_type(found, types)


@query(f"{SINGLE} select entity, count(distinct doc_id) as n_docs, count(distinct folder) as n_folders, min(doc_id) as first_doc from en join docs using (doc_id) group by 1", DOCUMENT_SQL)
def entity_accounts(spark, sf_dir):
    found = _capital_words(spark, sf_dir).join(document_messages(spark, sf_dir).select("doc_id", "folder"), "doc_id")
    return found.groupBy("entity").agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("folder").alias("n_folders"), F.min("doc_id").alias("first_doc"))


@query(f"{SINGLE} select entity, count(*) as n_docs from en group by 1 order by 2 desc, 1 limit 15", DOCUMENT_SQL)
def top_entities(spark, sf_dir):
    return facets.top_of_map(entities.frequencies(_capital_words(spark, sf_dir)), "n_docs", 15, "entity")


@query("select doc_id, subject from docs where contains(lower(body), 'tion the') or contains(lower(body), 'eau de')", DOCUMENT_SQL)
def any_term(spark, sf_dir):
    return document_messages(spark, sf_dir).where(T.any_term(F.col("body"), "tion THE | eau de")).select("doc_id", "subject")


@query(r"select doc_id, length(regexp_replace(body, '[^\p{L}]+', '', 'g'))::int as n_letters, coalesce(list_max(list_transform(list_filter(string_split_regex(body, '\s+'), lambda w: w <> ''), lambda w: length(w))), 0)::int as longest from docs", DOCUMENT_SQL)
def letters_and_longest(spark, sf_dir):
    return document_messages(spark, sf_dir).select("doc_id", T.letters(F.col("body")).alias("n_letters"), T.longest_word(F.col("body")).alias("longest"))


@query("select page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as html from pages", "")
def escaped_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.escaped_html(F.col("html")).alias("html"))


@query("select page_id, regexp_extract(url, '([^/]*)$', 1) as tail, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') as safe from pages", "")
def url_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.url_tail(F.col("url")).alias("tail"), T.safe_filename(F.col("url")).alias("safe"))


@query("select doc_id, case when length(subject) > 30 then left(subject, 27) || '...' else subject end as subject from docs", DOCUMENT_SQL)
def ellipsized_subjects(spark, sf_dir):
    return document_messages(spark, sf_dir).select("doc_id", T.ellipsized(F.col("subject"), 30).alias("subject"))


@query(r"select n_nationkey, array_to_string(list_sort(list_filter(string_split_regex(lower(n_name), '[\s,.;:-]+'), lambda w: w <> '')), ' ') as canonical, array_to_string(list_transform(string_split_regex(lower(n_name), '\s+'), lambda w: case when w in ('a', 'an', 'and', 'as', 'at', 'but', 'for', 'in', 'is', 'of', 'on', 'the', 'to', 'was', 'with') then w else upper(left(w, 1)) || substr(w, 2) end), ' ') as shown from nation", "")
def canonical_names(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", T.canonical_entity(F.col("n_name")).alias("canonical"), T.title_cased(F.lower("n_name")).alias("shown"))


@query(None)
def seeded_order(spark, sf_dir):
    return curation.shuffled(document_messages(spark, sf_dir).select("doc_id"), "doc_id", 7).orderBy("order_key").select("doc_id")


@query(None)
def sentence_list(spark, sf_dir):
    return document_messages(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("body"))).alias("place", "sentence"))
