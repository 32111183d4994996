"""Queries over documents and pages: full text, lexicons, entities, links, text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquarry.functions import text as T
from mailquarry.operators import entities, export, fulltext, people
from mailquarry.operators.query import field_postings
from mailquarry.sources.archive import DOCUMENT_SQL, document_messages, table
from mailquarry.sources.files import html_text

QUERIES: dict = {}
SQL: dict[str, str] = {}

STOPS = "(" + ", ".join(f"'{w}'" for w in fulltext.STOP_WORDS) + ")"
TOKENS = rf"""tk as (select doc_id, unnest(range(len(l))) as pos, unnest(l) as term from (select doc_id, regexp_extract_all(regexp_replace(lower(body), '[''’]s\b', '', 'g'), '[\p{{L}}\p{{N}}]+') as l from docs)), po as (select * from tk where term not in {STOPS})"""
#: Categories of common syllables of the invented texts, as a lexicon file would list them.
LEXICON = {"endings": "tion|able ly|{short}", "short": "nd|ou", "openings": "that the|eau|dans"}


def query(sql: str | None, tokens: bool = False):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"with {DOCUMENT_SQL}{', ' + TOKENS if tokens else ''}{' ' if sql.lstrip().lower().startswith('select') else ', '}{sql}"
        return f

    return register


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.postings(document_messages(spark, sf_dir), "body")


@query("select distinct doc_id from po where term = 'heed' or term = 'onand'", tokens=True)
def fulltext_term(spark, sf_dir):
    return fulltext.holding(_postings(spark, sf_dir), "heed onand")


@query("select doc_id from po group by doc_id having bool_or(term = 're') and bool_or(term = 'ther') and not bool_or(term = 'eau')", tokens=True)
def fulltext_required(spark, sf_dir):
    return fulltext.holding(_postings(spark, sf_dir), "+re +ther -eau")


@query("select distinct a.doc_id from po a join po b on a.doc_id = b.doc_id and b.pos = a.pos + 1 where a.term = 'de' and b.term = 'la'", tokens=True)
def fulltext_phrase(spark, sf_dir):
    return fulltext.holding(_postings(spark, sf_dir), '"de la"')


@query("select distinct a.doc_id from po a join po b on a.doc_id = b.doc_id and b.pos = a.pos + 3 where a.term = 'er' and b.term = 'er'", tokens=True)
def fulltext_phrase_with_stop_words(spark, sf_dir):
    return fulltext.holding(_postings(spark, sf_dir), '"er of the er"')


@query("ph as (select distinct a.doc_id from po a join po b on a.doc_id = b.doc_id and b.pos = a.pos + 1 where a.term = 'de' and b.term = 'la') select distinct doc_id from po where term = 're' and doc_id in (select doc_id from ph)", tokens=True)
def fulltext_word_and_phrase(spark, sf_dir):
    return fulltext.holding(_postings(spark, sf_dir), '+re +"de la"')


@query("ph as (select distinct a.doc_id from po a join po b on a.doc_id = b.doc_id and b.pos = a.pos + 1 where a.term = 'de' and b.term = 'la') select doc_id from ph where doc_id not in (select doc_id from po where term = 'eau')", tokens=True)
def fulltext_phrase_without_word(spark, sf_dir):
    return fulltext.holding(_postings(spark, sf_dir), '-eau "de la"')


@query("select doc_id from po group by doc_id having (bool_or(term = 'ther') or bool_or(term = 'eau')) and bool_or(term = 're') and not bool_or(term = 'from')", tokens=True)
def fulltext_boolean(spark, sf_dir):
    return fulltext.holding(_postings(spark, sf_dir), "(ther OR eau) AND re AND NOT from")


@query("select distinct doc_id from po where regexp_full_match(term, 'heed.*') or regexp_full_match(term, 'ou.a')", tokens=True)
def fulltext_wildcards(spark, sf_dir):
    return fulltext.holding(_postings(spark, sf_dir), "heed* ou?a")


@query("select distinct doc_id from po where term = 're' and doc_id in (select doc_id from docs where list_contains(regexp_extract_all(regexp_replace(lower(subject), '[''’]s\\b', '', 'g'), '[\\p{L}\\p{N}]+'), 'ther'))".replace("\\\\", "\\"), tokens=True)
def fulltext_fields(spark, sf_dir):
    found = field_postings(document_messages(spark, sf_dir), {"subject": "subject", "body": "body"}, fulltext.postings)
    return fulltext.holding(found, "+subject:ther +body:re")


@query("h as (select doc_id, count(*) filter (where term = 'heed') as a, count(*) filter (where term = 'ther') as b, count(*) filter (where term = 're') as c from po where term in ('heed', 'ther', 're') group by 1), n as (select (select count(*) from docs) as n, count(*) filter (where a > 0) as a, count(*) filter (where b > 0) as b, count(*) filter (where c > 0) as c from h) select doc_id, round(sqrt(h.a) * pow(1 + ln(n.n / (n.a + 1.0)), 2) + sqrt(h.b) * pow(1 + ln(n.n / (n.b + 1.0)), 2) + sqrt(h.c) * pow(1 + ln(n.n / (n.c + 1.0)), 2), 6) as score from h, n order by score desc, doc_id limit 25", tokens=True)
def fulltext_best(spark, sf_dir):
    messages = document_messages(spark, sf_dir)
    return fulltext.best(_postings(spark, sf_dir), "heed ther re", messages.count(), 25)


@query("select distinct doc_id from po where regexp_full_match(term, 'th.*tion')", tokens=True)
def token_regex(spark, sf_dir):
    return fulltext.token_regex(_postings(spark, sf_dir), "th.*tion")


@query("select doc_id from docs where regexp_matches(subject, '[0-9]{3}-[0-9]{4}') or regexp_matches(body, '[0-9]{3}-[0-9]{4}')")
def spanning_regex(spark, sf_dir):
    return fulltext.spanning_regex(document_messages(spark, sf_dir), "[0-9]{3}-[0-9]{4}", ["subject", "body"])


@query("select doc_id, count(*) as tf from po where term in ('from', 'ther') group by 1 having count(*) >= 5", tokens=True)
def term_threshold(spark, sf_dir):
    return fulltext.at_least(fulltext.term_counts(_postings(spark, sf_dir)), ["from", "ther"], 5)


@query("select term, count(distinct doc_id) as n_docs from po where term in ('from', 'ther', 'dans') group by 1", tokens=True)
def count_hits(spark, sf_dir):
    return _postings(spark, sf_dir).where(F.col("term").isin("from", "ther", "dans")).groupBy("term").agg(F.countDistinct("doc_id").alias("n_docs"))


@query(None)
def fulltext_stemmed(spark, sf_dir):
    found = fulltext.postings(document_messages(spark, sf_dir), "body", stems=True)
    return fulltext.term_counts(found).groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


LEX = "lx as (select distinct doc_id, 'endings' as category from po where term in ('tion', 'nd', 'ou') union select distinct a.doc_id, 'endings' from po a join po b on a.doc_id = b.doc_id and b.pos = a.pos + 1 where a.term = 'able' and b.term = 'ly' union select distinct doc_id, 'openings' from po where term in ('eau', 'dans'))"


def _lexicon(spark, sf_dir) -> DataFrame:
    return fulltext.lexicon_hits(_postings(spark, sf_dir), fulltext.expanded(LEXICON))


@query(f"{LEX} select doc_id, category from lx", tokens=True)
def lexicon_docs(spark, sf_dir):
    return _lexicon(spark, sf_dir)


@query(f"{LEX} select category, count(distinct doc_id) as n_docs from lx group by 1", tokens=True)
def lexicon_counts(spark, sf_dir):
    return fulltext.lexicon_counts(_lexicon(spark, sf_dir))


@query(f"{LEX} select doc_id from docs where doc_id not in (select doc_id from lx)", tokens=True)
def lexicon_none(spark, sf_dir):
    return fulltext.without_category(document_messages(spark, sf_dir), _lexicon(spark, sf_dir))


@query(f"{LEX} select doc_id from lx group by 1 having count(distinct category) = 2", tokens=True)
def lexicon_all_categories(spark, sf_dir):
    return fulltext.with_all(_lexicon(spark, sf_dir), ["endings", "openings"])


TF = "tf as (select folder, term, least(count(*), 10000) as tf from po join docs using (doc_id) group by 1, 2)"
CARDS = f"{TF}, df as (select term, count(*) as df from tf group by 1), rt as (select folder, term, tf, df, round(10 * tf * case when df = n then 0.01 else ln(n / df::double) end, 6) as score from tf join df using (term), (select count(distinct folder) as n from tf))"


def _clusters(spark, sf_dir) -> DataFrame:
    return fulltext.term_counts(_postings(spark, sf_dir)).join(document_messages(spark, sf_dir).select("doc_id", "folder"), "doc_id")


@query(f"{CARDS} select folder, term, tf, df, score, rank from (select *, row_number() over (partition by folder order by score desc, term)::int as rank from rt) where rank <= 20", tokens=True)
def tfidf_cards(spark, sf_dir):
    return fulltext.top_terms(fulltext.tfidf(_clusters(spark, sf_dir), "folder"), "folder", 20)


@query(f"{TF}, rk as (select folder, row_number() over (order by folder) as n from (select distinct folder from tf)), ic as (select folder, term, tf, count(*) over (partition by term order by folder rows between unbounded preceding and current row) as df from tf) select folder, term, tf, df, round(10 * tf * case when df = n then 0.01 else ln(n / df::double) end, 6) as score from ic join rk using (folder)", tokens=True)
def tfidf_incremental(spark, sf_dir):
    return fulltext.tfidf(_clusters(spark, sf_dir), "folder", incremental=True)


@query(rf"w as (select regexp_replace(w, '[^\p{{L}}\p{{N}}]+', '', 'g') as word from (select unnest(string_split_regex(body, '\s+')) as w from docs)), c as (select word, count(*) as n from w where word <> '' and lower(word) not in {STOPS} group by 1) select word, n, round(n / (select sum(n) from c), 9) as share from c")
def word_freq(spark, sf_dir):
    return fulltext.word_frequencies(document_messages(spark, sf_dir), "body")


# Links and pages

LINKS = r"""ln as (select page_id, regexp_replace(unnest(regexp_extract_all(url || ' ' || html, 'https?:[^\s<>"'']+')), '[.,;:!?)\]]+$', '') as url from pages)"""


def _links(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(T.links_in(F.concat_ws(" ", "url", "html"))).alias("url"))


@query(f"{LINKS} select page_id, url from ln")
def links_extract(spark, sf_dir):
    return _links(spark, sf_dir)


@query(f"{LINKS} select lower(url) as url, count(*) as times from ln group by 1")
def links_counts(spark, sf_dir):
    return _links(spark, sf_dir).groupBy(F.lower("url").alias("url")).agg(F.count("*").alias("times"))


@query("select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as href from pages")
def page_hrefs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(T.hrefs(F.col("html"))).alias("href"))


DOMAINS = r"dm as (select regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z]+://', ''), '[/?:#].*$', ''), '^www[^.]*\.', '') as h from pages), dl as (select case when len(string_split(h, '.')) >= 2 then string_split(h, '.')[-2] || '.' || string_split(h, '.')[-1] else h end as domain from dm)"


@query(f"{DOMAINS}, c as (select domain, count(*) as n from dl group by 1), e as (select min(n) as low, max(n) as high from c) select domain, n, round((n + 1 - low) / (high + 1 - low)::double, 6) as weight from c, e")
def domain_weights(spark, sf_dir):
    counts = table(spark, sf_dir, "pages").groupBy(T.url_domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))
    ends = counts.agg(F.min("n").alias("low"), F.max("n").alias("high"))
    return counts.crossJoin(F.broadcast(ends)).select("domain", "n", F.round((F.col("n") + 1 - F.col("low")) / (F.col("high") + 1 - F.col("low")), 6).alias("weight"))


@query(None)
def html_texts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html_text("html").alias("text"))


# Text functions


@query("select doc_id, length(body)::int as n, len(list_filter(string_split_regex(body, '\\s+'), lambda w: w <> ''))::int as n_words, lower(subject) as subject from docs")
def text_sizes(spark, sf_dir):
    return document_messages(spark, sf_dir).select("doc_id", F.length("body").alias("n"), F.size(T.words(F.col("body"))).alias("n_words"), F.lower("subject").alias("subject"))


@query(r"select doc_id, regexp_replace(trim(regexp_replace(subject, '\s+', ' ', 'g')), '^(?i)(?:(?:re:?|\[?fwd:?|\[\S{0,17}\]) )+', '') || ' ' as subject from docs")
def subject_clean(spark, sf_dir):
    return document_messages(spark, sf_dir).select("doc_id", T.clean_subject(F.concat(F.lit("Re: [dev-list] FWD: "), "subject")).alias("subject"))


@query("select doc_id, body || chr(10) || 'The end of what was written here, in a line that is long enough to be none of a reply mark.' as body from docs")
def original_content(spark, sf_dir):
    quoted = F.concat("body", F.lit("\nThe end of what was written here, in a line that is long enough to be none of a reply mark.\nOn Monday someone wrote:\n> quoted\n> more"))
    return document_messages(spark, sf_dir).select("doc_id", F.regexp_replace(T.original_content(quoted), r"\n$", "").alias("body"))


@query("select doc_id, unnest(list_transform(list_filter(string_split_regex(body, '\\n\\s*\\n'), lambda p: trim(p) <> ''), lambda p: array_to_string(list_transform(list_filter(string_split(p, chr(10)), lambda l: l <> ''), lambda l: trim(l)), chr(10)) || chr(10))) as paragraph from docs")
def paragraphs(spark, sf_dir):
    return document_messages(spark, sf_dir).select("doc_id", F.explode(T.paragraphs(F.col("body"))).alias("paragraph"))


@query("select doc_id, 'english' as languages from docs")
def languages_by_script(spark, sf_dir):
    return document_messages(spark, sf_dir).select("doc_id", F.array_join(T.scripts_languages(F.col("body")), ",").alias("languages"))


MAILS = r"ml as (select doc_id, unnest(regexp_extract_all(body, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) as address from docs)"


@query(rf"{MAILS} select distinct doc_id, lower(address) as email, split_part(lower(address), '@', 1) as account from ml")
def email_clean(spark, sf_dir):
    found = document_messages(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("body", F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"), F.lit(1))).alias("address"))
    return found.select("doc_id", T.clean_email(F.concat(F.lit(" '"), "address", F.lit("' "))).alias("email")).withColumn("account", T.user_of(F.col("email"))).distinct()


@query(rf"{MAILS}, e as (select distinct doc_id, lower(address) as email, split_part(lower(address), '@', 2) as host from ml), first as (select email, min(host) over (partition by host) as h from e) select h as label, count(distinct email) as n_emails from first group by 1")
def contact_components(spark, sf_dir):
    found = document_messages(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("body", F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"), F.lit(1))).alias("address")).select(F.lower("address").alias("b")).withColumn("a", F.concat(F.lit(" "), F.substring_index("b", "@", -1)))
    label = people.components(found.select("a", "b").distinct())
    return label.where(F.col("node").contains("@")).groupBy(F.trim("label").alias("label")).agg(F.countDistinct("node").alias("n_emails"))


# Entities


@query(None)
def cic_entities(spark, sf_dir):
    return entities.mentions(document_messages(spark, sf_dir), "body")


SINGLE = rf"en as (select distinct doc_id, lower(e) as entity from (select doc_id, unnest(regexp_extract_all(body, '\p{{Lu}}[\p{{Ll}}]{{5,}}')) as e from docs))"


def _capital_words(spark, sf_dir) -> DataFrame:
    found = document_messages(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("body", F.lit(r"(\p{Lu}[\p{Ll}]{5,})"), F.lit(1))).alias("display"))
    return found.groupBy("doc_id", F.lower("display").alias("entity")).agg(F.min("display").alias("display"))


@query(f"{SINGLE} select entity, count(*) as n_docs from en group by 1")
def entity_freq(spark, sf_dir):
    return entities.frequencies(_capital_words(spark, sf_dir))


CO = f"{SINGLE}, df as (select entity, count(*) as df from en group by 1 having count(*) >= 3), ok as (select doc_id, entity from en join df using (entity)), co as (select a.entity as a, b.entity as b, count(*) as n from ok a join ok b using (doc_id) where a.entity < b.entity group by 1, 2)"


@query(f"{CO} select a, b, n from co")
def entity_cooccurrence(spark, sf_dir):
    return entities.cooccurrences(_capital_words(spark, sf_dir), 3)


@query(f"{CO}, bo as (select a, b, n from co union all select b, a, n from co), nr as (select a, sqrt(sum(n * n)) as norm from bo group by 1), sc as (select bo.a as entity, bo.b as other, round(n * (df / (select sum(df) from df)::double) / norm, 9) as score from bo join nr using (a) join df on df.entity = bo.b) select entity, other, score, rank from (select *, row_number() over (partition by entity order by score desc, other)::int as rank from sc) where rank <= 3")
def entity_closest(spark, sf_dir):
    found = _capital_words(spark, sf_dir)
    counts = entities.frequencies(found).where("n_docs >= 3")
    prior = counts.crossJoin(F.broadcast(counts.agg(F.sum("n_docs").alias("_all")))).select("entity", (F.col("n_docs") / F.col("_all")).alias("prior"))
    return entities.closest(entities.cooccurrences(found, 3), prior)


@query(None)
def entity_ranking(spark, sf_dir):
    return entities.ranked(entities.cooccurrences(_capital_words(spark, sf_dir), 3))


INFOS = f"{SINGLE}, nf as (select folder as archive, entity, count(*) as n_docs from en join docs using (doc_id) group by 1, 2)"


def _infos(spark, sf_dir) -> DataFrame:
    found = _capital_words(spark, sf_dir).join(document_messages(spark, sf_dir).select("doc_id", F.col("folder").alias("archive"), F.lit(None).cast("timestamp").alias("date")), "doc_id")
    return entities.across_archives(found)


@query(f"{INFOS} select archive, entity, n_docs from nf")
def xcoll_entities(spark, sf_dir):
    return _infos(spark, sf_dir).select("archive", "entity", "n_docs")


@query(f"{INFOS} select archive, entity, n_docs from nf where entity = 'eriner'")
def xcoll_search(spark, sf_dir):
    return entities.search_archives(_infos(spark, sf_dir), "eriner").select("archive", "entity", "n_docs")


@query(f"{INFOS} select entity, sum(n_docs)::bigint as n_docs from nf where contains(entity, 'ation') group by 1 order by 2 desc, 1 limit 10")
def autocomplete(spark, sf_dir):
    return entities.autocomplete(_infos(spark, sf_dir), "ation")


@query("pg as (select term, round(sum(tf), 0)::double as page_score from (select term, count(*) as tf from po where term in ('from', 'ther', 'dans', 'ou') group by doc_id, term) group by 1), ht as (select term, count(distinct doc_id) as n from po group by 1) select term, page_score * n * (case when term = 'from' then 2.0 else 1.0 end) as score from pg join ht using (term)", tokens=True)
def lens_score(spark, sf_dir):
    found = _postings(spark, sf_dir)
    pages = found.where(F.col("term").isin("from", "ther", "dans", "ou")).groupBy("term").agg(F.count("*").cast("double").alias("page_score"))
    hits = found.groupBy("term").agg(F.countDistinct("doc_id").alias("n"))
    none = spark.createDataFrame([], "term string, n long")
    return fulltext.lens(pages, hits, none, spark.createDataFrame([("from", 2.0)], "term string, boost double"))


@query(f"{SINGLE}, own as (select doc_id, list(w) as words from (select doc_id, unnest(string_split_regex(entity, '[^a-z0-9]+')) as w from en) group by 1), rn as (select doc_id, subject, coalesce(words, []) as words, regexp_extract_all(subject, '[A-Za-z0-9]+|[^A-Za-z0-9]+') as runs from docs left join own using (doc_id) where not reviewed) select doc_id, case when subject is not null then array_to_string(list_transform(runs, lambda r: case when regexp_matches(r, '^[A-Za-z0-9]') and not list_contains(words, lower(r)) then repeat('.', length(r)) else r end), '') end as subject from rn", DOCUMENT_SQL)
def redact_text(spark, sf_dir):
    messages = document_messages(spark, sf_dir)
    names = _capital_words(spark, sf_dir).groupBy("doc_id").agg(F.collect_list("entity").alias("names"))
    return export.public_copy(messages, messages.where("not reviewed"), names).select("doc_id", "subject")


@query(None)
def highlights(spark, sf_dir):
    return document_messages(spark, sf_dir).select("doc_id", *[fulltext.highlighted(F.col(c), ["the", "de"]).alias(c) for c in ("subject", "body")])


@query(None)
def mbox_export(spark, sf_dir):
    return export.mbox_text(document_messages(spark, sf_dir))
