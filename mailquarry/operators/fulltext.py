"""Full-text search: analysed tokens, postings, query algebra, TF-IDF, lexicons."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from mailquarry.functions.stem import stem
from mailquarry.operators.query import found_by, scored

# Words that the index leaves out.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with"]
#: Hits of one query, by score, unless a caller asks for another number.
MOST_HITS = 10_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, possessive endings cut, with stop words still in."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), r"['’]s\b", ""), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


@F.pandas_udf(StringType())
def stemmed(words: pd.Series) -> pd.Series:
    known = {w: stem(w) for w in words.dropna().unique()}
    return words.map(known)


def postings(docs: DataFrame, field: str, key: str = "doc_id", stems: bool = False) -> DataFrame:
    """(doc_id, term, pos): each occurrence of an analysed term; positions count stop words, which are left out."""
    rows = docs.select(key, F.posexplode(tokens(F.col(field))).alias("pos", "term")).where(~F.col("term").isin(STOP_WORDS))
    if not stems:
        return rows
    terms = rows.select("term").distinct().withColumn("stem", stemmed("term"))  # each distinct word is stemmed once
    return rows.join(terms, "term").select(key, "pos", F.col("stem").alias("term"))


def term_counts(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.groupBy(key, "term").agg(F.count("*").alias("tf"))


def holding(found: DataFrame, query: str, key: str = "doc_id") -> DataFrame:
    """Keys of the documents that a query finds (see `query.parsed` for its language); found: postings."""
    return found_by(found, query, frozenset(STOP_WORDS), key).select(key)


def best(found: DataFrame, query: str, n_docs: int, most: int = MOST_HITS, key: str = "doc_id") -> DataFrame:
    """(key, score) of the `most` best documents for a query, best first."""
    return scored(found_by(found, query, frozenset(STOP_WORDS), key), n_docs, key, most)


def token_regex(found: DataFrame, pattern: str, key: str = "doc_id") -> DataFrame:
    """Documents with an analysed token that the pattern matches as a whole."""
    return found.where(F.col("term").rlike(f"^(?:{pattern})$")).select(key).distinct()


def spanning_regex(docs: DataFrame, pattern: str, fields: list[str], key: str = "doc_id") -> DataFrame:
    test = F.lit(False)
    for f in fields:
        test = test | F.coalesce(F.col(f).rlike(pattern), F.lit(False))
    return docs.where(test).select(key)


def at_least(counts: DataFrame, terms: list[str], least: int, key: str = "doc_id") -> DataFrame:
    """Documents with `least` occurrences of the terms together."""
    return counts.where(F.col("term").isin(terms)).groupBy(key).agg(F.sum("tf").alias("tf")).where(F.col("tf") >= least)


def tfidf(counts: DataFrame, cluster: str, incremental: bool = False) -> DataFrame:
    """(cluster, term, tf, df, score): 10 tf idf over clusters; idf is ln(N / df), 0.01 where all have the term.

    Incremental: N and df count only clusters up to the own one, in order; the window is by term, never global.
    """
    tf = counts.groupBy(cluster, "term").agg(F.least(F.sum("tf"), F.lit(10_000)).alias("tf"))
    if incremental:
        # the number of clusters so far is a small table: one row for each cluster
        ranks = tf.select(cluster).distinct().withColumn("n", F.row_number().over(Window.orderBy(cluster)))
        df = F.count("*").over(Window.partitionBy("term").orderBy(cluster).rowsBetween(Window.unboundedPreceding, 0))
        rated = tf.withColumn("df", df).join(ranks, cluster)
    else:
        dfs = tf.groupBy("term").agg(F.count("*").alias("df"))
        rated = tf.join(dfs, "term").crossJoin(F.broadcast(tf.agg(F.countDistinct(cluster).alias("n"))))
    idf = F.when(F.col("df") == F.col("n"), 0.01).otherwise(F.log(F.col("n") / F.col("df")))
    return rated.select(cluster, "term", "tf", "df", F.round(10 * F.col("tf") * idf, 6).alias("score"))


def top_terms(rated: DataFrame, cluster: str, k: int, taboo: list[str] | None = None) -> DataFrame:
    kept = rated
    for t in taboo or []:
        kept = kept.where(~F.lit(t).contains(F.col("term")))
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("score"), "term"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k)


def word_frequencies(docs: DataFrame, field: str) -> DataFrame:
    """(word, n, share): words between blanks without punctuation and stop words, case kept."""
    words = docs.select(F.explode(F.split(F.col(field), r"\s+")).alias("w")).select(F.regexp_replace("w", r"[^\p{L}\p{N}]+", "").alias("word")).where((F.col("word") != "") & ~F.lower("word").isin(STOP_WORDS))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all")))).select("word", "n", F.round(F.col("n") / F.col("_all"), 9).alias("share"))


def expanded(lexicon: dict[str, str]) -> dict[str, list[str]]:
    """Categories and their terms: `a|{other}|b` takes in another category, which then is no category of its own."""
    used: set[str] = set()

    def terms(category: str, above: tuple[str, ...]) -> list[str]:
        out: list[str] = []
        for t in (x.strip() for x in lexicon[category].split("|")):
            inner = t[1:-1] if t.startswith("{") and t.endswith("}") else None
            if inner is None:
                out += [t.lower()] if t else []
            elif inner in lexicon and inner not in above:
                used.add(inner)
                out += terms(inner, (*above, inner))
        return out

    found = {c: list(dict.fromkeys(terms(c, (c,)))) for c in lexicon}
    return {c: ts for c, ts in found.items() if c not in used}


def lexicon_hits(found: DataFrame, lexicon: dict[str, list[str]], key: str = "doc_id") -> DataFrame:
    """(doc_id, category): documents that hold a term of a category (phrases as neighbouring terms)."""
    spark = found.sparkSession
    single = [(c, t) for c, ts in lexicon.items() for t in ts if " " not in t]
    out = found.join(F.broadcast(spark.createDataFrame(single or [("", "")], "category string, term string")), "term").select(key, "category").distinct()
    for c, ts in lexicon.items():
        for t in ts:
            if " " in t:
                out = out.unionByName(holding(found, f'"{t}"', key).withColumn("category", F.lit(c)))
    return out.distinct()


def lexicon_counts(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    return hits.groupBy("category").agg(F.countDistinct(key).alias("n_docs"))


def without_category(docs: DataFrame, hits: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.select(key).join(hits.select(key), key, "left_anti")


def with_all(hits: DataFrame, categories: list[str], key: str = "doc_id") -> DataFrame:
    return hits.where(F.col("category").isin(categories)).groupBy(key).agg(F.countDistinct("category").alias("n")).where(F.col("n") == len(set(categories))).select(key)


def highlighted(text: Column, terms: list[str]) -> Column:
    either = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
    return F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}])({either})(?![\p{{L}}\p{{N}}])", "<B>$1</B>")


def query_parts(query: str) -> list[str]:
    """The parts of a query: a quoted phrase as it is, else alternatives, else neighbouring words in pairs without join words."""
    if re.fullmatch(r'"[^"]+"', query.strip()):
        return [query.strip()[1:-1]]
    if "|" in query:
        return [p.strip() for p in query.split("|") if p.strip()]
    words = [w for w in query.split() if w.lower() not in STOP_WORDS]
    return [f"{a} {b}" for a, b in zip(words, words[1:])] or words


def lens(pages: DataFrame, hits: DataFrame, in_book: DataFrame, boosts: DataFrame) -> DataFrame:
    """(term, score): page score x (100 x documents of address book names + content hits) x user boost (1 unless set).

    pages: term, page_score. hits, in_book: term, n. boosts: term, boost.
    """
    joined = pages.join(hits.toDF("term", "n_hits"), "term", "left").join(in_book.toDF("term", "n_book"), "term", "left").join(boosts, "term", "left")
    return joined.select("term", (F.col("page_score") * (100 * F.coalesce("n_book", F.lit(0)) + F.coalesce("n_hits", F.lit(0))) * F.coalesce("boost", F.lit(1.0))).alias("score"))
