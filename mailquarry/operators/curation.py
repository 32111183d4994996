"""Curation: keywords, authorities, variants, boosts, and transfers between archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upserted(existing: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The rows of the largest version of each key."""
    rest = [c for c in existing.columns if c != key]
    both = existing.unionByName(new)
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def transferred(messages: DataFrame, other: DataFrame, signature: str, columns: list[str]) -> DataFrame:
    """messages with the marks of the other archive's message of equal signature (the largest, if there are several), else their own."""
    marks = other.groupBy(signature).agg(*[F.max(c).alias(f"_{c}") for c in columns])
    joined = messages.join(marks, signature, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in messages.columns])


def boosts(events: DataFrame) -> DataFrame:
    """(term, boost): 1 and one more for each boost since the last cancel; 0 if cancelled and not boosted again.

    events: term, at, kind (`boost`, `cancel`).
    """
    last = events.where("kind = 'cancel'").groupBy("term").agg(F.max("at").alias("_c"))
    after = events.join(last, "term", "left").groupBy("term").agg(F.count_if((F.col("kind") == "boost") & (F.col("_c").isNull() | (F.col("at") > F.col("_c")))).alias("n"), F.max(F.col("_c").isNotNull()).alias("gone"))
    return after.select("term", F.when(F.col("gone") & (F.col("n") == 0), 0.0).otherwise(1.0 + F.col("n")).alias("boost"))


def variant_weights(rows: DataFrame) -> DataFrame:
    """(word, variant, weight): how often words of titles meet words of their variants. rows: title, variant, weight."""
    pairs = rows.select("weight", F.explode(F.split(F.lower("title"), r"\s+")).alias("word"), "variant").select("weight", "word", F.explode(F.split(F.lower("variant"), r"\s+")).alias("variant"))
    return pairs.where("word <> variant").groupBy("word", "variant").agg(F.sum("weight").alias("weight"))


def with_keywords(attachments: DataFrame, keywords: DataFrame, asked: list[str]) -> DataFrame:
    """Attachments with one of the keywords. keywords: doc_id, pos, keyword."""
    hits = keywords.where(F.lower("keyword").isin([k.lower() for k in asked])).select("doc_id", "pos").distinct()
    return attachments.join(hits, ["doc_id", "pos"], "left_semi")


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """A seeded order of rows as a sortable column: a hash of seed and key, so it needs no sort to be reproducible."""
    return rows.withColumn("order_key", F.xxhash64(F.lit(seed), key))


def covered_terms(found: DataFrame, rated: DataFrame, cover: int = 4) -> DataFrame:
    """Terms of two characters at least, without @, that some document needs: one in which fewer than `cover` better terms occur.

    found: doc_id, term. rated: term, score. Ranks are taken within a document, whose terms are bounded by its length.
    """
    own = found.select("doc_id", "term").distinct().join(rated.where((F.length("term") >= 2) & ~F.col("term").contains("@")), "term")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "term"))
    return own.withColumn("rank", rank).where(F.col("rank") <= cover).select("term").distinct()


def term_colours(found: DataFrame, closest: DataFrame) -> DataFrame:
    """(term, group_id, weight): the likeness of a term's documents to groups, summed. closest: doc_id, group_id, jaccard."""
    return found.select("doc_id", "term").distinct().join(closest, "doc_id").groupBy("term", "group_id").agg(F.round(F.sum("jaccard"), 6).alias("weight"))


def names_by_type(found: DataFrame, types: DataFrame) -> DataFrame:
    """(type, n_names, n_docs) of names with just one type. found: doc_id, entity. types: entity, type."""
    clear = types.groupBy("entity").agg(F.countDistinct("type").alias("k"), F.min("type").alias("type")).where("k = 1").select("entity", "type")
    return found.join(clear, "entity").groupBy("type").agg(F.countDistinct("entity").alias("n_names"), F.countDistinct("doc_id").alias("n_docs"))
