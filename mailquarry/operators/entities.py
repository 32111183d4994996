"""Entities: capitalised phrases, counts, co-occurrence, closeness, ranking, types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Type names with their codes; places and organisations have finer kinds below them.
COARSE_TYPES = {"PERSON": 0, "PLACE": 3, "ORGANISATION": 11, "OTHER": 38}
#: Least score of an entity that counts.
LEAST_SCORE = 0.001
INNER_WORDS = ["of", "the", "and", "for", "de", "la", "von", "van", "du"]


def capitalised(text: Column) -> Column:
    """Runs of capitalised words, with small joining words inside only. A single word that stands first in a sentence or
    line counts only if it is all in capitals: there the capital says nothing."""
    inner = "|".join(INNER_WORDS)
    word, joined = r"\p{Lu}[\p{L}'’-]*", rf"[ ](?:(?:{inner})[ ])*"
    first = r"(?<![\p{L}\p{N}])"
    run = rf"{first}{word}(?:{joined}{word})+|(?<=[^.!?:\s][ \t]{{1,4}}|[(\[]){word}|{first}\p{{Lu}}{{2,}}(?![\p{{L}}\p{{N}}])"
    return F.filter(F.regexp_extract_all(text, F.lit(f"({run})"), F.lit(1)), lambda e: (F.length(e) > 2) | (e == F.upper(e)))


def mentions(docs: DataFrame, field: str, key: str = "doc_id") -> DataFrame:
    """(doc_id, entity, display): each capitalised phrase of a document once, in lower case and as first written."""
    rows = docs.select(key, F.posexplode(capitalised(F.col(field))).alias("pos", "display"))
    return rows.groupBy(key, F.lower("display").alias("entity")).agg(F.min_by("display", "pos").alias("display"))


def frequencies(found: DataFrame, names: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(entity, n_docs); names maps alternates to display names (entity, name)."""
    if names is not None:
        found = found.join(names, "entity", "left").withColumn("entity", F.coalesce("name", "entity"))
    return found.groupBy("entity").agg(F.countDistinct(key).alias("n_docs"))


def cooccurrences(found: DataFrame, least_docs: int = 2, most_docs: int | None = None, key: str = "doc_id") -> DataFrame:
    """(a, b, n), a < b: documents that mention both. Entities below least_docs meet nobody twice; hubs can be left out."""
    df = found.groupBy("entity").agg(F.countDistinct(key).alias("df")).where(F.col("df") >= least_docs)
    if most_docs:
        df = df.where(F.col("df") <= most_docs)
    own = found.select(key, "entity").distinct().join(df.select("entity"), "entity")
    return own.withColumnRenamed("entity", "a").join(own.withColumnRenamed("entity", "b"), key).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def closest(pairs: DataFrame, prior: DataFrame, k: int = 3) -> DataFrame:
    """(entity, other, score, rank): co-occurring entities by n x prior over the norm of the entity's co-occurrences."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    norm = both.groupBy("a").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    scored = both.join(norm, "a").join(prior.select(F.col("entity").alias("b"), "prior"), "b")
    score = F.round(F.col("n") * F.col("prior") / F.col("norm"), 9)
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    return scored.select(F.col("a").alias("entity"), F.col("b").alias("other"), score.alias("score"), F.col("a")).withColumn("b", F.col("other")).withColumn("rank", rank).where(F.col("rank") <= k).select("entity", "other", "score", "rank")


def ranked(pairs: DataFrame, rounds: int = 5, damping: float = 0.85) -> DataFrame:
    """(entity, rank): belief that spreads over co-occurrence, a fixed number of rounds."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    out = both.groupBy("a").agg(F.sum("n").alias("total"))
    links = both.join(out, "a").select("a", "b", (F.col("n") / F.col("total")).alias("w"))
    now = out.select(F.col("a").alias("entity"), F.lit(1.0).alias("rank"))
    for _ in range(rounds):
        sent = links.join(now, links["a"] == now["entity"]).groupBy("b").agg(F.sum(F.col("w") * F.col("rank")).alias("got"))
        now = sent.select(F.col("b").alias("entity"), (1 - damping + damping * F.col("got")).alias("rank"))
    return now


def merged_acronyms(found: DataFrame) -> DataFrame:
    """(acronym, entity): acronyms that the capitals of another mentioned phrase spell."""
    from mailquarry.functions.text import acronym_of

    short = found.where(F.col("display").rlike("^[A-Z]{3,}$")).select(F.col("display").alias("acronym")).distinct()
    long = found.where(F.col("display").contains(" ")).select("display", acronym_of(F.col("display")).alias("acronym")).distinct()
    return short.join(long, "acronym").select("acronym", F.col("display").alias("entity"))


def across_archives(found: DataFrame) -> DataFrame:
    """(archive, entity, display, first_date, last_date, n_docs) of mentions with archive and date."""
    return found.groupBy("archive", "entity").agg(F.min("display").alias("display"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct("doc_id").alias("n_docs"))


def search_archives(infos: DataFrame, query: str) -> DataFrame:
    """Entities that hold the query as text and its first word as a word, grouped by archive."""
    first = query.lower().split()[0]
    return infos.where(F.array_contains(F.split("entity", r"\s+"), first) & F.col("entity").contains(query.lower()))


def autocomplete(infos: DataFrame, part: str, k: int = 10) -> DataFrame:
    return infos.where(F.col("entity").contains(part.lower())).groupBy("entity").agg(F.sum("n_docs").alias("n_docs")).orderBy(F.desc("n_docs"), "entity").limit(k)
