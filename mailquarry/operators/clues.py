"""Clues: sentences that hint at an answer, scored and picked by interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sentences(docs: DataFrame, field: str, key: str = "doc_id") -> DataFrame:
    """(doc_id, place, sentence): text between full stops, question and exclamation marks, and line ends."""
    parts = F.split(F.col(field), r"(?<=[.!?])\s+|\n+")
    return docs.select(key, F.posexplode(parts).alias("place", "sentence")).where("sentence <> ''")


def length_score(sentence: Column, low: int = 20, high: int = 200) -> Column:
    n = F.length(sentence)
    return F.when(n < low, -20.0).when(n > high, -10.0).otherwise(n / F.lit(float(high)))


def word_score(sentence: Column, favoured: list[str], each: float = 2.0) -> Column:
    """Points for each favoured word in a sentence."""
    own = F.regexp_extract_all(F.lower(sentence), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return each * F.size(F.array_intersect(own, F.array(*[F.lit(w) for w in favoured])))


def best_clues(found: DataFrame, answer: str, favoured: list[str], group: list[str], key: str = "doc_id") -> DataFrame:
    """The best sentence with the answer for each group, the answer blanked out; ties to the smaller key and place.

    The best is a maximum over rows, so groups of any size are pre-aggregated.
    """
    has = found.where(F.lower("sentence").rlike(rf"(?<!\p{{L}})\Q{answer.lower()}\E(?!\p{{L}})"))
    score = F.round(length_score(F.col("sentence")) + word_score(F.col("sentence"), favoured), 6)
    blank = F.regexp_replace("sentence", rf"(?i)(?<!\p{{L}})\Q{answer}\E(?!\p{{L}})", "_" * len(answer))
    best = F.max(F.struct(score.alias("score"), (-F.col(key)).alias("k"), (-F.col("place")).alias("p"), blank.alias("clue")))
    return has.groupBy(*group).agg(best.alias("m")).select(*group, F.col("m.score").alias("score"), (-F.col("m.k")).alias(key), F.col("m.clue").alias("clue"))


def sentiment_scores(docs: DataFrame, hits: DataFrame, favoured: list[str], key: str = "doc_id") -> DataFrame:
    """1, and 10 for each favoured and 2 for each other category of a document."""
    points = F.when(F.col("category").isin(favoured), 10).otherwise(2)
    own = hits.groupBy(key).agg(F.sum(points).alias("s"))
    return docs.select(key).join(own, key, "left").select(key, (1 + F.coalesce("s", F.lit(0))).alias("score"))


def letter_counts(words: DataFrame, column: str) -> DataFrame:
    return words.select(F.explode(F.split(F.lower(column), "")).alias("letter")).where(F.col("letter").rlike(r"\p{L}")).groupBy("letter").agg(F.count("*").alias("n"))
