"""Typing of names: token mixtures learned from a gazette by EM, and labelling of capitalised phrases."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from mailquarry.functions.text import words
from mailquarry.operators.lineage import cut

#: Longest phrase in tokens, longest segment, and types that are tried for a token.
MOST_TOKENS, MOST_SEGMENT, TOP_TYPES = 9, 7, 5
SMOOTHING = 0.2
LEAST_TYPE = 0.1
#: What an unknown token in a segment leaves of its score.
UNKNOWN = 0.9
SPANS = ArrayType(StructType([StructField("text", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("type", StringType()), StructField("score", DoubleType())]))
_PHRASE = re.compile(r"(?<!\w)[A-ZÀ-ÖØ-Þ][\w'’-]*(?: (?:(?:of|the|and|for|de|la|von|van|du) )*[A-ZÀ-ÖØ-Þ][\w'’-]*)*")


def token_features(gazette: DataFrame) -> DataFrame:
    """(title, token, feature): for each token of a title its type (T), left and right neighbour (L, R)."""
    rows = gazette.select("title", "type", words(F.lower("title")).alias("w")).where(F.size("w").between(1, MOST_TOKENS))
    each = rows.select("title", "type", "w", F.posexplode("w").alias("i", "token")).where((F.length("token") > 1) & ~F.col("token").rlike("^[0-9]+$"))
    near = lambda k: F.coalesce(F.get("w", F.col("i") + k), F.lit("^"))
    return each.select("title", "token", F.explode(F.array(F.concat(F.lit("T:"), "type"), F.concat(F.lit("L:"), near(-1)), F.concat(F.lit("R:"), near(1)))).alias("feature"))


def train(gazette: DataFrame, rounds: int = 3, least: int = 1) -> DataFrame:
    """(token, feature, weight, seen): expected counts after EM.

    Each title is taken to be coined by one of its tokens. The E-step weighs a title's tokens by how well their features
    are explained, the M-step sums weights by token and feature: two aggregates and a join in each round, all distributed.
    """
    features = token_features(gazette)
    often = features.groupBy("token").agg(F.countDistinct("title").alias("k")).where(F.col("k") >= least).select("token")
    features = cut(features.join(often, "token").distinct())
    n_features = features.select("feature").distinct().count()
    share = features.select("title", "token").distinct()
    sizes = share.groupBy("title").agg(F.count("*").alias("k"))
    weight = share.join(sizes, "title").select("title", "token", (1.0 / F.col("k")).alias("r"))
    for _ in range(rounds):
        seen = weight.groupBy("token").agg(F.sum("r").alias("seen"))
        counts = features.join(weight, ["title", "token"]).groupBy("token", "feature").agg(F.sum("r").alias("weight")).join(seen, "token")
        likely = F.log((F.col("weight") + SMOOTHING) / (F.col("seen") + SMOOTHING * n_features))
        fit = features.join(counts, ["token", "feature"]).groupBy("title", "token", "seen").agg(F.sum(likely).alias("l")).withColumn("l", F.col("l") + F.log("seen"))
        top = fit.groupBy("title").agg(F.max("l").alias("m"))
        mass = fit.join(top, "title").select("title", "token", F.exp(F.col("l") - F.col("m")).alias("e"))
        total = mass.groupBy("title").agg(F.sum("e").alias("t"))
        weight = cut(mass.join(total, "title").select("title", "token", (F.col("e") / F.col("t")).alias("r")))
    seen = weight.groupBy("token").agg(F.sum("r").alias("seen"))
    return features.join(weight, ["title", "token"]).groupBy("token", "feature").agg(F.sum("r").alias("weight")).join(seen, "token")


def type_table(model: DataFrame) -> DataFrame:
    """(token, type, p): the types of each token with their share, the TOP_TYPES largest."""
    from pyspark.sql import Window

    types = model.where(F.col("feature").startswith("T:")).select("token", F.expr("substring(feature, 3)").alias("type"), "weight")
    total = types.groupBy("token").agg(F.sum("weight").alias("t"))
    rated = types.join(total, "token").where("t > 0").select("token", "type", F.round(F.col("weight") / F.col("t"), 9).alias("p"))
    return rated.withColumn("k", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("p"), "type"))).where(F.col("k") <= TOP_TYPES).drop("k")


def label_phrase(phrase: str, types: dict[str, dict[str, float]], exact: dict[str, str] | None = None) -> list[tuple[int, int, str, float]]:
    """Segments (start, end, type, score) of a phrase, by the segmentation of the largest value.

    A phrase of the gazette keeps its type. Else a segment of up to 7 tokens that starts and ends with a capital scores,
    for a type, the mean share of the type over its known tokens, less for each unknown one. Each token of a segment adds
    that score, each segment costs a little, and a token that is left out adds next to nothing.
    """
    known = (exact or {}).get(phrase.lower())
    if known:
        return [(0, len(phrase), known, 1.0)]
    tokens = [(m.group(), m.start(), m.end()) for m in re.finditer(r"\S+", phrase)]
    best: list[tuple[float, list]] = [(0.0, [])]
    for j in range(1, len(tokens) + 1):
        options = [(best[j - 1][0] + 0.05, best[j - 1][1])]
        for i in range(max(0, j - MOST_SEGMENT), j):
            if tokens[i][0][0].islower() or tokens[j - 1][0][0].islower():
                continue
            own = [o for t, _, _ in tokens[i:j] if (o := types.get(t.lower()))]
            rated = {x: sum(o.get(x, 0.0) for o in own) / len(own) * UNKNOWN ** (j - i - len(own)) for x in {x for o in own for x in o}}
            kind, p = max(rated.items(), key=lambda x: (x[1], x[0]), default=("", 0.0))
            if p >= LEAST_TYPE:
                options.append((best[i][0] + (j - i) * p - 0.1, [*best[i][1], (tokens[i][1], tokens[j - 1][2], kind, p)]))
        best.append(max(options, key=lambda o: (o[0], -len(o[1]))))
    return best[-1][1]


def recognised(docs: DataFrame, field: str, model: DataFrame, gazette: DataFrame | None = None, most_tokens: int = 200_000) -> DataFrame:
    """docs with `entities`: spans of the capitalised phrases that the model can type.

    The type table and the gazette go to the workers if they have at most most_tokens rows each; a larger model or gazette
    raises an error, and the model's rare tokens are to be left out in training (`least`).
    """
    table = type_table(model).limit(most_tokens + 1).collect()
    if len(table) > most_tokens:
        raise ValueError(f"the model has more than {most_tokens} rows; raise `least` in train")
    types: dict[str, dict[str, float]] = {}
    for r in table:
        types.setdefault(r["token"], {})[r["type"]] = r["p"]
    titles = gazette.limit(most_tokens + 1).collect() if gazette is not None else []
    if len(titles) > most_tokens:
        raise ValueError(f"the gazette has more than {most_tokens} titles")
    exact = {r["title"].lower(): r["type"] for r in titles}

    @F.pandas_udf(SPANS)
    def label(texts: pd.Series) -> pd.Series:
        def spans(text):
            out = []
            for m in _PHRASE.finditer(text or ""):
                for a, b, kind, p in label_phrase(m.group(), types, exact):
                    out.append({"text": m.group()[a:b], "start": m.start() + a, "end": m.start() + b, "type": kind, "score": p})
            return out

        return texts.map(spans)

    return docs.withColumn("entities", label(field))


def span_lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Entities as `text;start;end;type;score` lines."""
    return docs.select(key, F.explode("entities").alias("e")).select(key, F.concat_ws(";", "e.text", F.col("e.start").cast("string"), F.col("e.end").cast("string"), "e.type", F.round("e.score", 4).cast("string")).alias("line"))


def type_counts(docs: DataFrame, least: float = 0.001) -> DataFrame:
    """Distinct texts and mentions of each type with a sufficient score."""
    return docs.select(F.explode("entities").alias("e")).where(F.col("e.score") >= least).groupBy(F.col("e.type").alias("type")).agg(F.countDistinct(F.lower("e.text")).alias("n_texts"), F.count("*").alias("n_mentions"))
