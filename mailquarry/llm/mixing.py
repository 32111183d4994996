"""Temperature mixing of sources, realised as budgeted block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailquarry.llm.common import cut
from mailquarry.llm.ordering import bucket_bits, hash_bucket

SEED = 20_240_229
#: No source is repeated over so many times as often as another.
MOST_REPEATS = 1.5
#: Share of the largest possible entropy (ln of the number of sources) that the weights must reach, if repeats allow.
ENTROPY = 0.95
BLOCKS = 64
#: Sources whose table (a name and a few numbers each) may be broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Exponents tried in one pass of the search; each pass narrows the interval GRID-fold.
GRID, PASSES = 16, 6


@dataclass
class Mix:
    """The exponent, its weights' entropy, the budget in tokens, and a row for each source (see `mix`)."""

    exponent: float
    entropy: float
    budget: float
    sources: DataFrame


def n_tokens(text: Column) -> Column:
    """Tokens of a text, estimated by its runs of non-blanks (space, tab to carriage return are blank); null has none."""
    body = F.regexp_replace(text, r"^[ \t-\r]+|[ \t-\r]+$", "")
    return F.when(F.coalesce(F.length(body), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(body, r"[ \t-\r]+"))).cast("long")


def _power_sums(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """For each exponent, in one aggregate: entropy of the weights, largest ratio of repeats between two sources, and
    the passes over the source that is repeated most, if the budget is all tokens once."""
    log = F.col("log_share")
    columns = [F.min("log_share").alias("low"), F.max("log_share").alias("high")]
    for i, a in enumerate(exponents):
        columns += [F.sum(F.exp(log * a)).alias(f"z{i}"), F.sum(F.exp(log * a) * log).alias(f"s{i}")]
    r = shares.agg(*columns).first()
    return [(math.log(r[f"z{i}"]) - a * r[f"s{i}"] / r[f"z{i}"], math.exp((1 - a) * (r["high"] - r["low"])), math.exp((a - 1) * r["low"]) / r[f"z{i}"]) for i, a in enumerate(exponents)]


def exponent_for(shares: DataFrame, entropy: float | None, repeats: float | None, passes: float | None = None) -> tuple[float, float]:
    """The largest exponent in [0, 1] whose entropy is at least `entropy`, raised until repeats are within the limits.

    repeats bounds the ratio between two sources, passes the most repeated source if the budget is all tokens once. All
    three fall as the exponent grows, so they are found by repeated sectioning: each pass evaluates GRID exponents at once
    over the table of shares (log_share), which stays distributed. Returns (exponent, its entropy).
    """
    def search(holds) -> float:
        low, high = 0.0, 1.0  # holds at low; does not at high
        for _ in range(PASSES):
            grid = [low + (high - low) * i / GRID for i in range(GRID + 1)]
            good = [holds(*x) for x in _power_sums(shares, grid)]
            k = max((i for i, g in enumerate(good) if g), default=-1)
            if k in (-1, GRID):
                return grid[max(k, 0)]
            low, high = grid[k], grid[k + 1]
        return low

    exponent = 1.0 if entropy is None else search(lambda *x: x[0] >= entropy - 1e-12)
    for place, limit in ((1, repeats), (2, passes)):
        if limit is not None and _power_sums(shares, [exponent])[0][place] > limit:
            exponent = search(lambda *x: x[place] > limit)  # the last exponent that repeats too much: one section below the limit
            exponent = min(1.0, exponent + GRID ** -PASSES * 2)
    return exponent, _power_sums(shares, [exponent])[0][0]


def _read(docs: DataFrame) -> DataFrame:
    """The rows of docs as `row`, with _name (source as text, null apart), _tokens and _hash (place in the permutation)."""
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return docs.select(F.struct("*").alias("row"), name.alias("_name"), n_tokens(F.col("text")).alias("_tokens"), F.xxhash64(F.lit(SEED), "doc_id", "text").alias("_hash"))


def mix(docs: DataFrame, budget: float | None = None, entropy: float | None = ENTROPY, repeats: float | None = MOST_REPEATS, most_passes: float | None = None) -> tuple[Mix, DataFrame]:
    """Weights, quotas and cuts of the sources of docs (doc_id, text, source).

    A source's share of tokens is raised to an exponent (see exponent_for; entropy is a share of its maximum). The
    normalised weights times the budget are quotas of tokens. Without a budget it is the one that gives the source with
    the fewest repeats just one whole pass, so that no row is lost. No source is read over more than most_passes times: the
    exponent is raised for it, and a budget beyond so many passes over everything is lowered to them. A quota of q passes and a rest takes all rows q times
    and then the rows that begin before the rest in the source's keyed permutation (order of a 64-bit hash of doc_id and
    text; equal rows stand together). Sources without tokens get no weight and one pass. Returns the mix, whose sources
    have (_name, n_rows, n_tokens, weight, quota, passes, cut, open: whether a rest is taken at all), and the narrow rows.

    Running sums are formed in two steps, hash buckets first, so that a source of any size spreads over many tasks.
    """
    rows = cut(_read(docs).select(F.col("row.doc_id").cast("long").alias("doc_id"), "_name", "_tokens", "_hash"))
    totals = cut(rows.groupBy("_name").agg(F.count("*").alias("n_rows"), F.sum("_tokens").alias("n_tokens")))
    whole = totals.agg(F.sum("n_tokens"), F.count_if(F.col("n_tokens") > 0), F.sum("n_rows")).first()
    if not whole[0]:
        none = totals.select("*", F.lit(0.0).alias("weight"), F.lit(0.0).alias("quota"), F.lit(1).cast("long").alias("passes"), F.lit(0).cast("long").alias("cut"), F.lit(False).alias("open"))
        return Mix(1.0, 0.0, 0.0, none), rows
    shares = totals.where("n_tokens > 0").withColumn("log_share", F.log(F.col("n_tokens") / F.lit(float(whole[0]))))
    bound = None
    if most_passes is not None and budget is not None:
        budget = min(budget, most_passes * whole[0])
        bound = most_passes * whole[0] / budget if budget > 0 else None
    elif most_passes is not None:  # the least repeated source has one pass
        repeats = max(1.0, most_passes if repeats is None else min(repeats, most_passes))
    exponent, reached = exponent_for(shares, None if entropy is None else entropy * math.log(whole[1]), repeats, bound)
    z = shares.agg(F.sum(F.exp(F.col("log_share") * exponent))).first()[0]
    weighted = shares.withColumn("weight", F.exp(F.col("log_share") * exponent) / z)
    if budget is None:
        budget = weighted.agg(F.max(F.col("n_tokens") / F.col("weight"))).first()[0]
    quotas = weighted.withColumn("quota", F.col("weight") * F.lit(float(budget))).withColumn("passes", F.floor(F.col("quota") / F.col("n_tokens") + 1e-9).cast("long"))
    quotas = quotas.withColumn("rest", F.col("quota") - F.col("passes") * F.col("n_tokens"))
    quotas = quotas.withColumn("rest", F.when(F.col("rest") > F.col("n_tokens") * 1e-9, F.col("rest")).otherwise(0.0))
    bits = bucket_bits(whole[2])
    dealt = rows.withColumn("_bucket", hash_bucket(F.col("_hash"), bits))
    sums = dealt.groupBy("_name", "_bucket").agg(F.sum("_tokens").alias("_in"))
    starts = sums.withColumn("_start", F.sum("_in").over(Window.partitionBy("_name").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
    edge = starts.join(quotas.select("_name", "rest"), "_name").withColumn("_start", F.coalesce("_start", F.lit(0))).where("_start < rest and _start + _in >= rest")
    inside = dealt.join(edge.select("_name", "_bucket", "_start", "rest"), ["_name", "_bucket"])
    order = F.shiftrightunsigned("_hash", 1)
    begins = F.col("_start") + F.coalesce(F.sum("_tokens").over(Window.partitionBy("_name").orderBy(order, "_hash", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = inside.withColumn("_begins", begins).where("_begins < rest").groupBy("_name").agg(F.max(order).alias("cut"))
    table = quotas.join(cuts, "_name", "left").select("_name", "n_rows", "n_tokens", "weight", "quota", "passes", F.coalesce("cut", F.lit(0)).alias("cut"), F.col("cut").isNotNull().alias("open"))
    silent = totals.where("n_tokens = 0").select("*", F.lit(0.0).alias("weight"), F.lit(0.0).alias("quota"), F.lit(1).cast("long").alias("passes"), F.lit(0).cast("long").alias("cut"), F.lit(False).alias("open"))
    return Mix(exponent, reached, float(budget), cut(table.unionByName(silent))), rows


def _times() -> Column:
    """How often a row is taken: the whole passes, and one more for rows up to the cut."""
    return F.col("passes") + F.when(F.col("open") & (F.shiftrightunsigned("_hash", 1) <= F.col("cut")), 1).otherwise(0)


def _up_to(counted: DataFrame, group: list[str], value: str) -> DataFrame:
    """counted (group, _bucket, value) with _start: the sum of value over the group's earlier buckets."""
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select(*group, "_bucket", F.coalesce(F.sum(value).over(earlier), F.lit(0)).alias("_start"))


def plan(docs: DataFrame, blocks: int = BLOCKS, **how) -> DataFrame:
    """(doc_id, source, n_tokens, pass, block, place, weight) of every row that the mix takes, once for each pass.

    Each pass over a source has a permutation of its own, by a hash keyed with the pass; a row that begins at the fraction
    f of its source's quota lies in block floor(f * blocks). So each block holds all sources at their weights, within a
    document, and blocks can be read one after the other. Inside a block the rows of all sources are permuted together, and
    place is a row's number there, from 0 without gaps. Null sources are a source of their own; texts without tokens fall
    where they stand; repeated rows may swap places; an empty table gives no rows.
    """
    mixed, rows = mix(docs, **how)
    n = max(1, rows.count())
    sources = mixed.sources
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    taken = rows.join(sources, "_name").withColumn("_times", _times()).where("_times > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1)))
    keyed = taken.withColumn("_key", F.xxhash64(F.lit(SEED), "pass", "_hash")).withColumn("_bucket", hash_bucket(F.col("_key"), bucket_bits(n)))
    starts = _up_to(keyed.groupBy("_name", "pass", "_bucket").agg(F.sum("_tokens").alias("_in")), ["_name", "pass"], "_in")
    inside = F.sum("_tokens").over(Window.partitionBy("_name", "pass", "_bucket").orderBy("_key", "_hash", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    placed = keyed.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(starts, ["_name", "pass", "_bucket"])
    begins = F.col("pass") * F.col("n_tokens") + F.col("_start") + F.col("_inside")
    block = F.when(F.col("quota") > 0, F.least(F.floor(begins / F.col("quota") * blocks), F.lit(blocks - 1))).otherwise(0).cast("int")
    spot = F.xxhash64(F.lit(SEED + 1), "pass", "_hash")
    dealt = cut(placed.select("doc_id", "_name", "_tokens", "pass", block.alias("block"), "weight", spot.alias("_spot")).withColumn("_bucket", hash_bucket(F.col("_spot"), bucket_bits(n // blocks))))
    first = _up_to(dealt.groupBy("block", "_bucket").agg(F.count("*").alias("_n")), ["block"], "_n")
    rank = F.row_number().over(Window.partitionBy("block", "_bucket").orderBy("_spot", "_name", "doc_id")) - 1
    numbered = dealt.withColumn("_rank", rank).join(first, ["block", "_bucket"])
    source = F.when(F.col("_name") == "", F.lit(None)).otherwise(F.expr("substring(_name, 2)"))
    return numbered.select("doc_id", source.alias("source"), F.col("_tokens").alias("n_tokens"), F.col("pass").cast("int").alias("pass"), "block", (F.col("_start") + F.col("_rank")).alias("place"), "weight")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """docs with each row as often as the mix takes it. Texts stay where they are: a row's hash and its source's cut decide."""
    mixed, _ = mix(docs, **how)
    sources = mixed.sources.select("_name", "passes", "cut", "open")
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)  # then a large source stays spread as it lies
    kept = _read(docs).join(sources, "_name").withColumn("_n", _times()).where("_n > 0")
    return kept.withColumn("_n", F.explode(F.expr("sequence(1L, _n)"))).select("row.*")
