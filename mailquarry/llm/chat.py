"""Preference formatting: the common turn prefix once as prompt, then both completions with their loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailquarry.llm.common import cut

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turns whose lengths are summed in one step; a conversation's running offset is the sum of whole chunks and a rest.
CHUNK = 256
#: Where turns without a number stand: after all others.
LAST = (1 << 62)


def rendered(role: Column, text: Column) -> Column:
    """A turn in the chat template. Markers inside of a text are broken by a backslash, so they stay text."""
    safe = F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("<\\|"))
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit("\n"), safe, F.lit(f"{CLOSE}\n"))


def adjacent_pairs(turns: DataFrame) -> DataFrame:
    """Pairs of conversations 2k (chosen) and 2k + 1 (rejected): (conv_id, pair_id, side)."""
    ids = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    return ids.select("conv_id", F.floor(F.col("conv_id") / 2).alias("pair_id"), F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"))


def with_swapped_answers(turns: DataFrame) -> DataFrame:
    """Conversations 2c (conversation c as it is) and 2c + 1 (c up to its last answer, then its neighbour's last answer).

    The neighbour of c is c + 1 for even and c - 1 for odd c. Where either has no answer there is no 2c + 1. This makes
    preference pairs of a table of plain conversations: the answer that was given, and one that belongs elsewhere.
    """
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    last = F.max(F.struct("turn", "text"))
    answers = rows.where("role = 'assistant' and turn is not null").groupBy("conv_id").agg(last.alias("m")).select("conv_id", F.col("m.turn").alias("last"), F.col("m.text").alias("answer"))
    others = answers.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("answer").alias("other"))
    known = answers.join(others, "conv_id").select("conv_id", "last", "other")
    twin = (F.col("conv_id") * 2 + 1).alias("conv_id")
    kept = rows.join(known, "conv_id").where("turn < last").select(twin, "turn", "role", "text")
    swapped = known.select(twin, F.col("last").alias("turn"), F.lit("assistant").alias("role"), F.col("other").alias("text"))
    every = rows.withColumn("conv_id", F.col("conv_id") * 2).unionByName(kept).unionByName(swapped)
    return cut(every.repartition("conv_id", "turn"))  # evenly, also for a long conversation; written, as it is used several times


def preference_segments(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Formats pairs of conversations, a row for each turn: a conversation of any length never sits in one task or value.

    turns: conv_id, turn, role, text. pairs: conv_id, pair_id, side (`chosen` or `rejected`; a conversation may be in
    several pairs). The prompt is the longest run of leading turn numbers at which both sides have the same turns (role
    and text, repeats counted). Its turns come once, as segment `prompt`; the others as `chosen` and `rejected`. Written
    one after the other, prompt and a completion are the training text.

    Returns pair_id, segment, turn, role, rendered, start (code points before it in its segment), loss_start, loss_end:
    the part of `rendered` that is trained on (text and end marker of assistant turns of completions; else empty: 0, 0).
    Turns without a number stand last, as one; null roles and texts are empty; repeated turns stay repeated (ordered by
    role and text). Offsets are worked out on narrow rows, and texts join them at the end. A side that is missing or empty leaves the prompt empty. Rows without conv_id are in no pair. Other
    columns are not read.
    """
    key = ["conv_id", "turn", "_rank"]
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ranked = cut(rows.withColumn("_rank", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))).withColumn("rendered", rendered(F.col("role"), F.col("text"))))
    narrow = ranked.select(*key, "role", F.length("rendered").cast("long").alias("_n"), F.xxhash64("role", "text").cast("decimal(38,0)").alias("_digest"))
    sided = pairs.select("conv_id", "pair_id", "side").join(narrow, "conv_id")
    of_side = [x for s in ("chosen", "rejected") for x in (F.count_if(F.col("side") == s).alias(f"n_{s}"), F.sum(F.when(F.col("side") == s, F.col("_digest"))).alias(f"d_{s}"))]
    turn_pairs = sided.groupBy("pair_id", "turn").agg(*of_side)
    differ = turn_pairs.where((F.col("n_chosen") != F.col("n_rejected")) | ~F.col("d_chosen").eqNullSafe(F.col("d_rejected")))
    first = differ.groupBy("pair_id").agg(F.min("turn").alias("fork"))
    split = sided.drop("_digest").join(first, "pair_id", "left").withColumn("_same", F.coalesce(F.col("turn") < F.col("fork"), F.lit(True)))
    parts = split.where("not _same or side = 'chosen'").withColumn("segment", F.when(F.col("_same"), "prompt").otherwise(F.col("side")))
    sized = parts.withColumn("_chunk", F.floor(F.col("turn") / CHUNK))
    inside = Window.partitionBy("pair_id", "segment", "_chunk").orderBy("turn", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    chunks = sized.groupBy("pair_id", "segment", "_chunk").agg(F.sum("_n").alias("_all"))
    before = chunks.select("pair_id", "segment", "_chunk", F.coalesce(F.sum("_all").over(Window.partitionBy("pair_id", "segment").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = sized.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(before, ["pair_id", "segment", "_chunk"])
    trained = (F.col("segment") != "prompt") & (F.col("role") == "assistant")
    head = F.length(F.lit(OPEN)) + F.length("role") + 1
    spans = placed.select(*key, "pair_id", "segment", "role", (F.col("_before") + F.col("_inside")).alias("start"), F.when(trained, head).otherwise(0).cast("long").alias("loss_start"), F.when(trained, F.col("_n") - 1).otherwise(0).alias("loss_end"))
    full = spans.join(ranked.select(*key, "rendered"), key)
    return full.select("pair_id", "segment", F.when(F.col("turn") < LAST, F.col("turn")).alias("turn"), "role", "rendered", "start", "loss_start", "loss_end")


ORACLE_SQL = r"""
with r as (select conv_id, turn, role, text from conversations where conv_id is not null),
an as (select conv_id, max(turn) as last, arg_max(text, (turn, text)) as answer from r where role = 'assistant' and turn is not null group by conv_id),
kn as (select a.conv_id, a.last, b.answer as other from an a join an b on xor(a.conv_id, 1) = b.conv_id),
al as (select conv_id * 2 as conv_id, turn, role, text from r union all select conv_id * 2 + 1, turn, role, text from r join kn using (conv_id) where turn < last union all select conv_id * 2 + 1, last, 'assistant', other from kn),
t as (select conv_id, conv_id // 2 as pair_id, case when conv_id % 2 = 0 then 'chosen' else 'rejected' end as side, coalesce(turn, 4611686018427387904) as turn, coalesce(role, '') as role, coalesce(text, '') as text from al),
d as (select pair_id, turn, list(role || chr(31) || text order by role, text) filter (where side = 'chosen') as c, list(role || chr(31) || text order by role, text) filter (where side = 'rejected') as r from t group by pair_id, turn),
f as (select pair_id, min(turn) as fork from d where c is distinct from r group by pair_id),
s as (select t.pair_id, turn, role, text, case when turn < coalesce(fork, 9223372036854775807) then 'prompt' else side end as segment, '<|im_start|>' || role || chr(10) || replace(text, '<|', '<\|') || '<|im_end|>' || chr(10) as rendered
      from t left join f using (pair_id) where turn >= coalesce(fork, 9223372036854775807) or side = 'chosen'),
p as (select *, coalesce(sum(length(rendered)) over (partition by pair_id, segment order by turn, role, text rows between unbounded preceding and 1 preceding), 0) as start from s)
select pair_id, segment, nullif(turn, 4611686018427387904) as turn, role, rendered, start::bigint as start,
  case when segment <> 'prompt' and role = 'assistant' then 12 + length(role) + 1 else 0 end::bigint as loss_start,
  case when segment <> 'prompt' and role = 'assistant' then length(rendered) - 1 else 0 end::bigint as loss_end from p
"""
