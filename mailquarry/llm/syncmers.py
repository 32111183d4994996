"""Document fingerprints from closed syncmers, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry.llm.ordering import with_next

#: A k-mer is K tokens, an inner substring S.
K, S = 5, 2
#: Characters of a token; only where so many in a row start none does a cut depend on the one before.
LONGEST = 32
#: A token starts at every code point of this class, wherever it stands: Latin-1 code points divisible by 6, parts of the
#: alphabets from U+0380 on by stripes of 8 in 64, and each character from U+1200 on (scripts without blanks among them).
_LATIN = "".join(f"\\x{c:02x}" for c in range(0x20, 0x100) if c % 6 == 0)
_STRIPES = "".join(f"\\u{c:04x}-\\u{c + 7:04x}" for c in range(0x380, 0x1200, 64))
STARTS = f"(?:[{_LATIN}]|(?![\\x00-\\xff])[{_STRIPES}\\u1200-\\x{{10ffff}}])"
#: Bits of a hash in a fingerprint.
HASH_BITS = 40


def tokens(text: Column) -> Column:
    """The text cut before each code point of STARTS: cuts depend on the character alone, with or without blanks."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).(?:(?!{STARTS}).){{0,{LONGEST - 1}}}"), F.lit(0))


def placed_syncmers(hashes: Column) -> Column:
    """(place, hash) of the closed syncmers of an array of token hashes.

    A k-mer is chosen if its least inner substring (of S tokens) is its first or last one. That depends on the k-mer
    alone, so an edit changes no choice outside of the k-mers that it touches. Fewer than K tokens are one k-mer.
    place: the number of the k-mer's first token, from 0.
    """
    pairs = lambda h: F.zip_with(h, F.slice(h, S, F.size(h)), lambda a, b: F.xxhash64(a, b))
    last = K - S

    def chosen(inner: Column, i: Column) -> Column:
        return F.least(F.get(inner, i), F.get(inner, i + last)) <= F.least(*[F.get(inner, i + j) for j in range(1, last)])

    def placed(h: Column) -> Column:
        starts = _let(pairs(h), lambda inner: F.filter(F.sequence(F.lit(0), F.size(h) - K), lambda i: chosen(inner, i)))
        return F.transform(starts, lambda i: F.struct(i.alias("place"), F.xxhash64(*[F.get(h, i + j) for j in range(K)]).alias("hash")))

    return F.when(F.size(hashes) >= K, placed(hashes)).when(F.size(hashes) > 0, F.array(F.struct(F.lit(0).alias("place"), F.xxhash64(hashes).alias("hash")))).otherwise(F.array().cast("array<struct<place:int,hash:bigint>>"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def syncmers(hashes: Column) -> Column:
    """Hashes of the closed syncmers of an array of token hashes, in order."""
    return F.transform(placed_syncmers(hashes), lambda s: s["hash"])


def sketched(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds an array of all distinct syncmer hashes (HASH_BITS bits), ascending. Null texts count as empty."""
    hashed = df.withColumn("_hashes", F.transform(tokens(F.coalesce(F.col(text), F.lit(""))), lambda t: F.xxhash64(t)))
    cut_down = F.transform(syncmers(F.col("_hashes")), lambda h: F.shiftrightunsigned(h, 64 - HASH_BITS))
    return hashed.withColumn(name, F.sort_array(F.array_distinct(cut_down))).drop("_hashes")


def as_text(sketch: Column) -> Column:
    """A sketch as hexadecimal digits; texts without tokens give the empty string."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), HASH_BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of syncmers; two empty sets are alike."""
    share = lambda both: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))
    return _let(F.size(F.array_intersect(a, b)), share)


def anchors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, place, hash) of every syncmer of every row of docs; one pass, no shuffle. Hashes have all 64 bits."""
    hashed = docs.select(F.col(key).alias("doc_id"), F.transform(tokens(F.coalesce(F.col(text), F.lit(""))), lambda t: F.xxhash64(t)).alias("_hashes"))
    return hashed.select("doc_id", F.explode(placed_syncmers(F.col("_hashes"))).alias("s")).select("doc_id", "s.*")


def matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc_id, place, other_id, other_place): every anchor of left that stands in right, with both places.

    A shared passage shows as neighbouring places with one difference of place. Tables come from `anchors`.
    """
    return left.join(right.select(F.col("doc_id").alias("other_id"), F.col("place").alias("other_place"), "hash"), "hash").select("doc_id", "place", "other_id", "other_place")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row of docs; one pass, no shuffle. Equal texts have equal fingerprints."""
    return sketched(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "text", "_s").select("doc_id", as_text(F.col("_s")).alias("fingerprint"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with their likeness.

    Edited: the last floor(n_chars / 2) code points are replaced by the first as many (or all) of the text of the next
    row in descending doc_id (repeated ids by text; after the last row the first). Null texts count as empty, null ids
    come last. A table of one row is its own next; an empty table gives no rows. Other columns are not read. Texts are
    shuffled once, by ranges of doc_id, and sketched where they then lie, so that a row's neighbour brings its sketch.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    paired = with_next(rows, "doc_id", ["text"], ["text", "sketch"], lambda dealt: sketched(dealt, "text", "sketch"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = paired.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))).drop("text", "next_text")
    both = sketched(edited, "edited", "edited_sketch")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
