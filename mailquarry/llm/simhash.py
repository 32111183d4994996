"""SimHash near-duplicates with pigeonring candidate filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry.llm.common import batches_of, cut, small_batches, utf8
from mailquarry.llm.components import components

BITS, SEGMENTS, WIDTH, LIMIT = 64, 4, 16, 3
WORDS, SEED = 3, 42
#: Distinct fingerprints in one candidate bucket that a task compares; larger buckets are split by further bits.
BUCKET = 4096
_CHUNK = 8192
#: chain budgets: a chain of c segments may differ in floor(c * LIMIT / SEGMENTS) bits
_BUDGET = [c * LIMIT // SEGMENTS for c in range(1, SEGMENTS + 1)]


def simhash(text: bytes | None) -> int:
    """The 64-bit fingerprint of one UTF-8 text as an unsigned number; null and texts without words give 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    at = list(accumulate((len(w) + 1 for w in words), initial=0))
    n = max(1, len(words) - WORDS + 1)
    ends = at[WORDS:] or at[-1:]
    set_bits = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for low in range(0, n, _CHUNK):
        part = zip(at[low : low + _CHUNK], ends[low : low + _CHUNK])
        h = np.array([digest(joined[a : b - 1], SEED) for a, b in part], ">u8")
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(set_bits * 2 > n).tobytes(), "big")


def _fingerprint_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(source):
        found = np.fromiter((simhash(t) for t in utf8(batch.column(1))), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long) of every row. One pass over the texts, no shuffle."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _bits(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def _bucket_rows(fps: DataFrame) -> DataFrame:
    """(seg, key, fp, free): eight buckets of 24 equal bits for each fingerprint.

    If two fingerprints differ in at most 3 bits, the ring of four 16-bit segments has one from which every chain of 1, 2,
    3, 4 segments differs in at most 0, 1, 2, 3 bits. So that segment is equal, and the next differs in one bit at most:
    one of its halves is equal too. Both bits are in the key, for each start and half. free: the bits not in the key.
    """
    rows = []
    for seg in range(SEGMENTS):
        after = (seg + 1) % SEGMENTS * WIDTH
        for half in range(2):
            fixed = ((1 << WIDTH) - 1) << (seg * WIDTH) | 0xFF << (after + 8 * half)
            key = F.shiftleft(_bits(F.col("fp"), seg * WIDTH, WIDTH), 8).bitwiseOR(_bits(F.col("fp"), after + 8 * half, 8))
            rows.append(F.struct(F.lit(seg).alias("seg"), F.xxhash64(F.lit(seg), F.lit(half), key).alias("key"), F.lit(_signed(~fixed)).alias("free")))
    return fps.select("fp", F.explode(F.array(*rows)).alias("r")).select("fp", "r.*")


def _signed(x: int) -> int:
    x &= (1 << BITS) - 1
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _quarters(free: int) -> list[int]:
    """Cuts the free bits into four masks of about equal size."""
    at = [i for i in range(BITS) if free >> i & 1]
    return [sum(1 << i for i in at[k * len(at) // 4 : (k + 1) * len(at) // 4]) for k in range(4)]


def _refined(rows: DataFrame) -> DataFrame:
    """Splits buckets by the free bits: 3 differing bits leave one of four quarters equal, so no link is lost."""
    masks = [_signed(r[0]) for r in rows.select("free").distinct().collect()]  # a fixed number: 8 * 4 ** depth at most
    subs = F.create_map(*[x for m in masks for x in (F.lit(m), F.array(*[F.lit(_signed(q)) for q in _quarters(m & ((1 << BITS) - 1))]))])
    cut_up = rows.select("seg", "key", "fp", "free", F.explode(subs[F.col("free")]).alias("q"))
    return cut_up.select("fp", "seg", F.xxhash64("key", "q", F.col("fp").bitwiseAND(F.col("q"))).alias("key"), F.col("free").bitwiseAND(F.bitwise_not("q")).alias("free"))


def _chained(differ: np.ndarray, seg: int) -> np.ndarray:
    """Which XORs pass every chain from seg; chains grow one segment at a time and only survivors are counted on."""
    alive, so_far = np.arange(differ.size), np.zeros(differ.size, np.uint8)
    for c, budget in enumerate(_BUDGET):
        part = (differ[alive] >> np.uint64((seg + c) % SEGMENTS * WIDTH)) & np.uint64(0xFFFF)
        so_far = so_far + np.bitwise_count(part)
        keep = so_far <= budget
        alive, so_far = alive[keep], so_far[keep]
        if not alive.size:
            break
    out = np.zeros(differ.size, bool)
    out[alive] = True  # the last chain is the full distance
    return out


def _few(fps: list[int], seg: int) -> Iterator[tuple[int, int]]:
    shifts = [(seg + c) % SEGMENTS * WIDTH for c in range(SEGMENTS)]
    for i, a in enumerate(fps):
        for b in fps[:i]:
            x, so_far = a ^ b, 0
            for shift, budget in zip(shifts, _BUDGET):
                so_far += (x >> shift & 0xFFFF).bit_count()
                if so_far > budget:
                    break
            else:
                yield a, b


def bucket_links(fps: np.ndarray, seg: int) -> Iterator[tuple[int, int]]:
    """Links that join what is joined in one bucket: a spanning forest, not all pairs. fps: distinct uint64."""
    if fps.size <= 6:
        yield from _few(fps.tolist(), seg)
        return
    todo = fps
    while todo.size > 1:
        stack, todo = [todo[0]], todo[1:]
        while stack and todo.size:
            x = stack.pop()
            near = _chained(todo ^ x, seg)
            if near.any():
                found, todo = todo[near], todo[~near]
                stack.extend(found)
                yield from ((int(x), int(y)) for y in found)


def _link_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a bucket may go on in the next batch."""

    def rows() -> Iterator[tuple[int, int, int]]:
        for batch in batches_of(source):
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy().view(np.uint64).tolist())

    out: list[tuple[int, int]] = []
    for (_, seg), bucket in groupby(rows(), key=lambda r: r[:2]):
        fps = [r[2] for r in bucket]
        if len(fps) > 1:
            out += bucket_links(np.array(fps, np.uint64), seg)
        if len(out) > 20_000:
            yield _edges(out)
            out = []
    if out:
        yield _edges(out)


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(pairs, np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links. fps: distinct fp."""
    rows = _bucket_rows(fps)
    small = []
    for _ in range(5):  # then at most 13 bits are free, and a bucket has 8192 fingerprints at most
        hot = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("key"))
        if hot.isEmpty():
            break
        small.append(rows.join(hot, "key", "left_anti").select("fp", "seg", "key", "free"))
        rows = _refined(rows.join(hot, "key", "left_semi").select("fp", "seg", "key", "free"))
    for part in small:
        rows = rows.unionByName(part)
    return rows.select("key", "seg", "fp").repartition("key").sortWithinPartitions("key", "seg").mapInArrow(_link_batches, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs.

    Copies share a fingerprint and are one node, so no pairs of copies are made. Links (3 or fewer differing bits) are
    found among distinct fingerprints through 24-bit pigeonring buckets and kept as spanning forests; the components are
    contracted with `components`. component_id is the least key reachable. Null and empty texts have fingerprint 0 and
    link to whatever is within 3 bits of it. Repeated rows stay repeated; an empty table gives no rows; a null key counts
    in no minimum (a component of null keys alone has a null id). Other columns of docs are not read.
    """
    of_doc = cut(fingerprints(docs, key, text))
    fps = cut(of_doc.groupBy("fp").agg(F.min("doc_id").alias("low")))
    label = components(links(fps.select("fp"), bucket).distinct())
    named = fps.join(label, fps["fp"] == label["node"], "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("low").alias("component_id"))
    owner = named.join(least, "label").select("fp", "component_id")
    return of_doc.join(owner, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """docs with one row of each component: that of the least doc_id (one of its rows if it is repeated).

    Rows without doc_id belong to no component and stay.
    """
    named = near_duplicates(docs.where("doc_id is not null"), bucket=bucket)
    heads = named.where("doc_id = component_id").select(F.col("doc_id").alias("_head")).distinct()
    kept = docs.join(heads, docs["doc_id"].cast("long") == heads["_head"], "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))
