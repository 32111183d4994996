"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquarry.llm.common import batches_of, crc32_of, cut, small_batches

#: Labelled rows, drawn by hash of their key, that the examples and the vocabulary are made of.
SAMPLE_ROWS = 3_000
NEIGHBOURS = 15
#: Weight of a term without any bearing on the class; its log-odds beyond 95 % confidence are added.
FLAT = 0.1
BLOCK = 64
#: Blocks that are opened first; then all whose bound reaches the k-th cosine found.
FIRST = 4
CACHE = 50_000
REJECT = 0.7
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def bearing(a: np.ndarray, df: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Weights of terms by class: FLAT, and how far the smoothed log-odds are from 0 at 95 % confidence.

    a, df: toxic examples and all examples with the term; n1, n0: toxic and other examples.
    """
    a, b = a + 0.5, df - a + 0.5
    odds = np.log(a / (n1 + 1 - a)) - np.log(b / (n0 + 1 - b))
    spread = np.sqrt(1 / a + 1 / b + 1 / (n1 + 1 - a) + 1 / (n0 + 1 - b))
    return FLAT + np.maximum(0, np.abs(odds) - 1.96 * spread)


def vector_of(words: list[str], number: dict[str, int], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers, ascending, and weights (1 + ln tf) * idf * bearing, at length 1, of the words of a text that are terms."""
    terms, tf = np.unique(np.array([number[t] for t in words if t in number], np.int64), return_counts=True)
    w = weight[terms] * (1 + np.log(tf))
    keep = w > 0
    return terms[keep], w[keep] / (math.sqrt(float(w @ w)) or 1)


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), then the same for the next."""
    ends = np.cumsum(count)
    return np.repeat(start - ends + count, count) + np.arange(ends[-1] if ends.size else 0)


class BlockMaxIndex:
    """Exact top-k by cosine over an inverted index. A term's postings lie in blocks of examples; each block of a term
    keeps its largest weight, so a block whose bound is below the k-th cosine is never opened."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK) -> None:
        self.n = len(vectors)
        heaviest = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in vectors]
        self.number = np.array(sorted(range(self.n), key=lambda i: (heaviest[i], i)), np.int64)  # like examples share blocks
        sizes = np.array([len(vectors[i][0]) for i in self.number], np.int64)
        terms = np.concatenate([vectors[i][0] for i in self.number]) if self.n else np.zeros(0, np.int64)
        weight = np.concatenate([vectors[i][1] for i in self.number]) if self.n else np.zeros(0)
        order = np.argsort(terms, kind="stable")
        self.example, self.weight = np.repeat(np.arange(self.n), sizes)[order], weight[order]
        blocks, terms = self.example // block, terms[order]
        self.n_blocks = -(-self.n // block)
        cells, first = np.unique(terms * max(self.n_blocks, 1) + blocks, return_index=True)
        self.cell_block = blocks[first]
        self.cell_start = np.append(first, len(terms))
        self.cell_most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.term_start = np.searchsorted(cells, np.arange(n_terms + 1) * max(self.n_blocks, 1))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, but: int = -1) -> list[tuple[float, int]]:
        """The k examples of the largest positive cosine, ties to the earlier one; `but` is left out."""
        if not len(terms) or not self.n:
            return []
        low = self.term_start[terms]
        held = self.term_start[terms + 1] - low
        cells, w = _spread(low, held), np.repeat(weights, held)
        of_cell = self.cell_block[cells]
        bound = np.bincount(of_cell, w * self.cell_most[cells], self.n_blocks)
        ranked = np.argsort(-bound, kind="stable")
        best: list[tuple[float, int]] = []
        done, part = np.zeros(self.n_blocks, bool), ranked[:FIRST]
        while part.size:
            chosen = np.zeros(self.n_blocks, bool)
            chosen[part] = True
            mine = chosen[of_cell]
            at, own = cells[mine], w[mine]
            count = self.cell_start[at + 1] - self.cell_start[at]
            postings = _spread(self.cell_start[at], count)
            score = np.bincount(self.example[postings], np.repeat(own, count) * self.weight[postings], self.n)
            seen = np.flatnonzero(score > 0)
            if seen.size > 4 * k:  # all of at least the k-th score, ties included
                seen = seen[score[seen] >= np.partition(score[seen], -2 * k)[-2 * k] - 1e-9]
            found = [(round(float(score[i]), 12), int(self.number[i])) for i in seen]
            best = sorted(best + [x for x in found if x[1] != but], key=lambda x: (-x[0], x[1]))[:k]
            done |= chosen
            least = best[-1][0] - 1e-9 if len(best) == k else 0.0
            part = ranked[(bound[ranked] > least) & ~done[ranked]]
        return best


@dataclass
class ToxicityModel:
    """Terms and their weights; the examples' vectors, classes and ids; the score without evidence; calibration steps."""

    number: dict[str, int]
    weight: np.ndarray
    vectors: list[tuple[np.ndarray, np.ndarray]]
    toxic: np.ndarray
    ids: np.ndarray
    no_evidence: float
    steps: tuple[np.ndarray, np.ndarray]

    def plain(self) -> tuple:
        return tuple(self.__dict__.values())


def vote(near: list[tuple[float, int]], toxic: np.ndarray, base: float) -> float:
    """The cosine-weighted share of toxic neighbours, drawn towards the base rate by one half of a full neighbour."""
    weight = sum(c for c, _ in near)
    return (sum(c for c, i in near if toxic[i]) + base / 2) / (weight + 0.5)


def calibrated(votes: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic steps (pool adjacent violators): votes and the share of toxic rows there, each pool with half a row of both."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []
    for v, y in zip(votes[order], toxic[order]):
        pools.append([float(v), float(y), 1.0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            v0, y0, n0 = pools.pop(-2)
            pools[-1] = [(v0 * n0 + pools[-1][0] * pools[-1][2]) / (n0 + pools[-1][2]), y0 + pools[-1][1], n0 + pools[-1][2]]
    x, y = np.array([p[0] for p in pools]), np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools])
    return x, np.maximum.accumulate(y) if len(y) else y


class Judge:
    """Scores texts with a model."""

    def __init__(self, number, weight, vectors, toxic, ids, no_evidence, steps) -> None:
        self.number, self.weight, self.toxic, self.ids, self.none, self.steps = number, weight, toxic, ids, no_evidence, steps
        self.index, self.seen = BlockMaxIndex(vectors, len(number)), {}

    def raw(self, text: str, but: int = -1) -> tuple[float | None, list[tuple[float, int]]]:
        near = self.index.nearest(*vector_of(words_of(text), self.number, self.weight), NEIGHBOURS, but)
        return (vote(near, self.toxic, self.none) if near else None), near

    def __call__(self, text: str | None) -> tuple[float, list[dict]]:
        """Repeated texts are scored once, as long as they are remembered."""
        text = text or ""
        key = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
        if key not in self.seen:
            if len(self.seen) >= CACHE:
                self.seen.clear()
            score, near = self.raw(text)
            if score is None:
                self.seen[key] = self.none, []
            else:
                score = float(np.interp(score, *self.steps)) if len(self.steps[0]) else score
                self.seen[key] = score, [{"doc_id": int(self.ids[i]), "cosine": c, "toxic": int(self.toxic[i])} for c, i in near[:3]]
        return self.seen[key]


def _twin_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, toxic, twin): twin is the least hash of three words in a row, which near copies mostly share."""
    for batch in batches_of(source):
        twins = []
        for text in batch.column(2).to_pylist():
            words = words_of(text)
            twins.append(min((xxhash.xxh3_64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0) >> 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(twins, pa.int64())], ["doc_id", "toxic", "twin"])


def _term_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, toxic, terms, tf) with the distinct words of a text and how often each occurs."""
    for batch in batches_of(source):
        found = [Counter(words_of(x)) for x in batch.column(2).to_pylist()]
        new = [pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new], ["doc_id", "toxic", "terms", "tf"])


def _vote_batches(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Votes that examples get with themselves left out."""

    def votes(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(*shared.value)
        place = {d: i for i, d in enumerate(judge.ids.tolist())}
        for batch in batches_of(source):
            ids = batch.column(0).to_pylist()
            found = [judge.raw(t, place[d])[0] for d, t in zip(ids, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["doc_id", "toxic", "vote"])

    return votes


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ToxicityModel | None:
    """Learns from about `rows` labelled rows of docs: labels has doc_id and toxic (0 or 1, nulls left out).

    The sample is drawn from labels by hash, so at most about `rows` keys are broadcast to find their texts. Of examples
    that look like copies one is kept for each class. All their words are terms, weighted by (1 + ln tf) * idf and by
    their bearing on the class; words that are in every example weigh nothing. Terms and the examples' vectors, bounded by
    the sample, go to the driver. The votes that examples get with themselves left out calibrate the score. None: no
    labelled text.
    """
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, rows / max(n, 1))))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(cut(known.where(drawn))), "doc_id").select("doc_id", "toxic", "text")
    texts = cut(texts.where("text is not null"))
    single = cut(texts.mapInArrow(_twin_batches, "doc_id long, toxic int, twin long").groupBy("toxic", "twin").agg(F.min("doc_id").alias("doc_id")))
    examples = cut(texts.join(F.broadcast(single.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id", "toxic").agg(F.max("text").alias("text")))
    found = examples.mapInArrow(_term_batches, "doc_id long, toxic int, terms array<string>, tf array<int>").orderBy("doc_id")
    ids, toxic, counts = [], [], []
    for r in found.toLocalIterator():
        ids.append(r["doc_id"])
        toxic.append(r["toxic"])
        counts.append(dict(zip(r["terms"], r["tf"])))
    if not ids:
        return None
    y = np.array(toxic, int)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    number: dict[str, int] = {}
    for c in counts:
        for t in c:
            number.setdefault(t, len(number))
    df, a = np.zeros(len(number)), np.zeros(len(number))
    for c, label in zip(counts, toxic):
        own = [number[t] for t in c]
        df[own] += 1
        a[own] += label
    weight = np.log((1.0 + len(y)) / (1.0 + df)) * bearing(a, df, n1, n0) if number else np.zeros(0)
    silent = [label for c, label in zip(counts, toxic) if not c]
    none = (sum(silent) + 0.5 * n1 / len(y)) / (len(silent) + 0.5)
    vectors = [vector_of([t for t, n in c.items() for _ in range(n)], number, weight) for c in counts]
    model = ToxicityModel(number, weight, vectors, y, np.array(ids, np.int64), float(none), (np.array([]), np.array([])))
    votes = examples.mapInArrow(_vote_batches(context.broadcast(model.plain())), "doc_id long, toxic int, vote double").where("vote is not null").orderBy("doc_id").collect()
    model.steps = calibrated(np.array([r["vote"] for r in votes], float), np.array([r["toxic"] for r in votes], int))
    return model


def _judge_batches(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def judge(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Judge(*shared.value)
        for batch in batches_of(source):
            found = [score(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            points = np.array([x[0] for x in found])
            new = [pa.array(points), pa.array((points >= REJECT).astype(np.int32)), pa.array([x[1] for x in found], evidence)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*batch.schema.names[:-1], "score", "predicted", "evidence"])

    return judge


def score(docs: DataFrame, model: ToxicityModel | None, held_out: str = "false") -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every row, from its whole text alone.

    score is the calibrated vote of the 15 nearest examples (all that share a term, if fewer), evidence the three nearest.
    A text without a word of any example (null and empty texts too) gets the share of toxic examples without words.
    predicted is 1 from score 0.7. With no labelled text to learn from the score is 0. Ties in cosine go to the smaller
    doc_id. Repeated rows stay repeated; an empty table gives no rows. held_out: an SQL expression that is passed on.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(held_out).alias("held_out"), F.col("text").alias("text"))
    kind = "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id:long,cosine:double,toxic:int>>"
    if model is None:
        return rows.selectExpr("doc_id", "held_out", "0.0D as score", "0 as predicted", "cast(array() as array<struct<doc_id:long,cosine:double,toxic:int>>) as evidence")
    return rows.mapInArrow(_judge_batches(docs.sparkSession.sparkContext.broadcast(model.plain())), kind)


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from labels whose crc32(doc_id as text) mod 3 is not 1 and scores all rows of docs (see `fit` and `score`,
    also for nulls, ties, repeated rows and empty tables)."""
    model = fit(docs, labels.where(F.pmod(crc32_of("doc_id"), F.lit(3)) != 1))
    return score(docs, model, "crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 3 = 1")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the model rejects (score of at least 0.7); texts are scored in place, without a shuffle.

    Null and empty texts get the score of texts without words. Repeated rows are judged alike and stay repeated, columns
    of any name pass through, an empty table gives no rows, and without a labelled text every row stays.
    """
    small_batches(docs.sparkSession)
    model = fit(docs, labels.where(F.pmod(crc32_of("doc_id"), F.lit(3)) != 1))
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())
    at = docs.columns.index("text")

    def kept(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(*shared.value)
        for batch in batches_of(source):
            yield batch.filter(pa.array([judge(t)[0] < REJECT for t in batch.column(at).to_pylist()]))

    return docs.mapInArrow(kept, docs.schema)
