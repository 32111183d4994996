"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquarry.llm.common import batches_of, crc32_of, cut, small_batches

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Training rows drawn by hash for each language (all rows of a language that has fewer).
SAMPLE_ROWS = 1000
ROUNDS = 3
#: Languages whose table (a name and a count) may be broadcast; more are joined by a shuffle.
BROADCAST_LANGUAGES = 100_000
FLOOR = 1e-8
UNKNOWN = "und"
#: Bytes of a model that may be broadcast: 8 for each piece and language.
MODEL_BYTES = 512 << 20
#: Words whose scores a worker remembers, and the bytes of their scores (8 for each word and language).
CACHE, CACHE_BYTES = 300_000, 64 << 20
#: Runs of letters; a longer run is cut, so that products stay in the range of a double.
_RUN = re.compile(r"[^\W\d_]{1,32}")
START = "▁"


@dataclass
class Pieces:
    """Numbers of the vocabulary's lower-case letter pieces. 0: not a piece, 1: any other single character."""

    number: dict[str, int]
    longest: int

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = sorted({p for i in range(model.get_piece_size()) if _letters(p := model.id_to_piece(i))})
        return cls({p: i + 2 for i, p in enumerate(kept)}, max(map(len, kept), default=1))

    @property
    def size(self) -> int:
        return len(self.number) + 2

    def lattice(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(i, j, numbers of the substrings from i to j) of words of one length, by j and then i."""
        get, n = self.number.get, len(words[0])
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                other = 1 if j - i == 1 else 0
                yield i, j, np.array([get(w[i:j], other) for w in words], np.int32)


def _letters(piece: str) -> bool:
    body = piece.removeprefix(START)
    return piece == START or bool(body) and body.isalpha() and body == body.lower()


def words_of(text: str | None) -> list[str]:
    return [START + w for w in _RUN.findall((text or "").lower())]


def by_length(words: Iterable[str], most: int = 20_000) -> Iterator[list[str]]:
    groups: dict[int, list[str]] = defaultdict(list)
    for w in words:
        group = groups[len(w)]
        group.append(w)
        if len(group) >= most:
            yield groups.pop(len(w))
    yield from groups.values()


def forward(pieces: Pieces, prob: np.ndarray, words: list[str]) -> np.ndarray:
    """log of the sum over all segmentations, for each word (of one length) and language. prob: (piece, language)."""
    reach = np.zeros((len(words[0]) + 1, len(words), prob.shape[1]))
    reach[0] = 1
    for i, j, ids in pieces.lattice(words):
        if ids.any():
            reach[j] += reach[i] * prob[ids]
    return np.log(reach[-1])


def expected(pieces: Pieces, prob: np.ndarray, words: list[str], weight: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in words of one length under one language's probabilities (forward-backward)."""
    n, edges = len(words[0]), [e for e in pieces.lattice(words) if e[2].any()]
    ahead, behind = np.zeros((n + 1, len(words))), np.zeros((n + 1, len(words)))
    ahead[0] = behind[n] = 1
    for i, j, ids in edges:
        ahead[j] += ahead[i] * prob[ids]
    for i, j, ids in reversed(edges):
        behind[i] += behind[j] * prob[ids]
    out, scale = np.zeros(pieces.size), weight / ahead[n]
    for i, j, ids in edges:
        out += np.bincount(ids, ahead[i] * prob[ids] * behind[j] * scale, pieces.size)
    out[0] = 0
    return out


@dataclass
class LanguageModel:
    """prob[piece, language]; languages in the order of their names."""

    pieces: Pieces
    languages: list[str]
    prob: np.ndarray


def _drawn(train: DataFrame, rows: int) -> DataFrame:
    """About `rows` rows of each language, by a hash of the key, so the draw is the same in every run."""
    counts = cut(train.groupBy("lang").agg(F.count("*").alias("n")))
    drawn = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 20)) / F.lit(float(1 << 20))
    if counts.count() <= BROADCAST_LANGUAGES:
        counts = F.broadcast(counts)  # then texts stay where they are
    return train.join(counts, "lang").where(drawn < rows / F.col("n")).drop("n")


def _normalised(uses: np.ndarray) -> np.ndarray:
    uses = uses + FLOOR * uses.sum(axis=0, keepdims=True) + 1e-3
    uses[0] = 0
    out = np.maximum(uses / uses.sum(axis=0, keepdims=True), FLOOR)
    out[0] = 0
    return out


def fit(train: DataFrame, vocabulary: str = VOCABULARY, rows: int = SAMPLE_ROWS, rounds: int = ROUNDS, most_bytes: int = MODEL_BYTES) -> LanguageModel | None:
    """Learns the piece probabilities of each language from train (doc_id, text, lang) by EM.

    Words are counted with map-side combining; each E-step runs over the distinct words of the sample on the executors
    and sends one row for each language and piece: at most languages x vocabulary, whatever the input. A model of more than most_bytes
    (some thousand languages) raises an error before anything is sent, as it would not fit the workers. None: no rows.
    """
    small_batches(train.sparkSession)
    pieces = Pieces.load(vocabulary)
    sample = _drawn(train.where("lang is not null and text is not null").select("doc_id", "text", "lang"), rows)
    split = F.explode(F.expr("regexp_extract_all(lower(text), '\\\\p{L}{1,32}', 0)"))
    counted = cut(sample.select("lang", split.alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")))
    most = most_bytes // (8 * pieces.size)
    languages = sorted(r["lang"] for r in counted.select("lang").distinct().limit(most + 1).collect())
    if len(languages) > most:
        raise ValueError(f"a model of more than {most} languages passes {most_bytes} bytes")
    if not languages:
        return None
    at = {x: i for i, x in enumerate(languages)}
    prob = _normalised(np.ones((pieces.size, len(languages))))
    for _ in range(rounds):
        shared = train.sparkSession.sparkContext.broadcast((pieces.number, pieces.longest, at, prob))
        uses = np.zeros_like(prob)
        for r in counted.mapInArrow(_e_step(shared), "lang int, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toLocalIterator():
            uses[r["piece"], r["lang"]] = r["uses"]
        prob = _normalised(uses)
    return LanguageModel(pieces, languages, prob)


def _e_step(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def step(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, longest, at, prob = shared.value
        pieces = Pieces(number, longest)
        uses: dict[int, np.ndarray] = {}
        todo: dict[int, dict[str, int]] = defaultdict(dict)

        def flush() -> None:
            for k, words in todo.items():
                own = np.ascontiguousarray(prob[:, k])
                for group in by_length(words):
                    uses[k] = uses.get(k, 0) + expected(pieces, own, group, np.array([words[w] for w in group], float))
            todo.clear()

        for batch in batches_of(source):
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                todo[at[lang]][START + word] = n
            if sum(map(len, todo.values())) > 50_000:
                flush()
        flush()
        for k, found in uses.items():
            ids = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(ids.size, k, np.int32)), pa.array(ids.astype(np.int32)), pa.array(found[ids])], ["lang", "piece", "uses"])

    return step


class Scorer:
    """Scores texts; remembers the scores of a bounded number of words."""

    def __init__(self, model: LanguageModel) -> None:
        self.model, self.place = model, {}
        self.scores = np.zeros((min(CACHE, CACHE_BYTES // (8 * len(model.languages))), len(model.languages)))

    def learn(self, words: set[str]) -> None:
        new = {w for w in words if w not in self.place}
        if len(self.place) + len(new) > len(self.scores):
            self.place.clear()
            new = words
            if len(new) > len(self.scores):
                self.scores = np.zeros((len(new), len(self.model.languages)))
        for group in by_length(sorted(new)):
            at = len(self.place)
            self.scores[at : at + len(group)] = forward(self.model.pieces, self.model.prob, group)
            self.place.update((w, at + i) for i, w in enumerate(group))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [words_of(t) for t in texts]
        self.learn(set().union(*split))
        out = []
        for text, words in zip(texts, split):
            if not words or not any(map(str.isalpha, text)):
                out.append((UNKNOWN, 0.0))
                continue
            get = self.place.__getitem__
            total = self.scores[[get(w) for w in words]].sum(axis=0)
            odds = np.exp(total - total.max())
            out.append((self.model.languages[int(odds.argmax())], float(1 / odds.sum())))
        return out


def _predictor(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def predict(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, longest, languages, prob = shared.value
        score = Scorer(LanguageModel(Pieces(number, longest), languages, prob))
        for batch in batches_of(source):
            found = score(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in found]), pa.array([x[1] for x in found])], ["doc_id", "held_out", "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: LanguageModel | None, held_out: str = "false") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, from its text alone.

    The text's letter runs are scored under each language by a forward pass that sums the probabilities of all their
    segmentations into pieces; score is the posterior under equal priors. Ties go to the first name. Null, empty and
    letterless texts, and all texts if nothing was learned, give `und` with score 0. Whole texts are scored; repeated rows
    stay repeated; an empty table gives no rows. held_out: an SQL expression over docs that is only passed on.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(held_out).alias("held_out"), F.col("text").alias("text"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast((model.pieces.number, model.pieces.longest, model.languages, model.prob))  # plain values: workers may lack the package
    return rows.mapInArrow(_predictor(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def held_out_identification(docs: DataFrame, vocabulary: str = VOCABULARY, folds: int = 5) -> DataFrame:
    """Learns from the rows whose crc32(doc_id) mod folds is not 0 and predicts all rows."""
    rest = F.pmod(crc32_of("doc_id"), F.lit(folds))
    model = fit(docs.where(rest != 0), vocabulary)
    return identify(docs, model, f"crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % {folds} = 0")
