"""Benchmark decontamination: one automaton over benchmark word windows, one scan of each text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquarry.llm.common import batches_of, cut, small_batches, utf8

WINDOW = 10
#: Benchmark text of one automaton in bytes; a larger benchmark makes several, each with a pass of its own.
AUTOMATON_BYTES = 8_000_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: A-Z to a-z, word bytes to themselves, all else to a space
_NORMAL = bytes(b if _WORD.match(bytes([b])) else 32 for b in _LOWER)
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start:int,end:int>>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_NORMAL).split()


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, disjoint [first, last) word ranges that cover the same words."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


class WindowAutomaton:
    """Aho-Corasick over windows of word numbers; a word that no item has is number 0 and ends every match."""

    def __init__(self, items: Iterable[tuple[str, bytes | None]], window: int = WINDOW) -> None:
        self.numbers: dict[bytes, int] = {}
        of_window: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            seen = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            for i in range(max(len(seen) - window, 0) + 1 if seen else 0):
                of_window.setdefault(tuple(seen[i : i + window]), set()).add(item)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, names in of_window.items():
            self.machine.add_word(key, (len(key), sorted(names)))
        self.empty = not of_window
        if not self.empty:
            self.machine.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Ranges of hit words, and the items whose windows occur."""
        if self.empty or not words:
            return [], set()
        number, spans, items = self.numbers.get, [], set()
        for end, (n, names) in self.machine.iter(tuple([number(w, 0) for w in words])):
            spans.append((end + 1 - n, end + 1))
            items.update(names)
        return merged(spans), items


def offsets(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as [start, end) code points of the original text."""
    if not spans:
        return []
    at = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    points = lambda byte: len(text[:byte].decode("utf-8", "replace"))
    return [(points(at[a][0]), points(at[b - 1][1])) for a, b in spans]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def _result(doc: int | None, n_words: int, ranges: list[tuple[int, int]], names: Iterable[str], where: list[tuple[int, int]]) -> tuple:
    n_hit, listed = sum(b - a for a, b in ranges), sorted(set(names))
    spans = [{"start": a, "end": b} for a, b in where]
    return doc, n_words, n_hit, len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), n_hit > 0, listed, spans


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def _scanner(machine) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """machine: a broadcast list of items, of which a worker builds one automaton."""

    def scan(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = None
        for batch in batches_of(source):
            automaton = automaton or WindowAutomaton(machine.value)
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                words = words_of(text)
                ranges, names = automaton.scan(words)
                rows.append(_result(doc, len(words), ranges, names, offsets(text or b"", ranges)))
            yield _batch(rows)

    return scan


def _hit_scanner(machine) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of (doc_id, text_hash, text) the rows with hits: their items, and ranges of words with their code points."""

    def scan(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("items", pa.list_(pa.string())), ("ranges", pa.list_(pa.list_(pa.int32())))])
        automaton = None
        for batch in batches_of(source):
            automaton = automaton or WindowAutomaton(machine.value)
            rows = []
            for doc, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
                ranges, names = automaton.scan(words_of(text))
                if ranges:
                    rows.append((doc, text_hash, sorted(names), [[*r, *o] for r, o in zip(ranges, offsets(text or b"", ranges))]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return scan


def _word_counter(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(source):
        counts = pa.array([len(words_of(t)) for t in utf8(batch.column(2))], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], ["doc_id", "text_hash", "n_words"])


def _finisher(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unites what the passes found in a row: n_words, items and ranges, null without hits."""
    for batch in batches_of(source):
        rows = []
        for doc, n_words, items, ranges in zip(*(c.to_pylist() for c in batch.columns)):
            united = merged([(a, b) for a, b, _, _ in ranges or []])
            first, last = {a: x for a, _, x, _ in ranges or []}, {b: y for _, b, _, y in ranges or []}
            rows.append(_result(doc, n_words, united, items or [], [(first[a], last[b]) for a, b in united]))
        yield _batch(rows)


def item_chunks(benchmark: DataFrame, most_bytes: int = AUTOMATON_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark, repeated rows once, in lists of at most most_bytes (one longer item makes a list of its own).

    Lists are read one after the other, so the driver holds one of them and one partition of the benchmark.
    """
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("binary").alias("t")).where("i is not null and t is not null").distinct()
    chunk, room = [], most_bytes
    for row in rows.toLocalIterator():
        if chunk and len(row["t"]) > room:
            yield chunk
            chunk, room = [], most_bytes
        chunk.append((row["i"], bytes(row["t"])))
        room -= len(row["t"])
    yield chunk


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").alias("text"))


def _passes(docs: DataFrame, chunks: Iterator[list[tuple[str, bytes]]]) -> DataFrame:
    """(doc_id, text_hash, items, ranges) of the rows with hits: one written pass over docs for each list of items."""
    texts, found = _keyed(docs), []
    for chunk in chunks:
        machine = docs.sparkSession.sparkContext.broadcast(chunk)
        found.append(cut(texts.mapInArrow(_hit_scanner(machine), "doc_id long, text_hash long, items array<string>, ranges array<array<int>>")))
        machine.unpersist()
    return reduce(DataFrame.unionByName, found)


def contamination(docs: DataFrame, benchmark: DataFrame, most_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """Per row of docs: which words lie in a window of a benchmark item, with offsets in the original text.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A window is 10 consecutive words of
    an item; a shorter item is one window; an item without words has none. All windows go into one automaton of word
    numbers, so a text is scanned once and nothing is shuffled. A benchmark of more than most_bytes makes several automata
    of bounded size, each with a pass of its own over the texts; what they find is united by doc_id and a hash of the text,
    on narrow rows. Null and empty texts have no words and no hits. Items of equal text count each under its id; repeated
    rows of one item count once; items with a null id or text are left out. Repeated documents give repeated rows, an empty
    table none, an empty benchmark no hits. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    chunks = item_chunks(benchmark, most_bytes)
    first, second = next(chunks), next(chunks, None)
    if second is None:
        machine = docs.sparkSession.sparkContext.broadcast(first)
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(_scanner(machine), RESULT)
    hits = _passes(docs, chain([first, second], chunks))
    once = hits.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("items", "ranges")).alias("h"))  # repeated rows: once for each pass
    found = once.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), F.flatten("h.items").alias("items"), F.flatten("h.ranges").alias("ranges"))
    rows = _keyed(docs).mapInArrow(_word_counter, "doc_id long, text_hash long, n_words long")
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    return joined.select("doc_id", "n_words", "items", "ranges").mapInArrow(_finisher, RESULT)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, most_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """docs without the rows that hold a window of a benchmark item; see contamination for windows and nulls.

    Texts are scanned in place, without a shuffle; only a benchmark of more than most_bytes joins the keys of what goes.
    Repeated rows go or stay together; an empty table or benchmark changes nothing; other columns are kept as they are.
    """
    small_batches(docs.sparkSession)
    chunks = item_chunks(benchmark, most_bytes)
    first, second = next(chunks), next(chunks, None)
    if second is not None:
        gone = _passes(docs, chain([first, second], chunks)).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).distinct()
        packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_text"))
        return packed.join(gone, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_t")), "left_anti").select("_row.*")
    machine = docs.sparkSession.sparkContext.broadcast(first)
    at = docs.columns.index("text")

    def kept(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = None
        for batch in batches_of(source):
            automaton = automaton or WindowAutomaton(machine.value)
            yield batch.filter(pa.array([not automaton.scan(words_of(t))[0] for t in utf8(batch.column(at))]))

    return docs.mapInArrow(kept, docs.schema)


#: The same by windows as strings: every start of a window of each length that items have, joined to the documents' runs.
ORACLE_SQL = r"""
with dw as (select doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bw as (select cast(item_id as varchar) as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null and item_id is not null),
win as (select distinct item, n, array_to_string(w[i : i + n - 1], ' ') as s from (select item, w, least(len(w), 10) as n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from bw where len(w) > 0)),
lens as (select distinct n from win),
pos as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as s from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, lens where len(w) >= n)),
hit as (select doc_id, pos.n, i, item from pos join win on pos.s = win.s and pos.n = win.n),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, n, i from hit)) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed from (select distinct doc_id, item from hit) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join words using (doc_id) left join items using (doc_id)
"""
