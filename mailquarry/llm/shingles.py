"""SimHash near-duplicates at a likeness of 0.8: wide fingerprints of word shingles, met by equal segments of a pigeonring.

At a Jaccard coefficient of 0.8 two fingerprints differ in 15.2 % of their bits (up to 18.8 % where sets have about five
shingles), so of 64 bits no long segment need be equal. Here fingerprints have 187 segments of 14 bits, of which such a pair
has 19 equal ones on average (10 in very small sets). Texts meet where a segment is equal and the chains from it on the
ring of segments stay within their share of the limit; then the full distance and the exact coefficient are tested.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquarry.llm.common import batches_of, cut, small_batches, utf8
from mailquarry.llm.components import components

WORDS, LEAST, SEED = 5, 0.8, 42
#: Of 400 simulated pairs at LEAST of each of five sizes none had no equal segment with chains in budget; they had 9 on
#: average in sets of 4 and 5 shingles, 15 to 24 in larger ones.
SEGMENTS, WIDTH = 187, 14
#: Bits in which two fingerprints may differ (22 %), and segments of a chain after the equal one that are looked at.
LIMIT, CHAIN = 576, 8
#: Rows of a bucket whose pairs are always counted; more than DENSE pairs, or in larger buckets rows near one, are dense.
RUN, DENSE = 64, 10
#: Nodes that are dealt at a time, and about the rows of one part of a segment.
DEALT, PART_ROWS = 8192, 65_536
#: What buckets give is packed by bins of nodes: about the nodes of one bin, the least number of bins, bytes packed at a time.
BIN_NODES, LEAST_BINS, PACKED_BYTES = 16_384, 32, 8 << 20
#: Edges that one task contracts to components, which takes one job and not several for each round.
ONE_TASK = 1_000_000
#: Hashes of the sets in one block of a home.
HOME_HASHES = 2_000_000
#: Rows of a key table (two numbers) that may be broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 500_000
#: Pigeonring: chains of c segments, the equal one included, may differ in floor(c * LIMIT / SEGMENTS) bits.
_BUDGET = [c * LIMIT // SEGMENTS for c in range(CHAIN + 2)]
_ROW = np.dtype([("key", "<u2"), ("node", "<i8"), ("c0", "<u8"), ("c1", "<u8")])
_LONGS = -(-SEGMENTS * WIDTH // 64)
_FACTORS = np.random.default_rng(SEED).integers(1 << 63, size=_LONGS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANES = np.uint64(0x0101010101010101)
_TIES = np.random.default_rng(SEED + 2).integers(2, size=_LONGS * 64, dtype=np.int32)


#: Factors of the words of a run, one for each place.
_PLACES = np.random.default_rng(SEED + 1).integers(1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], n: int = WORDS) -> np.ndarray:
    """Distinct hashes of the runs of n words, mixed from the words' own; fewer words are one run, no words give none."""
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    runs = max(len(words) - n + 1, min(len(words), 1))
    total = np.zeros(runs, np.uint64)
    for k in range(min(n, len(words))):
        total += own[k : k + runs] * _PLACES[k]
    return np.unique(_mixed(total))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SEGMENTS numbers of WIDTH bits. A bit is set if it is in over half the hashes' mixes; fixed bits break ties."""
    counts = np.zeros((8, _LONGS, 8), np.int32)
    for low in range(0, hashes.size, 255):  # the lanes of a byte count to 255
        x = hashes[low : low + 255, None] * _FACTORS
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
        for bit in range(8):
            counts[bit] += ((x >> np.uint64(bit)) & _LANES).sum(axis=0).view(np.uint8).reshape(_LONGS, 8)
    bits = np.zeros((SEGMENTS, 16), bool)
    bits[:, 16 - WIDTH :] = ((2 * counts.transpose(1, 2, 0).reshape(-1) + _TIES) > hashes.size)[: SEGMENTS * WIDTH].reshape(SEGMENTS, WIDTH)
    return np.packbits(bits).view(">u2").astype("<u2")


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").decode("utf-8", "replace").lower().encode().split()


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _lists(lists: list) -> pa.Array:
    ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), _longs(np.concatenate([np.asarray(x, np.uint64) for x in lists])))


def _key_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(source):
        node, size, prints, known = [], [], [], {}
        for text in utf8(batch.column(2)):
            words = _words(text)
            name = xxhash.xxh64_intdigest(b" ".join(words), SEED)
            if name not in known:
                hashes = shingle_hashes(words)
                known[name] = (hashes.size, wide_fingerprint(hashes).tobytes())
            node.append(name)
            for column, value in zip((size, prints), known[name]):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _longs(node), pa.array(size, pa.int32()), pa.array(prints, pa.binary())], ["id", "text_hash", "node", "size", "fp"])


def _set_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(source):
        yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingle_hashes(_words(t)) for t in utf8(batch.column(1))])], ["node", "hashes"])


def _prints(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, SEGMENTS)


def _dealt(split: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of _ROW for each node and segment, packed by part: the segment and the first `split` bits of its value."""

    def packed(nodes: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        ring = np.concatenate([prints, prints[:, : CHAIN + 1]], axis=1).astype(np.uint64)
        parts, blobs, held = [], [], 0
        for seg in range(SEGMENTS):
            rows = np.empty(nodes.size, _ROW)
            rows["key"], rows["node"] = prints[:, seg], nodes
            for name, first in (("c0", seg + 1), ("c1", seg + 1 + CHAIN // 2)):
                rows[name] = reduce(lambda x, k: (x << np.uint64(WIDTH)) | ring[:, k], range(first, first + CHAIN // 2), np.uint64(0))
            at = rows["key"] >> (WIDTH - split)
            order = np.argsort(at, kind="stable")
            rows, at = rows[order], at[order]
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            for low, high in zip(starts.tolist(), [*starts[1:].tolist(), at.size]):
                parts.append(seg << split | int(at[low]))
                blobs.append(rows[low:high].tobytes())
            held += rows.nbytes
            if held > 4 << 20 or seg == SEGMENTS - 1:
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], ["part", "rows"])
                parts, blobs, held = [], [], 0

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, prints, n = [], [], 0
        for batch in batches_of(source):
            nodes.append(batch.column(0).to_numpy())
            prints.append(_prints(batch.column(1)))
            n += batch.num_rows
            if n >= DEALT:
                yield from packed(np.concatenate(nodes), np.concatenate(prints))
                nodes, prints, n = [], [], 0
        if n:
            yield from packed(np.concatenate(nodes), np.concatenate(prints))

    return run


def _chained(x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """Places of the XORs (of the segments after an equal one, in two words) that pass every chain."""
    half = CHAIN // 2
    at = np.flatnonzero(np.bitwise_count(x0) <= _BUDGET[half + 1])  # tested first, as it drops most
    a, b = x0[at], x1[at]
    whole = np.bitwise_count(a)
    ok = np.ones(at.size, bool)
    for c in range(1, half + 1):
        shift = np.uint64(WIDTH * (half - c))
        ok &= (np.bitwise_count(a >> shift) <= _BUDGET[c + 1]) & (whole + np.bitwise_count(b >> shift) <= _BUDGET[half + c + 1])
    return at[ok]


def _near(c0: np.ndarray, c1: np.ndarray, i: int) -> np.ndarray:
    return _chained(c0 ^ c0[i], c1 ^ c1[i])


def _all_pairs(c0: np.ndarray, c1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for low in range(0, c0.size, 256):
        at = _chained((c0[low : low + 256, None] ^ c0[low:]).ravel(), (c1[low : low + 256, None] ^ c1[low:]).ravel())
        i, j = at // (c0.size - low), at % (c0.size - low)
        yield (i + low)[i < j], (j + low)[i < j]


def _stars(c0: np.ndarray, c1: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Heads of the dense groups of a bucket, each with the rows near it; none: the bucket is not dense.

    Of 32 rows the one with most neighbours shows a group; its head is the row nearest to the majority of their bits, which
    of edited copies of one text is mostly that text.
    """
    left, out = np.arange(c0.size), []
    while left.size > DENSE:
        a, b = c0[left], c1[left]
        found = max((_near(a, b, i) for i in np.unique(np.linspace(0, left.size - 1, 32).astype(int)).tolist()), key=len)
        if found.size <= DENSE:
            break
        bits = np.unpackbits(np.stack([a[found], b[found]], axis=1).view(np.uint8), axis=1)
        most = np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > found.size).view(np.uint64)
        head = int(found[(np.bitwise_count(a[found] ^ most[0]) + np.bitwise_count(b[found] ^ most[1])).argmin()])
        near = np.union1d(_near(a, b, head), found)
        out.append((int(left[head]), left[near]))
        left = np.delete(left, near)
    return out


def _covers(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Heads and the rows paired with them, by most pairs, until each pair has a row in one of these groups."""
    while x.size:
        head = int(np.bincount(np.concatenate([x, y])).argmax())
        near = np.concatenate([y[x == head], x[y == head]])
        yield head, near
        gone = np.append(near, head)
        rest = ~(np.isin(x, gone) | np.isin(y, gone))
        x, y = x[rest], y[rest]


#: Kinds of rows that buckets give: a pair (a, b), a row a near the head b of a dense group, and a row a of dense bucket b.
_PAIR, _STAR, _ROW_OF = 0, 1, 2
_MET = "kind int, a long, b long, c0 long, c1 long"


def _met(kind: int, a: np.ndarray, b: np.ndarray, c0: np.ndarray | None = None, c1: np.ndarray | None = None) -> pa.RecordBatch:
    none = np.zeros(a.size, np.int64)
    columns = [np.full(a.size, kind, np.int32), a, b, *(none if c is None else c.view(np.int64) for c in (c0, c1))]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], ["kind", "a", "b", "c0", "c1"])


def _ordered(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return _met(_PAIR, np.minimum(x, y), np.maximum(x, y))


def part_pairs(part: int, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What the buckets of one part give: its rows of equal segment whose chains are in budget."""
    rows = rows[np.argsort(rows["key"], kind="stable")]
    key, node, c0, c1 = (np.ascontiguousarray(rows[c]) for c in ("key", "node", "c0", "c1"))
    starts = np.flatnonzero(np.diff(key.astype(np.int32), prepend=-1))
    sizes = np.diff(starts, append=key.size)
    ends = np.repeat(starts + sizes, sizes)
    i, d, met = np.flatnonzero(np.repeat(sizes, sizes) <= RUN), 1, []
    while True:
        i = i[i + d < ends[i]]
        if not i.size:
            break
        at = i[_chained(c0[i] ^ c0[i + d], c1[i] ^ c1[i + d])]
        met.append((at, at + d))
        d += 1
    if met:
        x, y = (np.concatenate(z) for z in zip(*met))
        of = np.searchsorted(starts, x, "right") - 1
        dense = (np.bincount(of, minlength=starts.size) > DENSE)[of]
        if not dense.all():
            yield _ordered(node[x[~dense]], node[y[~dense]])
        x, y, of = x[dense], y[dense], of[dense]
        order = np.argsort(of, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if order.size else []:
            low = int(starts[of[at[0]]])
            for head, near in _covers(x[at] - low, y[at] - low):
                yield _met(_STAR, node[near + low], np.full(near.size, node[low + head]))
            rows_of = np.unique(np.concatenate([x[at], y[at]]))
            yield _met(_ROW_OF, node[rows_of], np.full(rows_of.size, part << 16 | int(key[low])), c0[rows_of], c1[rows_of])
    for low in starts[sizes > RUN].tolist():
        own = slice(low, ends[low])
        stars = _stars(c0[own], c1[own])
        for head, near in stars:
            near = near[near != head] + low
            yield _met(_STAR, node[near], np.full(near.size, node[low + head]))
        if stars:
            yield _met(_ROW_OF, node[own], np.full(node[own].size, part << 16 | int(key[low])), c0[own], c1[own])
        else:
            for x, y in _all_pairs(c0[own], c1[own]):
                if x.size:
                    yield _ordered(node[own][x], node[own][y])


#: Packed rows of both ends of a pair or star, of rows of dense buckets, of what is known of a node, and of both together.
_LINK = np.dtype([("a", "<i8"), ("b", "<i8")])
_SEEN = np.dtype([("a", "<i8"), ("bucket", "<i8"), ("c0", "<i8"), ("c1", "<i8")])
_AT = np.dtype([(c, "<i8") for c in ("node", "label", "home", "weight")])
_NAMED = np.dtype([(c, "<i8") for c in ("bucket", "node", "label", "home", "weight", "c0", "c1")])
#: A kind of packed rows that sorts before the others: what is known of the nodes of a bin.
_KNOWN = -1
_PACKED = "bin int, kind int, rows binary"


def _bin_of(node: np.ndarray, bins: int) -> np.ndarray:
    return (_mixed(node.view(np.uint64)) % np.uint64(bins)).astype(np.int64)


def _packed(at: np.ndarray, rows: np.ndarray, kind: int) -> pa.RecordBatch:
    """The rows of each number in `at`, as bytes."""
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    blobs = [rows[low:high].tobytes() for low, high in zip(starts.tolist(), [*starts[1:].tolist(), at.size])]
    return pa.RecordBatch.from_arrays([pa.array(at[starts], pa.int32()), pa.array(np.full(starts.size, kind, np.int32)), pa.array(blobs, pa.binary())], ["bin", "kind", "rows"])


def _blobs(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches_of(source):
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _blob_runs(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes]]:
    """The bytes of the rows that agree in the columns before them, joined; rows come sorted by those, over many batches."""
    for key, run in groupby(_blobs(source), key=lambda row: row[:-1]):
        yield key, b"".join(row[-1] for row in run)


def _met_batches(bins: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What the buckets of each part give, packed by kind and by the bin of a: so many rows for a part at most, whatever its buckets hold."""

    def packed(met: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, *columns = (np.concatenate([b.column(k).to_numpy() for b in met]) for k in range(5))
        for kind, row in ((_PAIR, _LINK), (_STAR, _LINK), (_ROW_OF, _SEEN)):
            own = kinds == kind
            rows = np.empty(int(own.sum()), row)
            for name, column in zip(row.names, columns):
                rows[name] = column[own]
            yield _packed(_bin_of(rows["a"].copy(), bins), rows, kind)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part,), blob in _blob_runs(source):
            met, held = [], 0
            for batch in part_pairs(part, np.frombuffer(blob, _ROW)):
                met.append(batch)
                held += batch.nbytes
                if held > PACKED_BYTES:
                    yield from packed(met)
                    met, held = [], 0
            if met:
                yield from packed(met)

    return run


def _counted(links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (a, b), sorted, and how often each occurs."""
    order = np.lexsort((links["b"], links["a"]))
    a, b = links["a"][order], links["b"][order]
    new = np.ones(a.size, bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    starts = np.flatnonzero(new)
    return a[starts], b[starts], np.diff(starts, append=a.size)


def _first_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, a, b), each once: the pairs of a bin; of its rows near heads the head that each met most often; its rows of dense buckets.

    Packed rows come sorted by bin and kind, and all of a node are in one bin.
    """
    for (_, kind), blob in _blob_runs(source):
        if kind == _ROW_OF:
            a = b = np.unique(np.frombuffer(blob, _SEEN)["a"])
        else:
            a, b, n = _counted(np.frombuffer(blob, _LINK))
            if kind == _STAR:
                order = np.lexsort((_mixed(b.view(np.uint64)), n, a))
                last = order[np.append(np.flatnonzero(np.diff(a[order])), a.size - 1)]
                a, b = a[last], b[last]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(a.size, kind, np.int32)), pa.array(a), pa.array(b)], ["kind", "a", "b"])


def _known_batches(row: np.dtype, bins: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of numbers packed by the bin of the first, as _KNOWN."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = np.empty(sum(b.num_rows for b in held), row)
        for k, name in enumerate(row.names):
            rows[name] = np.concatenate([b.column(k).to_numpy() for b in held])
        return _packed(_bin_of(rows[row.names[0]].copy(), bins), rows, _KNOWN)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches_of(source):
            held.append(batch)
            n += batch.num_rows
            if n * row.itemsize > PACKED_BYTES:
                yield packed(held)
                held, n = [], 0
        if held:
            yield packed(held)

    return run


def _shared_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(head, b, n): the heads b that a row met, and how often, of the rows that are known to be heads themselves."""
    at, heads = None, None
    for (own, kind), blob in _blob_runs(source):
        links = np.frombuffer(blob, _LINK)
        if kind == _KNOWN:
            at, heads = own, links["a"]
        elif own == at:
            columns = _counted(links[np.isin(links["a"], heads)])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["head", "b", "n"])


def _named_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of dense buckets whose nodes are known, with what is known, packed by part (the bucket's upper bits)."""
    at, blobs, known, held, n = None, [], None, [], 0

    def packed() -> pa.RecordBatch:
        rows = np.concatenate(held)
        return _packed(rows["bucket"] >> 16, rows, _ROW_OF)

    for own, kind, blob in _blobs(source):
        if kind == _KNOWN:
            at, blobs, known = own, [*(blobs if own == at else []), blob], None
        elif own == at:
            if known is None:
                known = np.frombuffer(b"".join(blobs), _AT)
                known = known[np.argsort(known["node"])]
            seen = np.frombuffer(blob, _SEEN)
            place = np.minimum(np.searchsorted(known["node"], seen["a"]), known.size - 1)
            ok = known["node"][place] == seen["a"]
            rows = np.empty(int(ok.sum()), _NAMED)
            for name in _NAMED.names:
                rows[name] = seen[name][ok] if name in _SEEN.names else known[name][place[ok]]
            held.append(rows)
            n += rows.nbytes
            if n > PACKED_BYTES:
                yield packed()
                held, n = [], 0
    if n:
        yield packed()


def _by_bin(packed: DataFrame) -> DataFrame:
    return packed.repartition("bin").sortWithinPartitions("bin", "kind")


def _runs(source: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.Array]]:
    """The columns of the rows that agree in the first `keys` columns; rows come sorted by them, and may go on in the next batch."""

    def whole(parts: list[pa.RecordBatch]) -> list[pa.Array]:
        return [pa.concat_arrays([x.column(k) for x in parts]) for k in range(parts[0].num_columns)]

    rest, last = [], None
    for batch in batches_of(source):
        key = np.stack([batch.column(k).to_numpy() for k in range(keys)])
        if rest and (key[:, 0] != last).any():
            yield whole(rest)
            rest = []
        starts = [0, *(np.flatnonzero((np.diff(key) != 0).any(axis=0)) + 1).tolist()]
        for low, high in zip(starts, starts[1:]):
            yield whole([*rest, batch.slice(low, high - low)])
            rest = []
        rest.append(batch.slice(starts[-1]))
        last = key[:, -1]
    if rest:
        yield whole(rest)


def _visit_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of dense buckets, packed and sorted by part: (home, node) of the homes where rows are to be compared.

    For two rows of different labels whose chains are in budget it is the home of more rows, to which the other row comes; so
    a bucket gives rows and homes, and no pairs.
    """
    held, n = [], 0

    def distinct() -> np.ndarray:
        return np.unique(np.concatenate(held), axis=0)

    for _, blob in _blob_runs(source):
        rows = np.frombuffer(blob, _NAMED)
        rows = rows[np.argsort(rows["bucket"], kind="stable")]
        starts = np.flatnonzero(np.diff(rows["bucket"], prepend=-1))
        for low, high in zip(starts.tolist(), [*starts[1:].tolist(), rows.size]):
            node, label, home, weight, c0, c1 = (np.ascontiguousarray(rows[c][low:high]) for c in _NAMED.names[1:])
            labels, of = np.unique(label, return_inverse=True)
            if labels.size == 1:
                continue
            main = np.bincount(of).argmax()
            a, b = c0.view(np.uint64), c1.view(np.uint64)
            for i in np.flatnonzero(of != main).tolist():
                j = _near(a, b, i)
                j = j[(of[j] == main) | ((of[j] != of[i]) & (j > i))]
                comes = (home[j] == home[i]) | (weight[j] > weight[i]) | ((weight[j] == weight[i]) & (home[j] < home[i]))
                to, away = np.unique(home[j[comes]]), j[~comes]
                held += [np.stack([to, np.full(to.size, node[i])], axis=1), np.stack([np.full(away.size, home[i]), node[away]], axis=1)]
                n += to.size + away.size
                if n > 1 << 18:
                    held = [distinct()]
                    n = held[0].shape[0]
                    if n > 1 << 17:
                        yield _visits(held[0])
                        held, n = [], 0
    if n:
        yield _visits(distinct())


def _visits(found: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[:, k].copy()) for k in range(2)], ["home", "node"])


def joined(label: np.ndarray, side: np.ndarray, sets: list[np.ndarray], least: float) -> Iterator[tuple[int, int]]:
    """Links that join the labels joined at `least`: a spanning forest, not all pairs. Sets are counted exactly.

    If there are rows of two sides, those of one are compared with those of the other. Hashes of many rows are counted as bits of
    a matrix that is no larger than the sets; other hashes by lists of their rows.
    """
    size = np.array([len(x) for x in sets])
    of_row = np.repeat(np.arange(size.size), size)
    _, token, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = n * 64 >= max(size.size, 128)
    bit = np.cumsum(often) - 1
    bits = np.zeros((size.size, int(often.sum()) // 64 + 1), np.uint64)
    t, r = bit[token[often[token]]], of_row[often[token]]
    np.bitwise_or.at(bits, (r, t >> 6), np.uint64(1) << (t & 63).astype(np.uint64))
    order = np.argsort(token, kind="stable")
    rows, ends = of_row[order], np.cumsum(n)
    rare = [x[(n[x] > 1) & ~often[x]] for x in np.split(token, np.cumsum(size)[:-1])]
    _, now = np.unique(label, return_inverse=True)
    two = side.min() != side.max()
    for i in np.flatnonzero(now != np.bincount(now).argmax()).tolist():
        j = np.flatnonzero((now != now[i]) & ((side != side[i]) | (not two)) & (np.minimum(size, size[i]) >= least * np.maximum(size, size[i]) - 1e-9))
        if not j.size:
            continue
        common = np.bitwise_count(bits[j] & bits[i]).sum(axis=1, dtype=np.int64)
        if rare[i].size:
            common += np.bincount(np.concatenate([rows[ends[x] - n[x] : ends[x]] for x in rare[i]]), minlength=size.size)[j]
        j = j[common >= least * (size[j] + size[i] - common) - 1e-9]
        for other in np.unique(now[j], return_index=True)[1].tolist():
            yield i, int(j[other])
        if j.size:
            now[np.isin(now, now[j])] = now[i]


def _joined_batches(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, node, label, side, hashes in _runs(source, 3):
            node, ends = node.to_numpy(), np.cumsum(hashes.value_lengths().to_numpy())
            found = list(joined(label.to_numpy(), side.to_numpy(), np.split(hashes.flatten().to_numpy(), ends[:-1]), least))
            if found:
                x = node[np.array(found)]
                yield pa.RecordBatch.from_arrays([pa.array(x.min(axis=1)), pa.array(x.max(axis=1))], ["a", "b"])

    return run


def _within_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(source):
        differ = np.bitwise_count(_prints(batch.column(2)) ^ _prints(batch.column(3))).sum(axis=1, dtype=np.int32)
        yield batch.select(["a", "b"]).filter(pa.array(differ <= LIMIT))


def _able(sets: DataFrame, least: float) -> DataFrame:
    """(node, size, known) of what can reach `least` with any other. known: its shingles that another set has as well."""
    alone = sets.select("node", F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1").groupBy("node").agg(F.count("*").alias("alone"))
    sized = sets.select("node", F.size("hashes").alias("size")).join(alone, "node", "left").withColumn("known", F.col("size") - F.coalesce("alone", F.lit(0)))
    return cut(sized.where(F.col("known") >= least * F.col("size") - 1e-9).select("node", "size", "known"))


def _possible(pairs: DataFrame, able: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that share enough shingles if they share all that any other set has."""
    left, right = (able.select(F.col("node").alias(x), F.col("size").alias(f"{x}_size"), F.col("known").alias(f"{x}_known")) for x in "ab")
    needed = F.ceil(least / (1 + least) * (F.col("a_size") + F.col("b_size")) - 1e-9)
    return pairs.join(left, "a").join(right, "b").where(F.least("a_known", "b_known") >= needed).select(pairs.columns)


def _confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) within LIMIT bits whose shingle sets, counted exactly, reach `least`."""
    left, right = (nodes.select(F.col("node").alias(x), F.col("fp").alias(f"{x}_fp")) for x in "ab")
    prints = pairs.join(left, "a").join(right, "b").select("a", "b", "a_fp", "b_fp")
    close = cut(prints.mapInArrow(_within_batches, "a long, b long"))
    left, right = (sets.select(F.col("node").alias(x), F.col("hashes").alias(f"{x}_set")) for x in "ab")
    both = close.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("a_set", "b_set")))
    return cut(both.where(F.col("common") >= least * (F.size("a_set") + F.size("b_set") - F.col("common")) - 1e-9).select("a", "b"))


def _homes(stars: DataFrame, heads: DataFrame, bins: int) -> DataFrame:
    """(node, home, weight) of the rows with a head: the head that most rows chose, of those that met their own head.

    stars: rows and all their heads, packed; heads: (a, b), one of them. Homes are far fewer than heads, as each bucket has
    heads of its own. weight: the rows of that home.
    """
    chosen = cut(heads.groupBy("b").agg(F.count("*").alias("n")))
    packed = chosen.select("b", "n").mapInArrow(_known_batches(_LINK, bins), _PACKED)
    of_heads = _by_bin(packed.unionByName(stars)).mapInArrow(_shared_batches, "head long, b long, n long").select("head", "b")
    known = of_heads.unionByName(chosen.select(F.col("b").alias("head"), "b")).join(chosen, "b")
    home = known.groupBy("head").agg(F.max_by("b", F.struct("n", F.xxhash64("b"))).alias("home"))
    named = cut(heads.select(F.col("a").alias("node"), F.col("b").alias("head")).join(home, "head").select("node", "home"))
    return named.join(named.groupBy("home").agg(F.count("*").alias("weight")), "home")


def _at_home(rows: DataFrame, able: DataFrame, homes: DataFrame, label: DataFrame, sets: DataFrame, least: float, bins: int) -> DataFrame:
    """(a, b): links that join what the first links left apart in dense buckets. rows: those of dense buckets, packed.

    Rows that met with different labels come to one home, and there all rows of it are compared by their exact sets, in
    blocks of about HOME_HASHES, each with each. What leaves a home is a spanning forest.
    """
    own = F.col("node")
    at = able.select("node", "size").join(label, "node", "left").join(homes, "node", "left")
    at = cut(at.select("node", "size", F.coalesce("label", own).alias("label"), F.coalesce("home", own).alias("home"), F.coalesce("weight", F.lit(0)).alias("weight")))
    named = _by_bin(at.select(*_AT.names).mapInArrow(_known_batches(_AT, bins), _PACKED).unionByName(rows)).mapInArrow(_named_batches, _PACKED)
    visits = named.select(F.col("bin").alias("part"), "rows").repartition("part").sortWithinPartitions("part")
    visits = cut(visits.mapInArrow(_visit_batches, "home long, node long").distinct())
    guests = visits.unionByName(at.join(visits.select("home").distinct(), "home", "left_semi").select("home", "node")).distinct()
    guests = cut(guests.join(at.select("node", "size", "label"), "node"))
    blocks = guests.groupBy("home").agg(F.ceil(F.sum("size") / HOME_HASHES).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = guests.join(blocks, "home").withColumn("side", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("home", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "node", "label", "side")
    full = dealt.join(sets, "node").select("home", "low", "high", "node", "label", "side", "hashes")
    return full.repartition("home", "low", "high").sortWithinPartitions("home", "low", "high").mapInArrow(_joined_batches(least), "a long, b long")


def links(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], least: float = LEAST) -> DataFrame:
    """(node, label) of every node that has a link. nodes: distinct (node, fp); sets_of(nodes): hashes.

    Nodes are dealt by segment, packed, and meet in buckets of equal segments. A bucket with many pairs would give too
    many of them, so at first each row is compared with the head that it shares most segments with; a pair in one
    component needs no comparison, and rows of different components that met in such buckets are compared at their home,
    by exact sets, which gives no pairs but links.
    """
    small_batches(nodes.sparkSession)
    n = nodes.count()
    split, bins = min((n // PART_ROWS).bit_length(), WIDTH), max(LEAST_BINS, n // BIN_NODES)
    dealt = nodes.select("node", "fp").mapInArrow(_dealt(split), "part int, rows binary").repartition("part").sortWithinPartitions("part")
    met = cut(dealt.mapInArrow(_met_batches(bins), _PACKED))
    first = cut(_by_bin(met).mapInArrow(_first_batches, "kind int, a long, b long"))
    alone, heads = (first.where(F.col("kind") == kind).select("a", "b") for kind in (_PAIR, _STAR))
    star, rows = (met.where(F.col("kind") == kind) for kind in (_STAR, _ROW_OF))
    sets = sets_of(first.select("a").union(first.select("b")).toDF("node").distinct())
    able = _able(sets, least)
    proposed = alone.unionByName(heads.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    edges = _confirmed(cut(_possible(proposed, able, least)), nodes, sets, least)
    label = cut(components(edges, one_task=ONE_TASK))
    more = cut(_at_home(rows, able, _homes(star, heads, bins), label, sets, least, bins))
    return label if more.isEmpty() else cut(components(label.toDF("a", "b").unionByName(more), one_task=ONE_TASK))


def _row_keys(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash"), "text")


def _small(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """A written table of keys, marked for broadcast if it has at most so many rows."""
    return F.broadcast(keys) if keys.count() <= most else keys


def near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(id, text_hash, label) of every row of docs with a doc_id; rows of one label are joined by links at `least`.

    Words are lower-cased runs without white space. Texts of equal words are one node; null and blank texts too. Nodes are
    linked if the Jaccard coefficient of their sets of WORDS-word shingles, counted exactly, is `least` or more. Repeated
    rows stay repeated; an empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    texts = _row_keys(docs.where("doc_id is not null"))
    of_row = cut(texts.mapInArrow(_key_batches, "id long, text_hash long, node long, size int, fp binary"))
    firsts = [F.first(c).alias(c) for c in ("size", "fp")]
    nodes = cut(of_row.groupBy("node").agg(F.min(F.struct("id", "text_hash")).alias("head"), *firsts))

    def sets_of(wanted: DataFrame) -> DataFrame:
        heads = _small(cut(nodes.select("node", "head.*").join(wanted, "node", "left_semi")))
        rows = texts.join(heads, ["id", "text_hash"]).select("node", "text")
        return cut(rows.mapInArrow(_set_batches, "node long, hashes array<long>").dropDuplicates(["node"]))

    label = links(nodes, sets_of, least)
    named = nodes.select("node").join(label, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    return of_row.select("id", "text_hash", "node").join(named, "node").select("id", "text_hash", "label")


def one_of_each(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs with one row of each component: of its least doc_id, and of that the text of least hash.

    An id that heads several components (with texts that differ) keeps a row of each. Rows without doc_id stay. What is
    dropped is decided on narrow rows; then texts are filtered where they lie (they are shuffled only if more than
    BROADCAST_KEYS keys go). Of equal rows (id and text) one is kept.
    """
    rows = cut(near_duplicates(docs, least).groupBy("label", "id", "text_hash").agg(F.count("*").alias("n")))
    heads = rows.groupBy("label").agg(F.min(F.struct("id", "text_hash")).alias("h"))
    marked = rows.join(heads, "label").withColumn("head", F.col("h") == F.struct("id", "text_hash"))
    gone = _small(cut(marked.where("not head or n > 1").select(F.col("id").alias("_id"), F.col("text_hash").alias("_text"))))
    again = _small(cut(marked.where("head and n > 1").select(F.col("id").alias("_id"), F.col("text_hash").alias("_text"))))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_text"))
    kept = packed.join(gone, ["_id", "_text"], "left_anti")  # a null id equals none, so its rows stay
    repeated = packed.join(again, ["_id", "_text"], "left_semi").dropDuplicates(["_id", "_text"])
    return kept.unionByName(repeated).select("_row.*")
