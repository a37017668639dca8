"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, stored as sorted hash arrays, mapped by the workers.

Vocabulary. Words are 64-bit hashes. A first pass counts them in buckets of their keys; a word's number is its rank by count
within the bucket, interleaved with the bucket's number, so frequent words have small numbers wherever they are.

Counting. An n-gram's key is a hash of its words' hashes. Every task counts its own n-grams first and sends them, as sorted
and packed word numbers, to a bucket. The highest order is dealt by the key of all words but the first: a bucket then
holds all n-grams that end in these words, and counts the next lower order, too. (From order 3 on; the lower orders are dealt by
the keys of whole n-grams.) Keys are uniform, so buckets are even whatever word is frequent; a bucket holds more only by the
different words found before one frequent ending of two or more words. A bucket sums its n-grams, writes them as sorted arrays
and passes on what lower orders need: how many different words stand before each shorter n-gram, and per context the total and
the numbers of n-grams seen once, twice and more. These are summed per bucket again, and so on down to single words.

Stored are 48 bits of a key behind an index of the bits above them, and counts as single bytes with a list of the larger
ones. A context of two or more words that was seen once is not stored: it is an n-gram of the order below, with known
numbers. Rows and shuffle files between the orders are deleted once the next order is written.

Discounts come from the counts of counts of each order. Order n uses raw counts, lower orders the number of different
left neighbours. A text begins with n-1 begin marks (never predicted) and ends with one end mark.

Scoring. Workers map the arrays of the shared folder and look up sorted batches of keys by binary search; nothing is
loaded or sent as a whole. Word lookups are made once per different word of a batch.

Rows: a null text counts as empty and has one token, the end; a null id counts as the empty text in the split. Without
training texts every probability is that of the uniform law. Repeated rows count as often as they occur; an empty table gives
an empty result.
"""

from __future__ import annotations

import itertools
import uuid
from collections import Counter, OrderedDict, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voc.llm import shared_files
from voc.storage import drop, scratch_path, written

ORDER = 3
HELD_OUT = 1                    # remainder of the id's crc32 by FOLDS
FOLDS = 5
CHUNK_TOKENS = 3 << 20          # tokens that a task counts before it sends
CHUNK_WORDS = 1 << 18           # different words that a task counts before it sends
BATCH_TOKENS = 1 << 19          # tokens scored together
OPEN_FILES = 400
BEGIN, END = xxhash.xxh64_intdigest(b"begin", 1), xxhash.xxh64_intdigest(b"end", 1)
_A, _B, _S = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29)


def key_of(columns: list[np.ndarray]) -> np.ndarray:
    """Keys of n-grams given their words' hashes, first word first."""
    key = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        key = (key ^ column) * _A
        key ^= key >> _S
        key *= _B
        key ^= key >> np.uint64(32)
    return key


def tokenized(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the different words, token numbers of all texts, tokens per text); number 0 is the end mark."""
    known: defaultdict[bytes, int] = defaultdict(itertools.count(1).__next__)
    numbers, sizes = [], np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.lower().split()
        sizes[i] = len(words) + 1
        numbers.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        numbers.append(np.zeros(1, np.int32))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
    return np.append(np.uint64(END), hashes), np.concatenate(numbers) if numbers else np.zeros(0, np.int32), sizes


def _histories(numbers: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """Token numbers of the order-1 tokens before each token, farthest first, then of the token; -1 is the begin mark."""
    place = np.arange(len(numbers)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = []
    for back in range(order - 1, 0, -1):
        before = np.full(len(numbers), -1, np.int32)
        before[back:] = numbers[:-back] if back < len(numbers) else before[back:]
        before[place < back] = -1
        out.append(before)
    return [*out, numbers]


def _hashed(hashes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    return np.append(hashes, np.uint64(BEGIN))[numbers]  # -1 takes the last


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of whole numbers, the first one sorted and kept as differences, byte by byte of their widths."""
    columns = [np.diff(columns[0], prepend=columns[0].dtype.type(0)), *columns[1:]]
    widths = [max(1, (int(c.max(initial=0)).bit_length() + 7) // 8) for c in columns]
    planes = [np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w].T) for c, w in zip(columns, widths)]
    return zstandard.compress(f"{len(columns[0])};{','.join(map(str, widths))};".encode() + b"".join(p.tobytes() for p in planes), 1)


def _unpack(data: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(data)
    n, widths, _ = data[:200].split(b";", 2)
    at, out, n = len(n) + len(widths) + 2, [], int(n)
    for width in map(int, widths.split(b",")):
        planes = np.zeros((n, 4 if width <= 4 else 8), np.uint8)
        planes[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
        out.append(planes.view("<u4" if width <= 4 else "<u8")[:, 0])
        at += n * width
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


def _joined(payloads: Iterator[bytes]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*map(_unpack, payloads))]


def _sorting(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by the columns, the first one above all."""
    tops = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(tops) > 64:
        return np.lexsort(columns[::-1])
    code = np.zeros(len(columns[0]), np.uint64)
    for c, bits in zip(columns, tops):
        code = (code << np.uint64(bits)) | c.astype(np.uint64)
    return np.argsort(code)


def _summed(keys: np.ndarray, values: list[np.ndarray], others: list[np.ndarray] = ()) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(sorted different keys, sums of the values, first of the others)."""
    order = np.argsort(keys)
    keys = keys[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(v[order].astype(np.uint64), heads) if len(keys) else v.astype(np.uint64) for v in values]
    return keys[heads], sums, [o[order][heads] for o in others]


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)


def _by_bucket(kind: int, bits: int, keys: np.ndarray, columns: list[np.ndarray], by: int) -> Iterator[tuple[int, int, bytes]]:
    """(kind, bucket, packed columns) for the buckets of the keys, sorted by the first ``by`` columns."""
    bucket = _bucket(keys, bits)
    order = _sorting([bucket, *columns[:by]])
    edges = np.flatnonzero(np.append(True, np.diff(bucket[order]) > 0)).tolist() if len(keys) else []
    for a, b in zip(edges, [*edges[1:], len(keys)]):
        yield kind, int(bucket[order[a]]), _pack([c[order[a:b]] for c in columns])


_ROWS = "kind tinyint, bucket int, payload binary"
# kinds of rows; n-grams of order n have theirs at n * LEVEL above
NGRAM, CONTEXT, RAW, STATS, FILE, CONTEXT_FILE, NAMES = range(7)
LEVEL = 8


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds, buckets, payloads = zip(*rows)
    return pa.record_batch(
        [pa.array(kinds, pa.int8()), pa.array(buckets, pa.int32()), pa.array(payloads, pa.binary())], names=["kind", "bucket", "payload"]
    )


def _batched(rows: Iterator[tuple[int, int, bytes]], most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > most:
            yield _rows(held)
            held, size = [], 0
    if held:
        yield _rows(held)


def _count_words(bits: int):
    """Counts the words of texts and sends them to buckets."""

    def counted(known: Counter) -> Iterator[tuple[int, int, bytes]]:
        ends = known.pop(None, 0)
        hashes = np.append(np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known)), np.uint64(END))
        counts = np.append(np.fromiter(known.values(), np.uint64, len(known)), np.uint64(ends))
        yield from _by_bucket(RAW, bits, key_of([hashes]), [hashes, counts], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                known.update((text.as_py() or b"").lower().split())
                known[None] += 1  # the end mark
                if len(known) > CHUNK_WORDS:
                    yield from _batched(counted(known))
                    known = Counter()
        if known:
            yield from _batched(counted(known))

    return run


def _number_words(folder: str, bits: int):
    """Ranks a bucket's words by their counts and writes the ranks by key, and the hashes and counts by rank."""

    def numbered(bucket: int, parts: list[tuple[int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
        hashes, counts = _joined(p for _, p in parts)
        keys, (counts,), (hashes,) = _summed(key_of([hashes]), [counts], [hashes])
        order = np.argsort(~counts, kind="stable")
        rank = np.empty(len(order), np.uint64)
        rank[order] = np.arange(1, len(order) + 1, dtype=np.uint64)
        yield FILE, bucket, _packed_file(folder, "ranks", bucket, bits, keys, [rank])
        yield NAMES, bucket, _file(folder, "names", bucket, [hashes[order], counts[order]])[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(row for bucket, parts in _by_buckets(batches) for row in numbered(bucket, parts))

    return run


@dataclass
class Words:
    """Numbers of the training words: 0 is the begin mark, others are 1 + (rank << bits | bucket)."""

    bits: int
    ranks: Packed
    names: dict[int, tuple[str, int, tuple[str, ...]]]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        keys = key_of([hashes])
        (rank,) = self.ranks.find(keys, 1)
        if not rank.all():
            raise ValueError("the training texts are read twice and differ")
        return ((rank.astype(np.uint64) - np.uint64(1)) << np.uint64(self.bits) | _bucket(keys, self.bits)) + np.uint64(1)

    def hashes(self, numbers: np.ndarray) -> np.ndarray:
        out = np.full(len(numbers), BEGIN, np.uint64)
        place = numbers.astype(np.uint64) - np.uint64(1)
        bucket = (place & np.uint64((1 << self.bits) - 1)).astype(np.min_scalar_type(1 << self.bits))
        bucket[numbers == 0] = 1 << self.bits
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange((1 << self.bits) + 1))
        for b, file in self.names.items():
            at = order[edges[b] : edges[b + 1]]
            if len(at):
                out[at] = _mapped(file, 0)[place[at] >> np.uint64(self.bits)]
        return out


def _gram_key(hashes: list[np.ndarray], order: int, bits: int) -> np.ndarray:
    """An n-gram's key; from order 3 on those of the highest order take the bucket of all words but the first."""
    key = key_of(hashes)
    if len(hashes) < order or order < 3 or not bits:
        return key
    return (_bucket(key_of(hashes[1:]), bits) << np.uint64(64 - bits)) | (key >> np.uint64(bits))


def _count(order: int, bits: int, words: Words):
    """Counts the n-grams of texts and sends them to buckets."""

    def counted(texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        hashes, numbers, sizes = tokenized(texts)
        ids = words.numbers(hashes)
        up = np.argsort(ids)
        dense = np.empty(len(ids) + 1, np.int32)
        dense[up], dense[-1] = np.arange(1, len(ids) + 1), 0     # -1 is the begin mark
        texts.clear()
        ids, hashes = np.append(np.uint64(0), ids[up]), np.append(np.uint64(BEGIN), hashes[up])
        grams = [dense[g] for g in _histories(numbers, sizes, order)]
        bucket = _bucket(key_of([hashes[g] for g in grams[order > 2 :]]), bits).astype(np.min_scalar_type(1 << bits))  # as in _gram_key
        by = _sorting([bucket, *grams[1:], grams[0]])
        bucket, *grams = [c[by] for c in (bucket, *grams)]
        del numbers
        heads = np.append(True, np.any([c[1:] != c[:-1] for c in grams], axis=0)) if len(by) else np.zeros(0, bool)
        heads = np.flatnonzero(heads)
        counts = np.diff(np.append(heads, len(by))).astype(np.uint64)
        bucket, *grams = [c[heads] for c in (bucket, *grams)]
        edges = np.flatnonzero(np.append(True, np.diff(bucket) > 0)).tolist() if len(heads) else []
        for a, b in zip(edges, [*edges[1:], len(heads)]):
            columns = [ids[g[a:b]] for g in (*grams[1:], grams[0])]
            yield NGRAM + LEVEL * order, int(bucket[a]), _pack([*columns, counts[a:b]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                held.append(text.as_py() or b"")
                size += len(held[-1])
                if size > 6 * CHUNK_TOKENS:
                    yield from _batched(counted(held))
                    held, size = [], 0
        if held:
            yield from _batched(counted(held))

    return run


def _by_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(bucket, [(kind, payload)]) of a partition."""
    held: dict[int, list[tuple[int, bytes]]] = {}
    for batch in batches:
        for kind, bucket, payload in zip(*(c.to_pylist() for c in batch.columns)):
            held.setdefault(bucket, []).append((kind, payload))
    yield from held.items()


def _file(folder: str, name: str, bucket: int, columns: list[np.ndarray]) -> tuple[int, int, bytes]:
    """Writes arrays one behind the other; the row that names them."""
    uri = f"{folder}/{name}-{bucket:06d}-{uuid.uuid4().hex}.arrays"
    shared_files.write(uri, b"".join(np.ascontiguousarray(c).tobytes() for c in columns))
    kinds = ",".join(c.dtype.str for c in columns)
    return FILE, bucket, f"{uri}\n{len(columns[0])}\n{kinds}".encode()


def _stats(bucket: int, counts: np.ndarray, *more: int) -> tuple[int, int, bytes]:
    """Counts of counts 1 to 4, entries, sum, and further numbers."""
    ones = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
    return STATS, bucket, ",".join(map(str, [*ones, len(counts), int(counts.sum()), *more])).encode()


def _merge(folder: str, order: int, bits: int, words: Words):
    """Sums a bucket's n-grams and contexts, and sends on the partial sums of lower orders."""

    def grams(bucket: int, level: int, keys: np.ndarray, ids: list[np.ndarray], hashes: list[np.ndarray], counts: np.ndarray):
        yield FILE + LEVEL * level, bucket, _packed_file(folder, f"grams{level}", bucket, bits, keys, [counts])
        yield STATS + LEVEL * level, *_stats(bucket, counts)[1:]
        one, two = counts == 1, counts == 2
        context, sums, of = _summed(key_of(hashes[:-1]), [counts, one, two, ~(one | two)], ids[:-1])
        yield from _by_bucket(CONTEXT + LEVEL * level, bits, context, [*of, *sums], level - 1)
        suffix, (before,), rest = _summed(key_of(hashes[1:]), [np.ones(len(keys), np.uint64)], [*ids[1:], *hashes[1:]])
        del keys, ids, hashes, counts, one, two, context, sums, of
        if level == order and order > 2:  # all the grams with these endings are here
            yield from grams(bucket, level - 1, suffix, rest[: level - 1], rest[level - 1 :], before)
        else:
            yield from _by_bucket(NGRAM + LEVEL * (level - 1), bits, suffix, [*rest[: level - 1], before], level - 1)

    def contexts(bucket: int, level: int, columns: list[np.ndarray]):
        ids = columns[: level - 1]
        keys, sums, ids = _summed(key_of([words.hashes(i) for i in ids]), columns[level - 1 :], ids)
        if level > 2:
            kept = (sums[0] > 1) | ~np.any(ids, axis=0)  # begin marks alone are no n-gram of the order below
            keys, sums = keys[kept], [x[kept] for x in sums]
        if len(keys):
            yield CONTEXT_FILE + LEVEL * level, bucket, _packed_file(folder, f"contexts{level}", bucket, bits, keys, sums)

    def single(bucket: int, ids: np.ndarray, counts: np.ndarray):
        hashes, raw = (_mapped(words.names[bucket], k) for k in (0, 1))
        before = np.zeros(len(hashes), np.uint64)
        np.add.at(before, (ids - np.uint64(1)) >> np.uint64(bits), counts.astype(np.uint64))
        keys = key_of([np.asarray(hashes)])
        by = np.argsort(keys)
        yield FILE + LEVEL, bucket, _packed_file(folder, "words", bucket, bits, keys[by], [before[by], raw[by]])
        yield STATS + LEVEL, *_stats(bucket, before, int(raw.sum()))[1:]

    def merged(bucket: int, parts: list[tuple[int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
        for kind in sorted({k for k, _ in parts}):
            columns = _joined(p for k, p in parts if k == kind)
            level = kind // LEVEL
            if kind % LEVEL == CONTEXT:
                yield from contexts(bucket, level, columns)
            elif level == 1:
                yield from single(bucket, *columns)
            else:
                if level == order:
                    columns = [columns[order - 1], *columns[: order - 1], columns[order]]
                hashes = [words.hashes(c) for c in columns[:-1]]
                keys, (counts,), both = _summed(_gram_key(hashes, order, bits), columns[-1:], [*columns[:-1], *hashes])
                made = grams(bucket, level, keys, both[:level], both[level:], counts)
                del columns, hashes, keys, counts, both  # held by ``made`` as long as it needs them
                yield from made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(row for bucket, parts in _by_buckets(batches) for row in merged(bucket, parts))

    return run


_MAPS: OrderedDict[tuple[str, int], np.ndarray] = OrderedDict()


def _mapped(file: tuple[str, int, tuple[str, ...]], column: int) -> np.ndarray:
    uri, n, kinds = file
    if (uri, column) in _MAPS:
        _MAPS.move_to_end((uri, column))
    else:
        start = sum(n * np.dtype(k).itemsize for k in kinds[:column])
        _MAPS[uri, column] = shared_files.mapped(uri, kinds[column], start, n)
        if len(_MAPS) > OPEN_FILES:
            _MAPS.popitem(last=False)
    return _MAPS[uri, column]


@dataclass
class Arrays:
    """Sorted arrays in buckets of the keys' top bits."""

    bits: int
    files: dict[int, tuple[str, int, tuple[str, ...]]] = field(default_factory=dict)

    def find(self, keys: np.ndarray, columns: int) -> list[np.ndarray]:
        """Columns 1 and on for each key, 0 where it is missing."""
        out = [np.zeros(len(keys)) for _ in range(columns)]
        order = np.argsort(keys)
        keys = keys[order]
        bucket = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        edges = np.flatnonzero(np.append(True, np.diff(bucket) > 0)).tolist() if len(keys) else []
        for a, b in zip(edges, [*edges[1:], len(keys)]):
            file = self.files.get(int(bucket[a]))
            if file is None or not file[1]:
                continue
            stored = _mapped(file, 0)
            at = np.minimum(np.searchsorted(stored, keys[a:b]), file[1] - 1)
            there = stored[at] == keys[a:b]
            for k in range(columns):
                out[k][order[a:b][there]] = _mapped(file, k + 1)[at[there]]
        return out


_VIEWS: OrderedDict[str, list[np.ndarray]] = OrderedDict()
_LOW = np.uint64((1 << 48) - 1)


def _packed_file(folder: str, name: str, bucket: int, bits: int, keys: np.ndarray, columns: list[np.ndarray]) -> bytes:
    """Writes sorted keys and columns of whole numbers; the text that names the file and its parts.

    Keys are an index of their bits behind the bucket's, with some 16 keys an entry, and the lowest 48 bits. A column is single bytes, with 255
    for numbers listed apart, or of the narrowest type where that is smaller.
    """
    above = max(16 - bits, (len(keys) >> 4).bit_length(), 0)
    top = (keys << np.uint64(bits)) >> np.uint64(64 - above) if above else np.zeros(len(keys), np.uint64)
    index = np.searchsorted(top, np.arange((1 << above) + 1, dtype=np.uint64))
    low = keys & _LOW
    groups = [[index.astype("<u4" if len(keys) < 1 << 32 else "<u8")], [(low >> np.uint64(16)).astype("<u4")], [(low & np.uint64(0xFFFF)).astype("<u2")]]
    for column in columns:
        large = np.flatnonzero(column > 254)
        plain = np.min_scalar_type(int(column.max(initial=0)))
        if 16 * len(large) + len(keys) < plain.itemsize * len(keys):
            groups.append([np.minimum(column, 255).astype(np.uint8), large.astype("<u8"), column[large].astype("<u8")])
        else:
            groups.append([column.astype(plain)])
    uri = f"{folder}/{name}-{bucket:06d}-{uuid.uuid4().hex}.arrays"
    shared_files.write(uri, b"".join(part.tobytes() for group in groups for part in group))
    return f"{uri}\n{';'.join(','.join(f'{p.dtype.str}:{len(p)}' for p in group) for group in groups)}".encode()


def _views(file: tuple[str, str]) -> list[list[np.ndarray]]:
    uri, layout = file
    if uri in _VIEWS:
        _VIEWS.move_to_end(uri)
        return _VIEWS[uri]
    kinds = [[(np.dtype(k), int(n)) for k, n in (part.split(":") for part in group.split(","))] for group in layout.split(";")]
    data = np.asarray(shared_files.mapped(uri, "u1", 0, sum(k.itemsize * n for group in kinds for k, n in group)))
    at, out = 0, []
    for group in kinds:
        out.append([])
        for kind, n in group:
            out[-1].append(data[at : at + kind.itemsize * n].view(kind))
            at += kind.itemsize * n
    _VIEWS[uri] = out
    if len(_VIEWS) > OPEN_FILES:
        _VIEWS.popitem(last=False)
    return out


@dataclass
class Packed:
    """Files of ``_packed_file`` in buckets of the keys' top bits."""

    bits: int
    files: dict[int, tuple[str, str]] = field(default_factory=dict)

    def find(self, keys: np.ndarray, columns: int) -> list[np.ndarray]:
        """The columns for each key, 0 where it is missing."""
        out = [np.zeros(len(keys)) for _ in range(columns)]
        order = np.argsort(keys)
        keys = keys[order]
        bucket = _bucket(keys, self.bits)
        edges = np.flatnonzero(np.append(True, np.diff(bucket) > 0)).tolist() if len(keys) else []
        for a, b in zip(edges, [*edges[1:], len(keys)]):
            file = self.files.get(int(bucket[a]))
            if file is None:
                continue
            (index,), (high,), (low,), *stored = _views(file)
            above, wanted, last = (len(index) - 1).bit_length() - 1, keys[a:b] & _LOW, len(high) - 1
            top = ((keys[a:b] << np.uint64(self.bits)) >> np.uint64(64 - above)).astype(np.int64) if above else np.zeros(b - a, np.int64)
            at, stop = index[top].astype(np.int64), index[top + 1].astype(np.int64)
            end, upper = stop, (wanted >> np.uint64(16)).astype(np.uint32)
            for _ in range(int((stop - at).max(initial=0)).bit_length()):
                middle = (at + end) >> 1
                less = (high[np.minimum(middle, last)] < upper) & (at < end)
                at, end = np.where(less, middle + 1, at), np.where(less, end, middle)
            open_ = np.flatnonzero((at < stop) & (high[np.minimum(at, last)] == upper))
            at, stop, upper, lower = at[open_], stop[open_], upper[open_], (wanted[open_] & np.uint64(0xFFFF)).astype(np.uint16)
            while len(behind := np.flatnonzero(low[at] < lower)):  # keys that agree in their upper bits
                behind = behind[(at[behind] + 1 < stop[behind])]
                behind = behind[high[at[behind] + 1] == upper[behind]]
                if not len(behind):
                    break
                at[behind] += 1
            same = low[at] == lower
            probe, there = at[same], order[a:b][open_[same]]
            for k in range(columns):
                found = stored[k][0][probe].astype(float)
                if len(stored[k]) > 1:
                    large = np.flatnonzero(found == 255)
                    found[large] = stored[k][2][np.searchsorted(stored[k][1], probe[large])]
                out[k][there] = found
        return out


@dataclass
class Contexts(Packed):
    discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def find(self, keys: np.ndarray, columns: int = 2) -> list[np.ndarray]:
        """Total and back-off weight of each context."""
        total, *seen = super().find(keys, 4)
        return [total, sum(d * n for d, n in zip(self.discounts, seen)) / np.where(total > 0, total, 1.0)][:columns]


def discounts_of(counts: list[int]) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3 or more from the counts of counts 1 to 4."""
    n1, n2, n3, n4 = counts
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 3 - 3 * y)
    return tuple(min(max(d, 0.0), k + 0.999) for k, d in enumerate(raw))


@dataclass
class Model:
    order: int
    grams: dict[int, Packed]       # by order, from 2
    contexts: dict[int, Contexts]
    words: Packed
    discounts: dict[int, tuple[float, float, float]]
    vocabulary: int
    raw_total: int
    before_total: int
    back_off: float                # weight of the uniform law

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) per text; scores are log10 probabilities."""
        hashes, numbers, sizes = tokenized(texts)
        before, raw = self.words.find(key_of([hashes]), 2)
        base = np.log10((raw + 0.5) / (self.raw_total + 0.5 * (self.vocabulary + 1)))[numbers]
        if self.before_total:
            p = (np.maximum(before - self._discount(1, before), 0) / self.before_total + self.back_off / (self.vocabulary + 1))[numbers]
        else:
            p = np.full(len(numbers), 1.0 / (self.vocabulary + 1))
        grams = [_hashed(hashes, g) for g in _histories(numbers, sizes, self.order)]
        first = np.cumsum(sizes) - sizes
        # the context of a token is the n-gram of the token before: number ``at`` of the different ones, the begin marks last
        some, known, last = key_of([hashes]), None, numbers
        for level in range(2, self.order + 1):
            begin = key_of([np.array([BEGIN], np.uint64)] * (level - 1))
            total, back_off = self.contexts[level].find(np.append(some, begin), 2)
            if known is not None:  # contexts seen once are not stored
                once = (total == 0) & np.append(known > 0, False)
                total, back_off = np.where(once, 1.0, total), np.where(once, self.discounts[level][0], back_off)
            at = np.roll(last, 1)
            at[first] = len(some)
            total, back_off = total[at], back_off[at]
            keys = _gram_key(grams[self.order - level :], self.order, self.words.bits)
            if level < self.order:
                some, last = np.unique(keys, return_inverse=True)
                (known,) = self.grams[level].find(some, 1)
                count = known[last]
            else:
                (count,) = self.grams[level].find(keys, 1)
            seen = total > 0
            safe = np.where(seen, total, 1.0)
            p = np.where(seen, np.maximum(count - self._discount(level, count), 0) / safe + back_off * p, p)
        starts = np.cumsum(sizes) - sizes
        total = lambda x: np.add.reduceat(x, starts) if len(texts) else np.zeros(0)
        return sizes, total((raw > 0)[numbers].astype(np.int64)), total(base), total(np.log10(p))

    def _discount(self, level: int, count: np.ndarray) -> np.ndarray:
        d = self.discounts[level]
        return np.select([count == 0, count == 1, count == 2], [0.0, d[0], d[1]], d[2])


def _read_rows(rows: DataFrame, bits: int) -> tuple[Arrays, list[int]]:
    """File names and summed statistics: one or two short rows per bucket."""
    arrays, sums = Arrays(bits), []
    for row in rows.filter(F.col("kind").isin(STATS, FILE)).collect():
        text = bytes(row["payload"]).decode()
        if row["kind"] == FILE:
            uri, n, kinds = text.split("\n")
            arrays.files[row["bucket"]] = uri, int(n), tuple(kinds.split(","))
        else:
            numbers = list(map(int, text.split(",")))
            sums = [a + b for a, b in zip(sums, numbers)] if sums else numbers
    return arrays, sums


def _file_rows(rows: DataFrame) -> tuple[dict[int, dict[int, tuple[str, str]]], dict[int, list[int]]]:
    """Files by kind and bucket, and summed statistics by order: a few short rows per bucket."""
    files, sums = {}, {}
    for row in rows.filter((F.col("kind") % LEVEL).isin(STATS, FILE, CONTEXT_FILE, NAMES)).collect():
        text = bytes(row["payload"]).decode()
        if row["kind"] % LEVEL == STATS:
            numbers = list(map(int, text.split(",")))
            level = row["kind"] // LEVEL
            sums[level] = [a + b for a, b in zip(sums[level], numbers)] if level in sums else numbers
        else:
            files.setdefault(row["kind"], {})[row["bucket"]] = tuple(text.split("\n"))
    return files, sums


def train(texts: DataFrame, order: int = ORDER) -> Model:
    """Counts the column ``text`` and writes the arrays to the shared folder."""
    if order < 2:
        raise ValueError("the order is at least 2")
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(0, (parts - 1).bit_length())
    folder, numbers = scratch_path(spark, "ngrams"), scratch_path(spark, "numbers")

    def merged(rows: DataFrame, run, name: str) -> tuple[DataFrame, str]:
        # one bucket a partition; hashed bucket numbers would put several into one and none into others
        return written(rows.repartitionById(1 << bits, F.col("bucket")).mapInArrow(run, _ROWS), name)

    rows, path = merged(texts.select("text").mapInArrow(_count_words(bits), _ROWS), _number_words(numbers, bits), "vocabulary")
    files, _ = _file_rows(rows)
    names = {b: (uri, int(n), tuple(kinds.split(","))) for b, (uri, n, kinds) in files.get(NAMES, {}).items()}
    words = Words(bits, Packed(bits, files.get(FILE, {})), names)
    drop(spark, path)
    rows, path, files, stats = texts.select("text").mapInArrow(_count(order, bits, words), _ROWS), None, {}, {}
    for level in [order, *range(order - 1 - (order > 2), 0, -1)]:
        before = path
        rows, path = merged(rows, _merge(folder, order, bits, words), f"grams{level}")
        if before:
            drop(spark, before)
        found, sums = _file_rows(rows)
        files |= found
        stats |= sums
        rows = rows.filter((F.col("kind") % LEVEL).isin(NGRAM, CONTEXT))
    drop(spark, path)
    drop(spark, numbers)
    discounts = {level: discounts_of(stats.get(level, [0] * 4)[:4]) for level in range(1, order + 1)}
    grams = {level: Packed(bits, files.get(FILE + LEVEL * level, {})) for level in range(2, order + 1)}
    contexts = {level: Contexts(bits, files.get(CONTEXT_FILE + LEVEL * level, {}), discounts[level]) for level in range(2, order + 1)}
    *ones, vocabulary, before_total, raw_total = stats.get(1, [0] * 7)
    more = vocabulary - ones[0] - ones[1]
    taken = discounts[1][0] * ones[0] + discounts[1][1] * ones[1] + discounts[1][2] * more
    back_off = taken / before_total if before_total else 1.0
    return Model(order, grams, contexts, Packed(bits, files.get(FILE + LEVEL, {})), discounts, vocabulary, raw_total, before_total, back_off)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` from rows ``doc_id, text, held_out``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column("text").cast(pa.binary())]
            turns = np.cumsum([len(t) for t in texts]) // (6 * BATCH_TOKENS)
            edges = [0, *(np.flatnonzero(np.diff(turns)) + 1).tolist(), len(texts)]
            for a, b in zip(edges, edges[1:]):
                tokens, known, base, score = model.score(texts[a:b])
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), pa.array(tokens, pa.int64()),
                        pa.array(known, pa.int64()), pa.array([model.raw_total] * (b - a), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return docs.select("doc_id", "text", "held_out").mapInArrow(run, schema)


def held_out_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Trains on the documents whose id's crc32 leaves another remainder than ``HELD_OUT``, and scores all."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    rows = docs.select("doc_id", "text").withColumn("held_out", fold == HELD_OUT)
    return scores(rows, train(rows.filter(~F.col("held_out")), order))
