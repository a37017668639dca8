"""Periodic runs of words, found by block convolution at dyadic scales.

A run is a stretch of words with smallest period q, at least ``LEAST`` words and ``TIMES`` periods long, that no neighbouring
word extends. Scale B = 1, 2, 4, ... finds the periods B <= q < 2B: such a run holds a whole aligned block of B words
together with its copy q words further on. The sums of squared differences between a block and every place of the window
behind it come from one convolution, an exact integer number theoretic transform modulo two primes; a sum is below their
product, so it is zero modulo both only where no word differs. The distance of such a place seeds an extension to both sides,
word by word. All blocks of a batch of texts that have the same scale are transformed together.

Two rules save work and change no result: a block is transformed only if each of its words comes again within the window,
which a zero sum needs; a seed inside a known run whose distance is a multiple of the run's period gives that run again.
The work is O(n log^2 n) for n words in the worst case; memory is proportional to the longest text of a batch.

Rows: null and wordless texts have no run; a null ``doc_id`` is carried along; repeated rows give repeated rows; an empty
table gives an empty result. Other columns do not matter, whatever they are called.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voc.llm.columns import shielded

LEAST, TIMES = 6, 4
# fixed values: primes below 2^31 with 2^26 dividing p - 1, and a primitive root of each
PRIMES = ((2013265921, 31), (1811939329, 13))
CELLS = 1 << 19          # numbers transformed at once
WORDS = 1 << 18          # words of texts analysed at once, one text at least

Run = tuple[int, int, int]   # start, length, period


@lru_cache(maxsize=64)
def _roots(prime: int, root: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..size/2 of a root of unity of order ``size``, and of its inverse."""

    def powers(base: int) -> np.ndarray:
        out = np.ones(max(size // 2, 1), np.uint64)
        known = 1
        while known < len(out):
            out[known : 2 * known] = out[:known] * np.uint64(pow(base, known, prime)) % np.uint64(prime)
            known *= 2
        return out

    base = pow(root, (prime - 1) // size, prime)
    return powers(base), powers(pow(base, prime - 2, prime))


def _forward(rows: np.ndarray, prime: int, root: int) -> np.ndarray:
    """Transform of every row, in bit-reversed order."""
    p, half = np.uint64(prime), rows.shape[1] // 2
    while half:
        pair = rows.reshape(len(rows), -1, 2, half)
        a, b = pair[:, :, 0], pair[:, :, 1]
        rows = np.stack([(a + b) % p, (a + p - b) % p * _roots(prime, root, 2 * half)[0] % p], axis=2).reshape(len(rows), -1)
        half //= 2
    return rows


def _backward(rows: np.ndarray, prime: int, root: int) -> np.ndarray:
    """The inverse of ``_forward``."""
    p, half, size = np.uint64(prime), 1, rows.shape[1]
    while half < size:
        pair = rows.reshape(len(rows), -1, 2, half)
        a, b = pair[:, :, 0], pair[:, :, 1] * _roots(prime, root, 2 * half)[1] % p
        rows = np.stack([(a + b) % p, (a + p - b) % p], axis=2).reshape(len(rows), -1)
        half *= 2
    return rows * np.uint64(pow(size, prime - 2, prime)) % p


def squared_differences(blocks: np.ndarray, windows: np.ndarray, prime: int, root: int) -> np.ndarray:
    """For every block of B numbers and its window of 2B, the sums of squared differences at the places 0..B-1, modulo the prime."""
    p, size = np.uint64(prime), blocks.shape[1]
    blocks, windows = blocks % p, windows % p
    turned = np.zeros_like(windows)
    turned[:, 0], turned[:, 2 * size - np.arange(1, size)] = blocks[:, 0], blocks[:, 1:]
    products = _backward(_forward(turned, prime, root) * _forward(windows, prime, root) % p, prime, root)[:, :size]
    # sums of fewer than 2^26 numbers below 2^31 stay below 2^57
    sums = np.concatenate([np.zeros((len(windows), 1), np.uint64), np.cumsum(windows * windows % p, axis=1)], axis=1)
    squares = (blocks * blocks % p).sum(axis=1, keepdims=True) + sums[:, size : 2 * size] - sums[:, :size]
    return (squares % p + 2 * (p - products)) % p


def _same(x: np.ndarray, i: int, j: int, room: int, step: int) -> int:
    """How many words from i and j on (``step`` -1: backwards) are equal, at most ``room``."""
    n, ahead = 0, 16
    while n < room:
        ahead = min(ahead, room - n)
        if step > 0:
            apart = x[i + n : i + n + ahead] != x[j + n : j + n + ahead]
        else:
            apart = x[i - n - ahead + 1 : i - n + 1][::-1] != x[j - n - ahead + 1 : j - n + 1][::-1]
        if apart.any():
            return n + int(apart.argmax())
        n, ahead = n + ahead, 2 * ahead
    return n


class _Known:
    """The runs found so far, to tell seeds that lie inside one."""

    def __init__(self) -> None:
        self.runs: set[tuple[int, int, int]] = set()      # start, end, period

    def inside(self, at: np.ndarray, away: np.ndarray, size: int) -> np.ndarray:
        if not self.runs:
            return np.zeros(len(at), bool)
        starts, ends, periods = np.array(sorted(self.runs)).T
        # of the runs that begin at or before a place, the one that reaches furthest
        reach = np.maximum.accumulate(ends)
        far = np.maximum.accumulate(np.where(ends == reach, np.arange(len(ends)), 0))
        i = np.searchsorted(starts, at, "right") - 1
        run = far[np.maximum(i, 0)]
        return (i >= 0) & (at + away + size <= ends[run]) & (away % periods[run] == 0)


def find_runs(words: np.ndarray, lengths: np.ndarray) -> list[list[Run]]:
    """The runs of each of some texts, in order of start and period; ``words`` numbers the words of all texts in a row."""
    words = np.ascontiguousarray(words, np.uint64)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    total, text = len(words), np.repeat(np.arange(len(lengths)), lengths)
    order = np.lexsort((words, text))
    again = np.full(total, total, np.int64)                # distance to the word's next place in its text
    if total:
        near = (words[order][1:] == words[order][:-1]) & (text[order][1:] == text[order][:-1])
        again[order[:-1][near]] = (order[1:] - order[:-1])[near]
    other = np.uint64(int(words.max()) + 1 if total else 1)   # stands behind the end of a text
    known, size = _Known(), 1
    while total and TIMES * size <= int(lengths.max()):
        counts = np.where(lengths >= max(LEAST, TIMES * size), lengths // size, 0)
        at = np.repeat(begins - size * (np.cumsum(counts) - counts), counts) + size * np.arange(counts.sum())
        widest = np.maximum.reduceat(again, np.stack([at, at + size], 1).ravel().clip(max=total - 1))[::2] if size > 1 else again[at]
        if size > 1 and len(at) and at[-1] + size >= total:
            widest[-1] = again[at[-1] : at[-1] + size].max()
        at = at[widest < 2 * size]
        seeds = [_seeds(words, at[low : low + max(CELLS // (2 * size), 1)], ends, text, size, other)
                 for low in range(0, len(at), max(CELLS // (2 * size), 1))]
        if seeds:
            place, away = (np.concatenate(s) for s in zip(*seeds))
            new = ~known.inside(place, away, size)
            known.runs |= _extended(words, place[new], away[new], size, begins, ends, text)
        size *= 2
    # a stretch is listed once, with its smallest period
    least: dict[tuple[int, int], int] = {}
    for start, end, period in known.runs:
        least[start, end] = min(period, least.get((start, end), period))
    out: list[list[Run]] = [[] for _ in lengths]
    for (start, end), period in least.items():
        if end - start >= max(LEAST, TIMES * period):
            out[text[start]].append((int(start - begins[text[start]]), int(end - start), int(period)))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def _seeds(words: np.ndarray, at: np.ndarray, ends: np.ndarray, text: np.ndarray, size: int, other: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Places of blocks and the distances size..2*size-1 at which they come again."""
    spots = at[:, None] + size + np.arange(2 * size)
    windows = np.where(spots < ends[text[at]][:, None], words[np.minimum(spots, len(words) - 1)], other)
    blocks = words[at[:, None] + np.arange(size)]
    zero = np.ones((len(at), size), bool)
    for prime, root in PRIMES:
        zero &= squared_differences(blocks, windows, prime, root) == 0
    block, place = np.nonzero(zero)
    return at[block], place + size


def _extended(
    words: np.ndarray, place: np.ndarray, away: np.ndarray, size: int, begins: np.ndarray, ends: np.ndarray, text: np.ndarray
) -> set[tuple[int, int, int]]:
    """The longest stretches around the seeds as (start, end, period), those long enough to be runs of that period."""
    found: set[tuple[int, int, int]] = set()
    order = np.lexsort((place, away))
    place, away = place[order], away[order]
    bounds = [0, *(np.flatnonzero(np.diff(away)) + 1).tolist(), len(away)]
    for low, high in zip(bounds, bounds[1:]):
        if low == high:
            continue
        spots, d, i = place[low:high].tolist(), int(away[low]), 0
        while i < len(spots):
            b = spots[i]
            begin, end = int(begins[text[b]]), int(ends[text[b]])
            right = _same(words, b, b + d, end - b - d, 1)
            start = b - _same(words, b - 1, b + d - 1, b - begin, -1)
            stop = b + d + right
            if right >= size and stop - start >= max(LEAST, TIMES * d):
                found.add((start, stop, d))
            # seeds of this distance inside the stretch give it again
            i = max(i + 1, bisect_left(spots, stop - d - size + 1, i))
    return found


def _in_blocks(texts: list[bytes], change: Callable[[list[bytes], int], list[bytes]] | None) -> Iterator[tuple[list[list[bytes]], list[list[Run]]]]:
    """Words and runs of texts, as many texts at once as have ``WORDS`` words."""
    waiting: list[list[bytes]] = []
    size = 0

    def solved() -> tuple[list[list[bytes]], list[list[Run]]]:
        number: dict[bytes, int] = {}
        lengths = np.array([len(w) for w in waiting], np.int64)
        numbers = np.fromiter((number.setdefault(w, len(number)) for words in waiting for w in words), np.uint64, int(lengths.sum()))
        return waiting, find_runs(numbers, lengths)

    for i, text in enumerate(texts):
        words = text.split()
        waiting.append(change(words, i) if change else words)
        size += len(waiting[-1])
        if size >= WORDS:
            yield solved()
            waiting, size = [], 0
    if waiting:
        yield solved()


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words of the text with the first period of each run only."""
    if not runs:
        return words
    stay = np.ones(len(words), bool)
    for start, length, period in runs:
        stay[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(stay)]


def looped(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document; a tenth of the documents, chosen by the checksum of the id, gets a periodic end."""
    if doc_id is None or not words or (h := zlib.crc32(b"%d" % doc_id)) % 10:
        return words
    g = h // 10
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((len(words) - a) // p + 1))[: len(words) - a]


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    for batch in batches:
        ids, rows = batch.column(0).to_pylist(), []
        for texts, found in _in_blocks(_texts(batch.column(1)), lambda words, i: looped(words, ids[i])):
            for words, runs in zip(texts, found):
                top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
                kept = b" ".join(kept_words(words, runs))
                rows.append((len(runs), *top, 1000 * top[1] // top[2] if runs else None,
                             hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest()))
        kinds = [*[pa.int64()] * 5, pa.string(), pa.string()]
        columns = zip(*rows) if rows else [[]] * len(kinds)
        yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)


def digests(docs: DataFrame) -> DataFrame:
    """Number of runs, the longest one and digests of all runs and of the collapsed text, per document with its looped words."""
    schema = (
        "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
        "runs_sha256 string, collapsed_sha256 string"
    )
    return docs.select("doc_id", "text").mapInArrow(_digest_rows, schema)


def runs(docs: DataFrame) -> DataFrame:
    """``doc_id, start, length, period``: one row per run of the texts as they are."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, done = batch.column(0).to_pylist(), 0
            for texts, found in _in_blocks(_texts(batch.column(1)), None):
                flat = [(ids[done + i], *run) for i, of in enumerate(found) for run in of]
                done += len(texts)
                if flat:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*flat)], names=["doc_id", "start", "length", "period"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id bigint, start bigint, length bigint, period bigint")


def collapsed(docs: DataFrame) -> DataFrame:
    """The table with each run of a text cut to its first period, where there is one; words are then joined by one space."""
    kept, names, back = shielded(docs, "text")
    at = names.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(at), []
            for words, found in _in_blocks(_texts(texts), None):
                for some, of in zip(words, found):
                    out.append(b" ".join(kept_words(some, of)) if of else None)
            new = [t.as_py() if o is None else o.decode() for t, o in zip(texts, out)]
            columns = [pa.array(new, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.record_batch(columns, names=batch.schema.names)

    return back(kept.mapInArrow(rows, kept.schema))
