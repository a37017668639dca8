"""Homomorphic multiset hash of a document's paragraphs.

A fingerprint is the sum, lane by lane, of wide vectors hashed from the paragraphs: ``LANES`` lanes of +1 or -1 modulo 2^32,
and four uniform lanes modulo 2^64. Sums do not depend on the order of the paragraphs, and paragraphs can be inserted into or
deleted from a fingerprint without the rest of the text. Equal multisets of paragraphs have equal fingerprints; different
ones differ in the uniform lanes but for a chance of about 2^-256 (the hash is not keyed).

The +-1 lanes are random signs, so the cosine of two fingerprints' lanes estimates that of their paragraph counts, with a
standard error of about 1/sqrt(LANES); ``likeness`` is that cosine, cut to 0..1.

Paragraphs are the sentences and lines of a text. One of more than ``LONG`` bytes is cut after each word whose checksum says
so, which gives the same pieces wherever the words stand.

Rows: a null text counts as empty; an empty text has no paragraph and fingerprint zero; likeness of two equal fingerprints
is 1, and 0 if one of two different ones is zero. Repeated rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANES, WIDE = 256, 4
LONG, CUT = 240, 8
END = re.compile(rb"(?<=[.!?])[ \t\r]+|[ \t\r]*\n\s*")
AT_ONCE = 1 << 14


def paragraphs(text: bytes) -> Iterator[bytes]:
    for part in END.split(text):
        if len(part) <= LONG:
            if part:
                yield part
            continue
        piece: list[bytes] = []
        for word in part.split(b" "):
            piece.append(word)
            if zlib.crc32(word) % CUT == 0:
                yield b" ".join(piece)
                piece = []
        if piece:
            yield b" ".join(piece)


class Fingerprint:
    """``signs``: LANES numbers modulo 2^32; ``wide``: four numbers modulo 2^64."""

    __slots__ = ("signs", "wide")

    def __init__(self, signs: np.ndarray | None = None, wide: np.ndarray | None = None):
        self.signs = np.zeros(LANES, np.uint32) if signs is None else signs
        self.wide = np.zeros(WIDE, np.uint64) if wide is None else wide

    def __add__(self, other: "Fingerprint") -> "Fingerprint":
        return Fingerprint(self.signs + other.signs, self.wide + other.wide)

    def __sub__(self, other: "Fingerprint") -> "Fingerprint":
        return Fingerprint(self.signs - other.signs, self.wide - other.wide)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and bool((self.signs == other.signs).all() and (self.wide == other.wide).all())

    def hex(self) -> str:
        return self.wide.astype("<u8").tobytes().hex() + self.signs.astype("<u4").tobytes().hex()

    @classmethod
    def from_hex(cls, text: str) -> "Fingerprint":
        data = bytes.fromhex(text)
        return cls(np.frombuffer(data, "<u4", LANES, 8 * WIDE).copy(), np.frombuffer(data, "<u8", WIDE).copy())


def of_paragraphs(parts: Iterator[bytes]) -> Fingerprint:
    """The sum over the paragraphs."""
    out, waiting = Fingerprint(), []

    def add() -> None:
        n = len(waiting)
        data = np.frombuffer(b"".join(waiting), np.uint8).reshape(n, 64)
        ones = np.unpackbits(data[:, :32], axis=1).sum(axis=0, dtype=np.int64)
        out.signs += (2 * ones - n).astype(np.uint32)
        out.wide += np.ascontiguousarray(data[:, 32:]).view("<u8").sum(axis=0, dtype=np.uint64)
        waiting.clear()

    for part in parts:
        waiting.append(hashlib.blake2b(part).digest())
        if len(waiting) == AT_ONCE:
            add()
    if waiting:
        add()
    return out


def fingerprint(text: bytes) -> Fingerprint:
    return of_paragraphs(paragraphs(text))


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    if a == b:
        return 1.0
    x, y = a.signs.view(np.int32).astype(float), b.signs.view(np.int32).astype(float)
    size = float(np.sqrt((x @ x) * (y @ y)))
    return min(max(float(x @ y) / size, 0.0), 1.0) if size else 0.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py() or b"").hex() for t in batch.column(1).cast(pa.binary())]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fingerprint string")


def _ranges(docs: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds that cut the ids into about equal ranges, and the first id of each range (none for empty ranges).

    The driver gets one number per range.
    """
    shares = [k / parts for k in range(1, parts)]
    bounds = np.array(sorted(set(docs.approxQuantile("_ord", shares, 0.2 / parts))) if shares else [], float)
    edges = F.array(*map(F.lit, bounds.tolist())).cast("array<double>")
    part = F.size(F.filter(edges, lambda b: b <= F.col("_ord").cast("double")))
    rows = docs.groupBy(part.alias("part")).agg(F.min("_ord").alias("first")).collect()
    firsts = np.full(len(bounds) + 1, -1, np.int64)
    known = np.zeros(len(bounds) + 1, bool)
    for row in rows:
        firsts[row["part"]], known[row["part"]] = row["first"], True
    return bounds, np.where(known, firsts, np.iinfo(np.int64).max), known


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, in which the last quarter of the code points (rounded down) is
    replaced by the first as many of the next document, by ascending id, the first following the last.

    A null id comes first; of equal ids the smaller text comes first. Ids are cut into ranges; each range is sorted on its
    own and also gets the rows of the next range's first id, so that only the texts themselves are shuffled, once.
    """
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("_ord"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds, firsts, known = _ranges(rows.select("_ord"), parts)
    filled = np.flatnonzero(known)
    previous = {int(b): int(a) for a, b in zip(np.roll(filled, 1), filled)}

    @F.arrow_udf("array<int>")
    def places(ids: pa.Array) -> pa.Array:
        """The row's own range, and the one that ends before the row."""
        ids = ids.to_numpy(zero_copy_only=False)
        own = np.searchsorted(bounds, ids.astype(float), "right")
        return pa.array([[p, previous[p]] if i == firsts[p] else [p] for i, p in zip(ids.tolist(), own.tolist())], pa.list_(pa.int32()))

    dealt = rows.select("_ord", "doc_id", "text", F.posexplode(places("_ord")).alias("_ahead", "_part"))
    dealt = dealt.repartitionById(parts // 4, F.col("_part")).sortWithinPartitions("_part", "_ahead", "_ord", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None           # the document that waits for the next one: part, id, text, fingerprint
        closed = False        # its range has seen the row that follows it
        out: list[tuple] = []

        def pair(text: str, print_: Fingerprint) -> None:
            _, doc_id, own, mark = held
            n = len(own) // 4
            edited = (own[: len(own) - n] + text[:n]) if n else own
            data = edited.encode()
            changed = fingerprint(data)
            out.append((
                doc_id, len(own), hashlib.sha256(data).hexdigest(), mark.hex(), changed.hex(), likeness(mark, changed), likeness(mark, print_),
            ))

        for batch in batches:
            for _, doc_id, text, ahead, part in zip(*(c.to_pylist() for c in batch.columns)):
                if held is not None and held[0] != part:
                    held, closed = None, False
                if closed:
                    continue  # more rows of the next range's first id
                mark = fingerprint(text.encode())
                if held is not None:
                    pair(text, mark)
                closed = ahead == 1
                held = (part, doc_id, text, mark)
                if len(out) >= 2_000:
                    yield _edit_rows(out)
                    out.clear()
        if out:
            yield _edit_rows(out)

    return dealt.mapInArrow(run, _EDIT_SCHEMA)


_EDIT_SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def _edit_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
    names = [f.split()[0] for f in _EDIT_SCHEMA.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
