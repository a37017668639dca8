"""Reviews that repeat an earlier one nearly word by word."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voc.storage import drop, written

SHINGLE = 5
SIMILARITY = 0.9
BANDS, ROWS = 32, 4
SKETCH = 1 << 16               # frequencies kept of shingles
PIECE = 128                    # texts worked on at once
PARTS = 256                    # counts of a set's shingles, by their hash


def _signatures(size: int, bands: int, rows: int):
    """Distinct shingle hashes and band keys of texts, as two aligned Arrow functions share them."""
    mix = np.random.default_rng(1).integers(1, 2**63, (2, bands * rows), dtype=np.uint64) | np.uint64(1)

    def shingles(text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        if len(words) < size:
            return np.array([xxhash.xxh64_intdigest(" ".join(words))], np.uint64)
        hashes, count = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64), len(words) - size + 1
        found = np.zeros(count, np.uint64)
        for i in range(size):
            found = found * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + count]
        found ^= found >> np.uint64(32)
        found *= np.uint64(0xD6E8FEB86659FD93)
        found ^= found >> np.uint64(29)
        return np.unique(found)

    def keys(found: np.ndarray) -> list[int]:
        least = np.full(bands * rows, 2**64 - 1, np.uint64)
        for low in range(0, len(found), 4_096):
            mixed = (found[low : low + 4_096, None] * mix[0]) ^ mix[1]
            mixed ^= mixed >> np.uint64(31)
            least = np.minimum(least, (mixed * mix[0]).min(axis=0))
        return [
            xxhash.xxh64_intdigest(least[k : k + rows].tobytes(), k) - 2**63 for k in range(0, bands * rows, rows)
        ]

    return shingles, keys


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``PIECE`` rows: what is made of a batch is many times larger, so it has to be small."""
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            yield batch.slice(at, PIECE)


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    """Numbers of 64 bits as lists, without an object for each."""
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    values = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def similar_to_earlier(
    df: DataFrame, text: str = "cleaned_text", similarity: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """``ord`` of every row that shares at least ``similarity`` of its word shingles (Jaccard) with an earlier row.

    Two steps find every such row. First each row is compared with the earliest row of its min-hash bands, so a band of any
    size gives one comparison per row and no pairs, and a band that a third of the rows share is partially aggregated. What
    is left, the first row of each different set of shingles, is then joined with all earlier sets on rare shingles: two sets
    of that similarity share one of the first ``n - ceil(similarity * n) + 1`` shingles of each, in any common order. The
    order is by frequency, so a template's shingles are in that prefix only of rows that differ from it by less. Pairs are
    checked on all their shingles.

    Sets of shingles are larger than their texts, so the texts are kept and sets are made anew where they are needed: whole sets
    only for the rows of pairs whose counts of shingles in ``PARTS`` parts allow the similarity. Tables and shuffle files go when
    they are read.
    """
    spark = df.sparkSession
    shingles, keys = _signatures(size, bands, rows)
    texts, texts_path = written(df.select("ord", F.col(text).alias("text")), "near_texts")

    def run(batches):
        kinds = [pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
        for batch in _pieces(batches):
            found = [shingles(t.as_py()) for t in batch.column(1)]
            digests = [[xxhash.xxh64_intdigest(f.tobytes(), seed) - 2**63 for f in found] for seed in (0, 1)]
            columns = [[len(f) for f in found], [_parts(f) for f in found], [keys(f) for f in found], *digests]
            yield pa.record_batch([batch.column(0), *map(pa.array, columns, kinds)], names=["ord", "n", "parts", "bands", "a", "b"])

    signed, signed_path = written(texts.mapInArrow(run, "ord bigint, n int, parts binary, bands array<bigint>, a bigint, b bigint"), "signatures")
    banded = signed.select("ord", F.posexplode("bands").alias("band", "key"))
    first = banded.groupBy("band", "key").agg(F.min("ord").alias("first"), F.count("*").alias("n")).where(F.col("n") > 1)
    pairs = banded.join(first, ["band", "key"]).where(F.col("ord") > F.col("first")).select("ord", "first").distinct()

    def checked(pairs: DataFrame) -> DataFrame:
        """``ord`` of the pairs that are as similar as asked."""
        pairs, pairs_path = written(pairs, "near_pairs")
        counts = signed.select("ord", "n", "parts")
        both = pairs.join(counts, "ord").join(counts.select(F.col("ord").alias("first"), F.col("n").alias("m"), F.col("parts").alias("other")), "first")
        possible, possible_path = written(both.mapInArrow(_possible(similarity), "ord bigint, first bigint").distinct(), "possible_pairs")

        def whole(batches):
            for batch in _pieces(batches):
                yield pa.record_batch([batch.column(0), _lists([shingles(t.as_py()) for t in batch.column(1)])], names=["ord", "shingles"])

        ends = possible.select(F.explode(F.array("ord", "first")).alias("ord")).distinct()
        sets, sets_path = written(texts.join(ends, "ord", "left_semi").mapInArrow(whole, "ord bigint, shingles array<bigint>"), "near_sets")
        own = sets.select("ord", F.col("shingles").alias("own"))
        other = sets.select(F.col("ord").alias("first"), F.col("shingles").alias("other"))
        shared = F.size(F.array_intersect("own", "other"))
        alike = shared >= F.lit(similarity) * (F.size("own") + F.size("other") - shared)
        found, _ = written(possible.join(own, "ord").join(other, "first").where(alike).select("ord").distinct(), "near_found")
        for path in (pairs_path, possible_path, sets_path):
            drop(spark, path)
        return found

    found = checked(pairs)
    keyed = signed.select("ord", "a", "b")
    sets = keyed.groupBy("a", "b").agg(F.min("ord").alias("first"), F.count("*").alias("n")).where(F.col("n") > 1)
    equal, _ = written(keyed.join(sets, ["a", "b"]).where(F.col("ord") > F.col("first")).select("ord"), "equal")
    prefixes, prefixes_path = written(_prefixes(texts, shingles, similarity).join(equal, "ord", "left_anti"), "prefixes")
    earlier = prefixes.select(F.col("ord").alias("first"), F.col("n").alias("m"), F.posexplode("prefix").alias("j", "shingle"))
    left = prefixes.join(found, "ord", "left_anti").select("ord", "n", F.posexplode("prefix").alias("i", "shingle"))
    # shingles that the two can share from their common one on, against what the similarity asks of their sizes
    most = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    enough = most >= F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("m")) - F.lit(1e-6)
    pairs = left.join(earlier, "shingle").where((F.col("first") < F.col("ord")) & enough).select("ord", "first").distinct()
    rest = checked(pairs)
    for path in (texts_path, signed_path, prefixes_path):
        drop(spark, path)
    return found.unionByName(rest).unionByName(equal).distinct()


def _parts(found: np.ndarray) -> bytes | None:
    """How many shingles are in each of ``PARTS`` parts, none if a count does not fit a byte."""
    counts = np.bincount((found >> np.uint64(64 - (PARTS - 1).bit_length())).astype(np.int64), minlength=PARTS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def _possible(similarity: float):
    """``ord, first`` of the pairs that may share enough: at most the lesser count of each part."""

    def run(batches):
        for batch in batches:
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "m"))
            most = np.minimum(n, m)
            some = np.flatnonzero([a and b for a, b in zip(batch.column("parts").is_valid().to_pylist(), batch.column("other").is_valid().to_pylist())])
            for at in range(0, len(some), 4096):
                rows = some[at : at + 4096]
                a, b = (np.frombuffer(b"".join(batch.column(c).take(pa.array(rows)).to_pylist()), np.uint8).reshape(-1, PARTS) for c in ("parts", "other"))
                most[rows] = np.minimum(a, b).sum(axis=1, dtype=np.int64)
            keep = pa.array(np.flatnonzero(most >= similarity * (n + m - most) - 1e-6))
            yield pa.record_batch([batch.column(c).take(keep) for c in ("ord", "first")], names=["ord", "first"])

    return run


def _prefixes(texts: DataFrame, shingles, similarity: float) -> DataFrame:
    """``ord, n, prefix``: size of a text's set and its rarest shingles, by a frequency table of ``SKETCH`` numbers."""
    shift = np.uint64(64 - (SKETCH - 1).bit_length())

    def count(batches):
        counts = np.zeros(SKETCH, np.int64)
        for batch in _pieces(batches):
            for t in batch.column(0):
                np.add.at(counts, (shingles(t.as_py()) >> shift).astype(np.int64), 1)
        some = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["place", "n"])

    rows = texts.select("text").mapInArrow(count, "place int, n bigint").groupBy("place").agg(F.sum("n")).collect()
    frequency = np.zeros(SKETCH, np.int64)
    for place, n in rows:
        frequency[place] = n

    def cut(batches):
        for batch in _pieces(batches):
            sizes, prefixes = [], []
            for t in batch.column(1):
                found = shingles(t.as_py())
                n = len(found)
                order = np.lexsort((found, frequency[(found >> shift).astype(np.int64)]))
                sizes.append(n)
                prefixes.append(found[order[: n - math.ceil(similarity * n - 1e-6) + 1]])
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int32()), _lists(prefixes)], names=["ord", "n", "prefix"])

    return texts.mapInArrow(cut, "ord bigint, n int, prefix array<bigint>")


def without_near_copies(df: DataFrame, text: str = "cleaned_text", similarity: float = SIMILARITY) -> DataFrame:
    return df.join(similar_to_earlier(df, text, similarity), "ord", "left_anti")
