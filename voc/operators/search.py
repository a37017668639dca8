"""Ranked search over an inverted index, exact top-k with early termination.

Texts are dealt to shards of about ``SHARD_DOCS`` by a hash of their key, so that the postings of a common word are cut by
text. A shard holds its words' postings in blocks of ``BLOCK``: gaps between text numbers and counts as variable-length bytes,
and per block the last text, the largest count and the smallest length, which bound what any of its texts can score.

A query's score of a text is BM25 over its different words. Queries meet every shard in packs of ``QUERIES``, whose words are
numbered. A shard of at most ``KEPT`` postings is decoded whole and scores ``TILE`` queries at once: words that many of a pack's
queries and many of the shard's texts have are columns of a matrix product, the postings of all others are added one by one.
In a larger shard a query's words are taken by falling bound. Once the k-th best score so far is above what all words still to
come can add, a text not yet met cannot enter; from then on only blocks that hold a text still in reach are decoded. The k best
of all shards are merged.

Rows: null and wordless texts match nothing but count as texts; rows of one key are texts of their own and are listed together;
a query without known words finds nothing. Equal scores (to nine decimals) go by key.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voc.functions.text import tokens
from voc.storage import materialize

SHARD_DOCS, LEAST_DOCS, BLOCK, QUERIES, TILE = 8192, 1024, 128, 4096, 128
K1, B, TOP, DECIMALS = 1.2, 0.75, 10, 9
CLOSE_BY = 1e-6          # what is nearer to the k-th best score than this is still looked at
KEPT = 8 << 20           # decoded postings that a shard keeps for its queries
PIECE = 1 << 17          # postings worked on at once
DENSE, COLUMNS = 350, 512   # what adding a posting costs beside a product of two numbers; words of a matrix product at most

_SHARD = (
    "shard int, keys array<bigint>, lengths array<int>, terms array<string>, counts array<int>, firsts array<int>, "
    "last array<int>, most array<int>, least array<int>, starts array<bigint>, data binary"
)


def packed(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Numbers as bytes of seven bits, low ones first, the top bit set on all but a number's last; and where each begins."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for i in range(1, 5):
        sizes += values >= np.uint64(1 << 7 * i)
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for i in range(int(sizes.max(initial=0))):
        has = sizes > i
        part = (values[has] >> np.uint64(7 * i) & np.uint64(127)).astype(np.uint8)
        out[starts[has] + i] = part | np.where(sizes[has] > i + 1, 128, 0).astype(np.uint8)
    return out.tobytes(), starts


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    if not len(ends):
        return np.zeros(0, np.int64)
    begins = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(begins, ends - begins + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, begins)


def _ungapped(gap: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rising numbers from their gaps, in stretches of the given sizes that each begin with a number itself."""
    heads, total = np.cumsum(sizes) - sizes, np.cumsum(gap)
    return total - np.repeat(total[heads] - gap[heads], sizes)


def _runs(begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all stretches ``begins[i], begins[i] + 1, ...`` and the i of each."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(len(of)) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)


def _pack_shard(shard: int, keys: list[int], words: pa.ListArray | list[list[str]]) -> dict:
    words = words if isinstance(words, pa.Array) else pa.array(words, pa.list_(pa.string()))
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy().astype(np.int64)
    coded = words.flatten().dictionary_encode()   # no text of a word is an object of its own
    terms, pair = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    del coded, words
    pair *= len(keys)
    pair += np.repeat(np.arange(len(keys)), lengths)
    pair.sort()
    begins = np.flatnonzero(np.diff(pair, prepend=-1))
    pair, count = pair[begins], np.diff(begins, append=len(pair))
    del begins
    term, doc = pair // max(len(keys), 1), pair % max(len(keys), 1)
    counts = np.bincount(term, minlength=len(terms))
    place = np.arange(len(term)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = place % BLOCK == 0
    gap = np.where(first, doc, np.diff(doc, prepend=0))
    data, starts, at = [], [], 0
    for low in range(0, len(doc), PIECE):
        some, places = packed(np.stack([gap[low : low + PIECE], count[low : low + PIECE]], 1).ravel())
        data.append(some)
        starts.append(places[::2][first[low : low + PIECE]] + at)
        at += len(some)
    begins = np.flatnonzero(first)
    blocks = -(-counts // BLOCK)
    return {
        "shard": shard, "keys": keys, "lengths": lengths.astype(np.int32), "terms": terms, "counts": counts.astype(np.int32),
        "firsts": np.concatenate([[0], np.cumsum(blocks)]).astype(np.int32),
        "last": np.append(doc[begins[1:] - 1], doc[-1:]).astype(np.int32) if len(begins) else np.zeros(0, np.int32),
        "most": (np.maximum.reduceat(count, begins) if len(begins) else count).astype(np.int32),
        "least": (np.minimum.reduceat(lengths[doc], begins) if len(begins) else count).astype(np.int32),
        "starts": np.concatenate([*starts, [at]]), "data": b"".join(data),
    }


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per shard from a partition sorted by shard."""
    kinds = {
        "shard": pa.int32(), "keys": pa.list_(pa.int64()), "lengths": pa.list_(pa.int32()), "terms": pa.list_(pa.string()),
        "counts": pa.list_(pa.int32()), "firsts": pa.list_(pa.int32()), "last": pa.list_(pa.int32()), "most": pa.list_(pa.int32()),
        "least": pa.list_(pa.int32()), "starts": pa.list_(pa.int64()), "data": pa.binary(),
    }
    at, keys, words = None, [], []

    def taken() -> pa.Array:
        whole = pa.concat_arrays(words)
        words.clear()
        return whole

    def row() -> pa.RecordBatch:
        made = _pack_shard(at, keys, taken())   # which holds the only words left
        return pa.record_batch([_one(made[n], kind) for n, kind in kinds.items()], names=list(kinds))

    for batch in batches:
        shards = batch.column("shard").to_numpy()
        begins = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for low, high in zip(begins, begins[1:]):
            if low == high:
                continue
            if shards[low] != at and keys:
                yield row()
                keys = []
            at = int(shards[low])
            keys += batch.column("key")[low:high].to_pylist()
            words.append(batch.column("words")[low:high])
        pa.default_memory_pool().release_unused()
    if keys:
        yield row()


def _one(value, kind: pa.DataType) -> pa.Array:
    """A column of one row."""
    if not pa.types.is_list(kind):
        return pa.array([value], kind)
    values = value if isinstance(value, pa.Array) else pa.array(value, kind.value_type)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


@dataclass
class Pack:
    """Queries with their words: ``queries``, how many words each has, and per word its place in ``terms``, rising in a query."""

    queries: np.ndarray
    sizes: np.ndarray
    code: np.ndarray
    terms: list[str]
    idf: np.ndarray

    @classmethod
    def read(cls, row: dict) -> Pack:
        sizes = np.array(row["sizes"], np.int64)
        idf, terms = np.array(row["idf"])[unpacked(row["ranks"])], zlib.decompress(row["terms"]).decode().split(" ")
        return cls(np.array(row["queries"], np.int64), sizes, _ungapped(unpacked(row["codes"]), sizes), terms, idf)

    def asked(self, i: int) -> list[tuple[str, float]]:
        end = int(self.sizes[: i + 1].sum())
        return [(self.terms[c], float(self.idf[c])) for c in self.code[end - self.sizes[i] : end].tolist()]


_PACK = "struct<queries: array<bigint>, sizes: array<int>, codes: binary, terms: binary, ranks: binary, idf: array<double>>"


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A pack's words are numbered and written once, in order and compressed, as every shard gets every pack; words have no blanks."""
    kinds = {
        "queries": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "codes": pa.binary(), "terms": pa.binary(), "ranks": pa.binary(),
        "idf": pa.list_(pa.float64()),
    }
    for batch in batches:
        for pack in batch.column("asked"):
            query, terms = (pc.struct_field(pack.values, n) for n in ("query", "terms"))
            sizes = pc.list_value_length(terms).to_numpy()
            word, idf = (pc.struct_field(terms.flatten(), n) for n in ("term", "idf"))
            coded = word.dictionary_encode()
            order = pc.array_sort_indices(coded.dictionary).to_numpy()
            code = np.argsort(order)[coded.indices.to_numpy()]
            idf = idf.to_numpy()[np.unique(code, return_index=True)[1]]
            idf, rank = np.unique(idf, return_inverse=True)   # one for each number of texts that have a word
            of = np.repeat(np.arange(len(sizes)), sizes)
            code = code[np.lexsort((code, of))]
            heads = np.cumsum(sizes) - sizes
            gap = np.diff(code, prepend=0)
            gap[heads] = code[heads]
            terms = zlib.compress(" ".join(coded.dictionary.take(pa.array(order)).to_pylist()).encode())
            row = {"queries": query, "sizes": sizes, "codes": packed(gap)[0], "terms": terms, "ranks": packed(rank)[0], "idf": idf}
            yield pa.record_batch([pa.StructArray.from_arrays([_one(row[n], kind) for n, kind in kinds.items()], names=list(kinds))], names=["asked"])


@dataclass
class Index:
    shards: DataFrame      # one packed row per shard
    known: DataFrame       # term, idf
    count: int             # of shards
    average: float         # words of a text


def build(docs: DataFrame, key: str, text: str, shard_docs: int = SHARD_DOCS) -> Index:
    n = docs.count()
    # a smaller table gives work to all cores
    shard_docs = min(shard_docs, max(n // (3 * docs.sparkSession.sparkContext.defaultParallelism), LEAST_DOCS))
    count = max(-(-n // shard_docs), 1)
    rows = docs.select(F.pmod(F.xxhash64(key, text), F.lit(count)).cast("int").alias("shard"), F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    rows = rows.repartition("shard").sortWithinPartitions("shard", "key").select("shard", "key", tokens("text").alias("words"))
    shards = materialize(rows.mapInArrow(_shards, _SHARD), "search_index")
    words = shards.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda s, x: s + x))).first()[0] or 0
    df = shards.select(F.inline(F.arrays_zip("terms", "counts"))).groupBy(F.col("terms").alias("term")).agg(F.sum("counts").alias("df"))
    known = df.select("term", F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    return Index(shards, materialize(known, "search_terms"), count, max(words / max(n, 1), 1e-9))


class Shard:
    """A shard's postings, decoded as asked for; ``decoded`` counts blocks. Whole terms are kept while there is room."""

    def __init__(self, row: dict, average: float):
        self.keys, self.lengths = np.array(row["keys"], np.int64), np.array(row["lengths"], np.int64)
        self.number = {t: i for i, t in enumerate(row["terms"].to_pylist() if isinstance(row["terms"], pa.Array) else row["terms"])}
        self.counts, self.firsts, self.last = (np.array(row[n], np.int64) for n in ("counts", "firsts", "last"))
        self.starts, self.data, self.average, self.decoded = np.array(row["starts"], np.int64), row["data"], average, 0
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.room = KEPT
        self.bounds = self._part(np.array(row["most"], np.float64), np.array(row["least"], np.float64))
        self.highest = np.maximum.reduceat(self.bounds, self.firsts[:-1]) if len(self.counts) else self.bounds
        self.opened: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def open(self) -> None:
        """Decodes all postings at once if there is room for them, for a shard that many queries come to."""
        if not 0 < self.counts.sum() <= self.room:
            return
        sizes = np.full(len(self.last), BLOCK)
        sizes[self.firsts[1:] - 1] = (self.counts - 1) % BLOCK + 1
        begins = np.concatenate([[0], np.cumsum(self.counts)])
        doc, part = np.empty(begins[-1], np.int32), np.empty(begins[-1])
        at = 0
        for low in range(0, len(sizes), PIECE // BLOCK):
            some = sizes[low : low + PIECE // BLOCK]
            values = unpacked(self.data[self.starts[low] : self.starts[low + len(some)]])
            found, end = _ungapped(values[::2], some), at + len(values) // 2
            doc[at:end] = found
            part[at:end] = self._part(values[1::2].astype(np.float64), self.lengths[found].astype(np.float64))
            at = end
        self.opened = begins, doc, part
        self.decoded, self.room = self.decoded + len(sizes), 0

    def _part(self, count: np.ndarray, length: np.ndarray) -> np.ndarray:
        return count * (K1 + 1) / (count + K1 * (1 - B + B * length / self.average))

    def postings(self, term: int, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts and score parts of some blocks of a term, by their numbers in the shard."""
        self.decoded += len(blocks)
        data = b"".join(self.data[self.starts[b] : self.starts[b + 1]] for b in blocks.tolist())
        values = unpacked(data)
        gap, count = values[::2], values[1::2]
        sizes = np.full(len(blocks), BLOCK)
        end = self.firsts[term + 1] - 1
        sizes[blocks == end] = (self.counts[term] - 1) % BLOCK + 1
        doc = _ungapped(gap, sizes)
        return doc, self._part(count.astype(np.float64), self.lengths[doc].astype(np.float64))

    def whole(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        if self.opened is not None:
            begins, doc, part = self.opened
            return doc[begins[term] : begins[term + 1]], part[begins[term] : begins[term + 1]]
        found = self.kept.get(term)
        if found is None:
            found = self.postings(term, np.arange(self.firsts[term], self.firsts[term + 1]))
            if len(found[0]) <= self.room:
                self.room -= len(found[0])
                self.kept[term] = found
        return found

    @staticmethod
    def _least(scores: np.ndarray, k: int) -> float:
        """The k-th best score so far, minus infinity if fewer texts are met."""
        return float(np.partition(scores, len(scores) - k)[len(scores) - k]) or -np.inf if len(scores) >= k else -np.inf

    def best(self, asked: list[tuple[str, float]], k: int) -> list[tuple[float, int]]:
        """The k best texts as (score, key)."""
        terms = [(self.number[t], idf) for t, idf in asked if t in self.number]
        bound = [idf * float(self.highest[t]) for t, idf in terms]
        order = sorted(range(len(terms)), key=lambda i: -bound[i])
        to_come = np.cumsum([0.0, *(bound[i] for i in reversed(order))])[::-1]
        scores = np.zeros(len(self.keys))
        for turn, i in enumerate(order):
            term, idf = terms[i]
            # a kept term costs no decoding, whatever is in reach
            least = -np.inf if self.opened is not None or term in self.kept else self._least(scores, k)
            if least > to_come[turn] + CLOSE_BY:
                blocks = np.arange(self.firsts[term], self.firsts[term + 1])
                near = np.flatnonzero(scores + to_come[turn] >= least - CLOSE_BY)
                at = np.searchsorted(self.last[blocks], near)
                blocks = blocks[np.unique(at[at < len(blocks)])]
                if not len(blocks):
                    continue
                doc, part = self.postings(term, blocks)
            else:
                doc, part = self.whole(term)
            scores[doc] += idf * part
        found = np.flatnonzero((scores > 0) & (scores >= self._least(scores, k) - CLOSE_BY))
        rounded = np.round(scores[found], DECIMALS)
        top = np.lexsort((self.keys[found], -rounded))[:k]
        return [(float(rounded[i]), int(self.keys[found[i]])) for i in top.tolist()]

    def best_of(self, pack: Pack, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The k best texts of a pack's queries as arrays of query, score and key, by query, score and key, from an opened shard."""
        begins, doc, part = self.opened
        queries, docs = len(pack.queries), len(self.keys)
        number = np.array([self.number.get(t, -1) for t in pack.terms], np.int64)
        known = number[pack.code] >= 0
        of, code = np.repeat(np.arange(queries), pack.sizes)[known], pack.code[known]
        counts = np.where(number >= 0, self.counts[number], 0)
        gain = np.bincount(code, minlength=len(number)) * counts
        dense = np.flatnonzero(gain * DENSE > queries * docs)
        dense = dense[np.argsort(-gain[dense], kind="stable")[:COLUMNS]]
        column = np.full(len(number), -1, np.int64)
        column[dense] = np.arange(len(dense))
        matrix = np.zeros((len(dense), docs))
        for low in range(0, len(dense), max(PIECE // docs, 1)):
            some = dense[low : low + max(PIECE // docs, 1)]
            row, at = _runs(begins[number[some]], counts[some])
            matrix[low + row, doc[at]] = part[at]
        in_matrix = column[code] >= 0
        ends = np.searchsorted(of, np.arange(queries + TILE))
        for low in range(0, queries, TILE):
            rows = min(TILE, queries - low)
            one, own, inside = (x[ends[low] : ends[low + rows]] for x in (of - low, code, in_matrix))
            weights = np.zeros((rows, len(dense)))
            weights[one[inside], column[own[inside]]] = pack.idf[own[inside]]
            scores = weights @ matrix
            self._add(scores, one[~inside], number[own[~inside]], pack.idf[own[~inside]])
            query, score, key = self._top(scores, k)
            yield pack.queries[low + query], score, key

    def _add(self, scores: np.ndarray, query: np.ndarray, term: np.ndarray, idf: np.ndarray) -> None:
        """Adds the postings of a query's term, for many queries and terms."""
        begins, doc, part = self.opened
        sizes, flat = self.counts[term], scores.reshape(-1)
        ends, low = np.cumsum(sizes), 0
        while low < len(term):
            high = max(int(np.searchsorted(ends, ends[low] - sizes[low] + PIECE)), low + 1)
            some = slice(low, high)
            of, at = _runs(begins[term[some]], sizes[some])
            place = (query[some] * scores.shape[1])[of]
            place += doc[at]
            more = part[at]
            more *= idf[some][of]
            np.add.at(flat, place, more)
            low = high

    def _top(self, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, score and key of each query's k best texts."""
        docs = scores.shape[1]
        width = max(min(BLOCK, docs // (4 * k)), 1)
        blocks = docs // width
        least = np.zeros(len(scores))
        if blocks >= k:   # as many texts as blocks have at least the k-th largest maximum of the blocks
            most = scores[:, : blocks * width].reshape(len(scores), blocks, width).max(axis=2)
            least = np.partition(most, blocks - k, axis=1)[:, blocks - k]
        least = np.where(least > 0, np.maximum(least - CLOSE_BY, 0), 0)
        at = np.flatnonzero(scores > least[:, None])
        query, text = at // docs, at % docs
        score, key = np.round(scores.reshape(-1)[at], DECIMALS), self.keys[text]
        order = np.lexsort((key, -score, query))
        query = query[order]
        first = order[np.arange(len(query)) - np.searchsorted(query, query) < k]
        return at[first] // docs, score[first], key[first]


def _answers(k: int, average: float):
    """Answers from rows sorted by shard: the shard itself, which is held, then the packs of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        names = [f.split()[0] for f in _SHARD.split(", ")]
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column("shard")[i].as_py()
                if not batch.column("asked")[i].is_valid:
                    row = {n: batch.column(n)[i] for n in names}
                    values = {n: v.values if isinstance(v, pa.ListScalar) and n != "keys" else v.as_py() for n, v in row.items()}
                    at, shard = number, Shard(values, average)
                    shard.open()
                    pa.default_memory_pool().release_unused()
                    continue
                if number != at:
                    continue
                pack = Pack.read(batch.column("asked")[i].as_py())
                if shard.opened is not None:
                    found = shard.best_of(pack, k)
                else:
                    best = [(q, s, d) for i, q in enumerate(pack.queries.tolist()) for s, d in shard.best(pack.asked(i), k)]
                    found = [[np.array(c) for c in zip(*best)]] if best else []
                for query, score, key in found:
                    heads = np.flatnonzero(np.diff(query, prepend=query[:1] - 1))
                    ends = pa.array(np.append(heads, len(query)), pa.int32())
                    near = pa.StructArray.from_arrays([pa.array(-score), pa.array(key)], names=["less", "key"])
                    yield pa.record_batch([pa.array(query[heads]), pa.ListArray.from_arrays(ends, near)], names=["query", "near"])

    return run


def search(index: Index, queries: DataFrame, query: str, text: str, k: int = TOP) -> DataFrame:
    """``query, rank, key, score``: the k best texts of every query."""
    words = queries.select(F.col(query).cast("bigint").alias("query"), F.explode(F.array_distinct(tokens(text))).alias("term"))
    asked = words.join(index.known, "term").groupBy("query").agg(F.sort_array(F.collect_set(F.struct("term", "idf"))).alias("terms"))
    asked = materialize(asked, "search_queries")
    blocks = max(-(-asked.count() // QUERIES), 1)
    packs = asked.groupBy(F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("query", "terms")).alias("asked"))
    packs = packs.mapInArrow(_packs, f"asked {_PACK}").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(index.count - 1))))
    # a shard is sent once, not beside each pack
    met = index.shards.unionByName(packs, allowMissingColumns=True)
    met = met.repartition(4 * index.count, "shard").sortWithinPartitions("shard", F.col("asked").isNotNull())
    found = met.mapInArrow(_answers(k, index.average), "query bigint, near array<struct<less: double, key: bigint>>")
    found = found.groupBy("query").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    ranked = found.select("query", F.posexplode("near").alias("at", "best"))
    return ranked.select("query", (F.col("at") + 1).cast("bigint").alias("rank"), "best.key", (-F.col("best.less")).alias("score"))
