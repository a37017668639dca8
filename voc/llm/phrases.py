"""Phrase collocations by marginalising counts of the longest windows.

Every word of a piece begins one window: its word and the ``longest`` - 1 words that lead on from it, padded where the piece
ends. Only these windows are counted; a ROLLUP over their columns sums them to all shorter prefixes, which are the counts of
all shorter phrases, and to the number of words of a language. Shorter phrases are never enumerated.

What is frequent enough has frequent parts, so a window is padded from where its prefix is too rare on. The words are counted
first and become a bit filter of at most ``FILTER_BITS``. Then prefixes are added, by a hash, to arrays of at most ``CELLS``
saturating counters: first the pairs of words the filter lets through, then the longer prefixes of windows whose pairs may be
frequent. The bits of the counters that reach ``least`` go to all tasks. What they let through wrongly is counted and thrown
away by its count, so their sizes bear on the work only: beyond some ``least * CELLS`` words counters rule little out and are
left away.

A candidate is cut in two at each place; the parts' counts give a score, the lowest one holds. Candidates that lie in a longer
one with nearly all their occurrences go. Counts are exact; products are decimals of 38 digits.

Rows: a null ``lang`` counts as ``und``, null and empty texts have no words; repeated rows count as often as they stand; an
empty table gives an empty result. Equal scores are put in order by count, then by the phrase's bytes. Other columns do not
matter, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voc.storage import materialize

LONGEST, LEAST, WITHIN, TOP = 4, 30, 80, 2000
SCALE = 2_000_000
FILTER_BITS, FILTER_HASHES = 1 << 26, 3
CELLS, CHUNK, FULL = 1 << 26, 4096, 255        # counters for prefixes, how many travel together, where they stop
SALTS = 8                 # parts that the candidates of one word are dealt to
WORDS = 1 << 20           # words of texts windowed at once, one text at least
UNKNOWN = "und"
BREAK = b"."
# lower case, and every character that ends a piece as BREAK
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + BREAK * 9)


def words_and_breaks(text: bytes) -> list[bytes]:
    """The words of a text, ``BREAK`` where a piece ends."""
    return text.translate(_TABLE).replace(BREAK, b" . ").split()


class _Numbered:
    """Texts of one language as numbers of words; 0 is a break."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {BREAK: 0}
        self.parts: list[np.ndarray] = []

    def add(self, text: bytes) -> int:
        words, number = words_and_breaks(text), self.number
        self.parts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
        self.parts.append(np.zeros(1, np.int64))
        return len(words)

    def words(self) -> pa.Array:
        return pa.array(list(self.number), pa.binary())

    def numbers(self) -> np.ndarray:
        return np.concatenate(self.parts)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, _Numbered]]:
    """The texts of each language, as many at once as have ``WORDS`` words."""
    of: dict[str, _Numbered] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            if text.is_valid:
                size += of.setdefault(lang, _Numbered()).add(text.as_py())
            if size >= WORDS:
                yield of
                of, size = {}, 0
    if of:
        yield of


def _rows(lang: str, key: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    # bytes that are no UTF-8 cannot come from a string column, so the cast is safe
    return pa.record_batch([pa.array([lang] * len(n), pa.string()), key.cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "key", "n"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for of in _numbered(batches):
        for lang, texts in of.items():
            n = np.bincount(texts.numbers(), minlength=len(texts.number))
            if len(n) > 1:
                yield _rows(lang, texts.words()[1:], n[1:])


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _places(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    """The words' bits in a filter of ``size`` bits, a power of two."""
    step = hashes >> np.uint64(32) | np.uint64(1)
    return [(hashes + np.uint64(i) * step) & np.uint64(size - 1) for i in range(FILTER_HASHES)]


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The hash of a prefix and the word behind it."""
    return first * np.uint64(0x9E3779B97F4A7C15) ^ (second << np.uint64(31) | second >> np.uint64(33)) * np.uint64(0xC2B2AE3D27D4EB4F)


def _cells(hashes: np.ndarray, size: int) -> np.ndarray:
    """The counters of hashed prefixes; ``size`` is a power of two."""
    return hashes >> np.uint64(65 - size.bit_length())


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def frequent_filter(words: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit filter over ``lang, key``, as bytes; about eight bits a word, at most ``bits``."""
    size = 1 << min(max(8 * words.count(), 1 << 10).bit_length(), bits.bit_length() - 1)

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, keys = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            hashes = np.concatenate([_hashes(lang, [word]) for lang, word in zip(langs, keys)] or [np.zeros(0, np.uint64)])
            at = np.unique(np.concatenate(_places(hashes, size))).astype(np.int64)
            yield pa.record_batch([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], names=["cell", "bit"])

    cells = words.select("lang", "key").mapInArrow(positions, "cell bigint, bit bigint").groupBy("cell").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(size // 64, np.int64)
    # at most FILTER_BITS / 64 rows
    for cell, value in cells.toLocalIterator():
        out[cell] = value
    return out.view(np.uint8)


def _word_mask(lang: str, texts: _Numbered, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes, and which of them the filter lets through."""
    hashes = _hashes(lang, list(texts.number))
    good = np.ones(len(hashes), bool)
    for at in _places(hashes, 8 * len(known)):
        good &= _has(known, at)
    good[0] = False
    return hashes, good


def _behind(column: np.ndarray, k: int) -> np.ndarray:
    """What stands k places further on."""
    return np.append(column[k:], np.zeros(min(k, len(column)), column.dtype))


def _leads(lang: str, texts: _Numbered, known: np.ndarray, filters: list[np.ndarray | None], longest: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The columns of all windows, 0 where they are padded, and the hashes of their prefixes.

    ``filters``: for pairs and for longer prefixes; none, or None, lets all through.
    """
    hashes, good = _word_mask(lang, texts, known)
    ids = texts.numbers()
    word = np.where(good[ids], ids, 0)
    own = hashes[word]
    lead, mixed = [word], [own]
    joined = (word > 0) & (_behind(word, 1) > 0)
    if filters and filters[0] is not None:
        at = np.flatnonzero(joined)
        joined[at] = _has(filters[0], _cells(_mixed(own[at], own[at + 1]), 8 * len(filters[0])))
    alive = word > 0
    for k in range(1, longest):
        alive = alive & _behind(joined, k - 1)
        mixed.append(_mixed(mixed[-1], _behind(own, k)))
        if k > 1 and len(filters) > 1 and filters[1] is not None:
            at = np.flatnonzero(alive)
            alive[at] = _has(filters[1], _cells(mixed[-1][at], 8 * len(filters[1])))
        lead.append(np.where(alive, _behind(word, k), 0))
    there = ids > 0
    return [c[there] for c in lead], [m[there] for m in mixed]


def prefix_filter(texts: DataFrame, known, filters: list, sizes: range, longest: int, words: int, least: int, cells: int = CELLS) -> np.ndarray | None:
    """Bits of the counters that reach ``least``, over the prefixes of ``sizes`` words that earlier filters let through.

    None where about ``words`` words would fill all counters.
    """
    size = min(1 << max(words // 4, 1 << 12).bit_length(), cells)
    if words > least * size:
        return None
    reach = min(least, FULL)
    sent = texts.sparkSession.sparkContext.broadcast(filters)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(size, np.uint8)
        for of in _numbered(batches):
            for lang, some in of.items():
                lead, mixed = _leads(lang, some, known.value, sent.value, longest)
                for k in sizes:
                    at, n = np.unique(_cells(mixed[k - 1][lead[k - 1] > 0], size), return_counts=True)
                    counters[at] = np.minimum(counters[at] + n, FULL)
        chunks = counters.reshape(-1, CHUNK)
        for i in np.flatnonzero(chunks.any(axis=1)).tolist():
            yield pa.record_batch([pa.array([i]), pa.array([chunks[i].tobytes()])], names=["chunk", "counters"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                have = sums.setdefault(chunk, np.zeros(CHUNK, np.uint8))
                have += np.minimum(FULL - have, np.frombuffer(data, np.uint8))
        for chunk, have in sums.items():
            yield pa.record_batch([pa.array([chunk]), pa.array([np.packbits(have >= reach, bitorder="little").tobytes()])], names=["chunk", "bits"])

    rows = texts.mapInArrow(counted, "chunk bigint, counters binary").repartition("chunk")
    out = np.zeros((size // CHUNK, CHUNK // 8), np.uint8)
    # at most CELLS / CHUNK rows of CHUNK / 8 bytes
    for chunk, bits in rows.mapInArrow(added, "chunk bigint, bits binary").toLocalIterator():
        out[chunk] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def _windows(longest: int, known, filters):
    """``lang, key, n``: counted windows, the words of one joined by spaces; the empty window stands for rare first words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for of in _numbered(batches):
            for lang, texts in of.items():
                lead, _ = _leads(lang, texts, known.value, filters.value, longest)
                order = np.lexsort(lead)
                lead = [column[order] for column in lead]
                new = np.zeros(len(order), bool)
                new[:1] = True
                for column in lead:
                    new[1:] |= column[1:] != column[:-1]
                first = np.flatnonzero(new)
                names, n = texts.words(), np.diff(np.append(first, len(order)))
                lead = [column[first] for column in lead]
                sizes = sum((column > 0).astype(np.int64) for column in lead)
                for size in np.unique(sizes).tolist():
                    at = sizes == size
                    columns = [pc.take(names, pa.array(column[at])) for column in lead[:size]]
                    key = pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.binary())) if size else pa.array([b""] * int(at.sum()), pa.binary())
                    yield _rows(lang, key, n[at])

    return run


def _wide(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, bits: int = FILTER_BITS, cells: int = CELLS) -> DataFrame:
    """``lang, words, f``: the phrases of up to ``longest`` words with their counts of at least ``least``.

    ``words`` is an array; the empty one has the number of all words of the language.
    """
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    send = docs.sparkSession.sparkContext.broadcast
    totals = texts.mapInArrow(_word_counts, "lang string, key string, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    common = materialize(totals.filter(F.col("n") >= least), "common_words")
    known = send(frequent_filter(common, bits))
    size, filters = common.agg(F.sum("n")).first()[0] or 0, []
    for sizes in (range(2, 3), range(3, longest + 1)):
        filters = [*filters, prefix_filter(texts, known, filters, sizes, longest, size, least, cells)]
    rows = texts.mapInArrow(_windows(longest, known, send(filters)), "lang string, key string, n bigint")
    windows = materialize(rows.groupBy("lang", "key").agg(F.sum("n").alias("n")), "windows")
    split = F.split("key", " ")
    lead = [F.coalesce(F.get(split, F.lit(k)), F.lit("")).alias(f"w{k}") for k in range(longest)]
    windows = windows.select("lang", *lead, "n")
    names = [f"w{k}" for k in range(longest)]
    # the longest phrases are counted already, the rollup sums them to all prefixes
    whole = windows.filter((F.col("n") >= least) & (F.col(names[-1]) != "")).select("lang", F.array(*names).alias("words"), F.col("n").alias("f"))
    sums = windows.rollup("lang", *names[:-1]).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    short = F.greatest(F.lit(longest - 1) - F.bit_count("level"), F.lit(0))   # -1 in the sum over all languages
    sums = sums.filter(F.col("lang").isNotNull()).withColumn("words", F.slice(F.array(*names[:-1]), F.lit(1), short))
    # prefixes that end in padding count ends of pieces, not phrases
    sums = sums.filter(~F.array_contains("words", "") & ((F.col("f") >= least) | (short == 0))).select("lang", "words", "f")
    return materialize(whole.unionByName(sums), "phrase_counts")


def scored(counted: DataFrame, within: int = WITHIN) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of all candidates that no longer one holds."""
    text = lambda words: F.array_join(words, " ")
    length = F.size("words")
    parts = counted.filter(length > 0).select("lang", text("words").alias("part"), F.col("f"))
    salted = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = counted.filter(length > 1).select("lang", "words", text("words").alias("phrase"), F.col("f").alias("a"))
    # a common word begins or ends very many candidates: they meet its count in SALTS places
    cuts = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    cuts = cuts.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", "salt", text(F.slice("words", F.lit(1), F.col("k"))).alias("first"),
        text(F.slice("words", F.col("k") + 1, F.size("words"))).alias("rest"),
    )
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(salted.select("lang", F.col("part").alias(part), "salt", F.col("f").alias(name)), ["lang", part, "salt"])
    score = F.expr(f"cast({SCALE} as decimal(38,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = found.filter(F.size("words") > 2).withColumn("size", F.explode(F.sequence(F.lit(2), F.size("words") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)))
    inner = inner.groupBy("lang", text(F.slice("words", F.col("at"), F.col("size"))).alias("phrase")).agg(F.max("a").alias("longer"))
    held = _wide(F.col("longer")) * 100 >= _wide(F.col("a")) * within
    free = best.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | ~held)
    return free.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))


def phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, within: int = WITHIN, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    counted = counts(docs, longest, least)
    # every partition is cut to its first rows of each language before the shuffle
    ranked = scored(counted, within).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = counted.filter(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL for ``phrases`` over the table ``documents``
PHRASES_SQL = r"""
with pieces as (
    select coalesce(lang, 'und') as lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
), lists as (
    select row_number() over () as piece, lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') as w from pieces
), single as (
    select piece, lang, unnest(w) as w1, generate_subscripts(w, 1) as i from lists
), leads as materialized (
    select lang, w1, lead(w1) over piece_ as w2, lead(w1, 2) over piece_ as w3, lead(w1, 3) over piece_ as w4
    from single window piece_ as (partition by piece order by i)
), grams as materialized (
    select lang, 1 as k, w1 as phrase, count(*) as f from leads group by all
    union all select lang, 2, w1 || ' ' || w2 as phrase, count(*) from leads where w2 is not null group by all
    union all select lang, 3, w1 || ' ' || w2 || ' ' || w3 as phrase, count(*) from leads where w3 is not null group by all
    union all select lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 as phrase, count(*) from leads where w4 is not null group by all
), totals as (
    select lang, sum(f) as n from grams where k = 1 group by lang
), frequent as materialized (
    select *, string_split(phrase, ' ') as words from grams where f >= 30
), candidates as (
    select * from frequent where k > 1
), places_to_cut as materialized (
    select lang, phrase, f as a, p as cut, array_to_string(words[1 : p], ' ') as first_part, array_to_string(words[p + 1 : k], ' ') as rest
    from candidates, range(1, 4) as places(p) where p < k
), cuts as (
    select c.lang, c.phrase, a, cut, l.f as l, r.f as r, (2000000::hugeint * a) // (l.f + r.f) as score
    from places_to_cut c join frequent l on l.lang = c.lang and l.phrase = first_part join frequent r on r.lang = c.lang and r.phrase = rest
), lowest as (
    select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1
), inner_parts as (
    select c.lang, array_to_string(c.words[i : i + s - 1], ' ') as phrase, max(c.f) as longer
    from candidates c, range(2, 4) as sizes(s), range(1, 4) as starts(i)
    where s < c.k and i + s - 1 <= c.k
    group by all
), free as (
    select lowest.* from lowest left join inner_parts using (lang, phrase)
    where longer is null or not (100::hugeint * longer >= 80::hugeint * a)
), ranked as (
    select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, score from free
)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from ranked join totals using (lang) where rank <= 2000
"""
