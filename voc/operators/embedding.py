"""Vectors learnt from the reviews themselves: words that stand in like company get like vectors.

Words near each other are counted over all texts, for the ``VOCABULARY`` most frequent words. Their positive mutual information
is a sparse symmetric matrix whose leading eigenvectors, scaled by the roots of the eigenvalues, are the word vectors.
They come from a block power iteration on blocks of ``BLOCK`` words: every step joins the matrix' blocks with those of the vectors,
adds the products by block, and makes the columns orthonormal by their small Gram matrix. Collected are the Gram matrices and the
vectors of the known words. A text is the sum of
its words' vectors, each weighted by how rare the word is, scaled to length 1.

Rows: texts without known words get a zero vector; an empty table gives an empty result. The start is a hash of the words, so
reruns agree up to the order of sums.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voc.functions.text import kept_tokens
from voc.storage import materialize

VOCABULARY, NEAR, SIZE, STEPS, SEED = 20_000, 4, 64, 12, 42
BLOCK = 512              # words of a block of the matrix
ROWS = 256               # texts worked on at once
HELD = 2 << 20           # different pairs that a task holds


def vocabulary(words: DataFrame, most: int = VOCABULARY) -> DataFrame:
    """``term, n``: the most frequent words of rows with an array ``words``; equal counts in alphabetical order."""
    return words.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(most)


def word_pairs(words: DataFrame, known: DataFrame, near: int = NEAR) -> DataFrame:
    """``a, b, n`` for a < b or a = b: how often two known words stand at most ``near`` words apart.

    Known words are numbered in their order, so a pair is one number and words that are not known make no pairs.
    """
    terms = sorted(r[0] for r in known.filter("term is not null").select("term").collect())   # at most VOCABULARY words
    shared = words.sparkSession.sparkContext.broadcast(terms)
    many = max(len(terms), 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(shared.value, pa.string())
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for number, row in _numbered(batches, values):
            for k in range(1, near + 1):
                a, b = number[:-k], number[k:]
                ok = (row[:-k] == row[k:]) & (a >= 0) & (b >= 0)
                held.append(np.unique(np.minimum(a, b)[ok] * many + np.maximum(a, b)[ok], return_counts=True))
            if sum(len(c) for c, _ in held) > 2 * HELD:
                held = [_added(held)]
                if len(held[0][0]) > HELD:
                    yield pa.record_batch(list(map(pa.array, held.pop())), names=["code", "n"])
        if held:
            yield pa.record_batch(list(map(pa.array, _added(held))), names=["code", "n"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(shared.value, pa.string())
        for batch in batches:
            code = batch.column("code").to_numpy()
            yield pa.record_batch([values.take(pa.array(code // many)), values.take(pa.array(code % many)), batch.column("n")], names=["a", "b", "n"])

    rows = words.select("words").mapInArrow(count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    return rows.mapInArrow(named, "a string, b string, n bigint")


def _numbered(batches: Iterable[pa.RecordBatch], values: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The words of some rows as their places in ``values``, -1 if not there, and the row each is in."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            words = batch.column("words").slice(at, ROWS)
            sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
            number = pc.fill_null(pc.index_in(words.flatten(), value_set=values), -1).to_numpy().astype(np.int64)
            yield number, np.repeat(np.arange(len(sizes)), sizes)


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the same numbers added up."""
    codes, counts = (np.concatenate(x).astype(np.int64) for x in zip(*held))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.diff(codes, prepend=codes[:1] - 1))
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def information(pairs: DataFrame) -> DataFrame:
    """``a, b, w``: the positive mutual information of both orders of each pair, ln(n(a,b) n / (n(a) n(b)))."""
    pairs = materialize(pairs.select("a", "b", "n"), "word_pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n").filter("a <> b"))
    of_word = materialize(both.groupBy("a").agg(F.sum("n").alias("n")).select(F.col("a").alias("term"), F.col("n").cast("double").alias("n")), "pair_words")
    total = of_word.agg(F.sum("n")).scalar()
    rows = pairs
    for side in ("a", "b"):   # at most VOCABULARY words
        rows = rows.join(F.broadcast(of_word.select(F.col("term").alias(side), F.col("n").alias(f"n{side}"))), side)
    w = F.log(F.col("n") * total / (F.col("na") * F.col("nb")))
    rows = rows.select("a", "b", w.alias("w")).filter("w > 0")
    return rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b"), "w").filter("a <> b"))


def _packed(matrix: DataFrame, places: DataFrame) -> DataFrame:
    """``a, b, i, j, w``: the matrix in blocks of ``BLOCK`` words by ``BLOCK`` words, rows and columns within them in order of rows."""
    rows = matrix
    for side, block, place in (("a", "ba", "i"), ("b", "bb", "j")):   # at most VOCABULARY words
        rows = rows.join(F.broadcast(places.select(F.col("term").alias(side), F.col("block").alias(block), F.col("place").alias(place))), side)
    entries = F.sort_array(F.collect_list(F.struct("i", "j", "w"))).alias("x")
    return rows.groupBy("ba", "bb").agg(entries).select(F.col("ba").alias("a"), F.col("bb").alias("b"), "x.i", "x.j", "x.w")


def _product(turn: np.ndarray, sizes: dict[int, int]):
    """``block, x``: blocks of the matrix times the turned vectors of their columns' words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                block = batch.column("a")[n].as_py()
                i, j, w, v = (batch.column(c)[n].values.to_numpy() for c in ("i", "j", "w", "v"))
                v = v.reshape(-1, turn.shape[0]) @ turn
                x = np.zeros((sizes[block], turn.shape[1]))
                for at in range(0, len(i), 1 << 15):
                    some = slice(at, at + (1 << 15))
                    first = np.flatnonzero(np.diff(i[some], prepend=-1))
                    x[i[some][first]] += np.add.reduceat(v[j[some]] * w[some, None], first)
                yield pa.record_batch([pa.array([block], pa.int32()), pa.array([x.ravel()], pa.list_(pa.float64()))], names=["block", "x"])

    return run


def _gram(rows: DataFrame, size: int, turn: np.ndarray | None = None) -> np.ndarray:
    """The product of the transposed vectors ``v`` with themselves, or of the turned ones with ``x``: size x size numbers a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                v = batch.column("v")[n].values.to_numpy().reshape(-1, size)
                other = v if turn is None else batch.column("x")[n].values.to_numpy().reshape(len(v), -1)
                yield pa.record_batch([pa.array([((v if turn is None else v @ turn).T @ other).ravel()], pa.list_(pa.float64()))], names=["g"])

    sums = rows.mapInArrow(run, "g array<double>").select(Summarizer.sum(array_to_vector("g")).alias("g")).first()["g"].toArray()
    return sums.reshape(int(len(sums) ** 0.5), -1)


def _times(v: Column, matrix: np.ndarray) -> Column:
    """A row vector times a small matrix."""
    columns = F.array(*[F.array(*map(F.lit, map(float, c))) for c in matrix.T])
    return F.transform(columns, lambda c: F.aggregate(F.zip_with(v, c, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def eigenvectors(matrix: DataFrame, size: int = SIZE, steps: int = STEPS) -> tuple[DataFrame, np.ndarray]:
    """``term, v`` of the leading ``size`` eigenvectors of the symmetric matrix ``a, b, w``, and their eigenvalues."""
    start = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.pmod(F.xxhash64("term", i + SEED), F.lit(2_000_003)) / 1_000_001.5 - 1.0,
    )
    terms = materialize(matrix.select(F.col("a").alias("term")).distinct(), "matrix_words")
    many = terms.count()
    if not many:
        return terms.select("term", start.alias("v")), np.zeros(0)
    block = F.pmod(F.xxhash64("term"), F.lit(-(-many // BLOCK))).cast("int")
    place = (F.row_number().over(Window.partitionBy("block").orderBy("term")) - 1).alias("place")
    places = materialize(terms.withColumn("block", block).select("term", "block", place), "matrix_places")
    sizes = {r[0]: r[1] for r in places.groupBy("block").count().collect()}   # one number a block
    packed = materialize(_packed(matrix, places), "matrix_blocks")
    flat = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("place", start.alias("v")))), lambda x: x["v"]))
    now = materialize(places.groupBy("block").agg(flat.alias("v")), "vectors")
    for step in range(steps + 1):
        gram = _gram(now, size)
        # columns of no length left are not in the matrix' range
        spread, turn = np.linalg.eigh(gram)
        keep = spread > max(spread.max(initial=0), 1e-300) * 1e-20
        turn = turn[:, keep] / np.sqrt(spread[keep])
        parts = packed.join(now.withColumnRenamed("block", "b"), "b").select("a", "i", "j", "w", "v").mapInArrow(_product(turn, sizes), "block int, x array<double>")
        moved = parts.groupBy("block").agg(vector_to_array(Summarizer.sum(array_to_vector("x"))).alias("x"))
        moved = materialize(moved, "moved_vectors")
        if step < steps:
            now, size = moved.select("block", F.col("x").alias("v")), turn.shape[1]
            continue
        # the matrix within the found space, turned to its own directions
        inside = _gram(now.join(moved, "block"), size, turn)
        values, own = np.linalg.eigh((inside + inside.T) / 2)
        order = np.argsort(-np.abs(values), kind="stable")
        of_word = F.slice("v", F.col("place") * size + 1, F.lit(size))
        rows = places.join(now, "block").select("term", of_word.alias("v"))
        return rows.select("term", _times(F.col("v"), turn @ own[:, order]).alias("v")), values[order]
    raise AssertionError


def word_vectors(matrix: DataFrame, size: int = SIZE, steps: int = STEPS) -> DataFrame:
    """``term, vector``: eigenvectors scaled by the roots of their eigenvalues' sizes."""
    vectors, values = eigenvectors(matrix, size, steps)
    if not len(values):
        return vectors.select("term", F.col("v").alias("vector"))
    roots = np.diag(np.sqrt(np.abs(values)))
    # a matrix of lower rank has fewer directions
    rest = F.array_repeat(F.lit(0.0), size - len(values))
    return vectors.select("term", F.concat(_times(F.col("v"), roots), rest).alias("vector"))


def learnt_vectors(df: DataFrame, stop_words: Iterable[str], size: int = SIZE, key: str = "ord", text: str = "cleaned_text") -> DataFrame:
    """``key, vector ARRAY<FLOAT>``: texts by the vectors of their words."""
    words = materialize(df.select(key, kept_tokens(text, stop_words).alias("words")), "embedding_words")
    known = materialize(vocabulary(words), "vocabulary")
    vectors = word_vectors(materialize(information(word_pairs(words, known)), "information"), size)
    vectors = materialize(vectors.join(known, "term"), "word_vectors")
    total = known.agg(F.sum("n")).scalar()
    rare = vectors.withColumn("weight", F.log(1 + total / F.col("n")))
    rare = rare.select("term", F.transform("vector", lambda x: x * F.col("weight")).alias("vector")).toArrow()   # at most VOCABULARY words
    shared = df.sparkSession.sparkContext.broadcast(rare)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = shared.value.column("term").combine_chunks().cast(pa.string())
        weighted = shared.value.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, size)
        for batch in batches:
            sums, rows = [], []
            for at, (number, row) in zip(range(0, batch.num_rows, ROWS), _numbered([batch], values)):
                ok = number >= 0
                number, row = number[ok], row[ok]
                first = np.flatnonzero(np.diff(row, prepend=-1))
                rows += (at + row[first]).tolist()
                sums += [weighted[some].sum(axis=0) for some in np.split(number, first[1:])] if len(first) else []
            yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sums, pa.list_(pa.float64()))], names=[key, "x"])

    kind = words.schema[key].dataType.simpleString()
    found = words.mapInArrow(added, f"{key} {kind}, x array<double>").groupBy(key).agg(vector_to_array(Summarizer.sum(array_to_vector("x"))).alias("x"))
    found = found.withColumn("length", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x)))
    unit = F.transform("x", lambda x: F.when(F.col("length") > 0, x / F.col("length")).otherwise(0.0).cast("float"))
    nothing = F.array_repeat(F.lit(0.0).cast("float"), size)
    return words.select(key).join(found.select(key, unit.alias("vector")), key, "left").select(key, F.coalesce("vector", nothing).alias("vector"))
