"""The most frequent terms of each group, exact, without shuffling all different terms.

A first pass keeps at most ``width`` counters a group in every task (Misra-Gries: when there are more, the largest of those to
go is taken off all, and added to the group's error). Added up, a counter is a lower bound of its term's count and the error is how
much it may lack. A term whose bound and error together miss the k-th lower bound cannot be among the first k; the others are
counted exactly in a second pass. Terms without a counter are known to be out if the error itself is below the k-th lower bound.
Where that fails for a group the sketch is repeated with more counters, and beyond ``WIDEST`` all terms are counted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voc.operators.clusters import first_k
from voc.storage import materialize

WIDTH, WIDER, WIDEST = 2048, 8, 1 << 17


class Sketch:
    """Counters of one group in one task."""

    def __init__(self, width: int):
        self.width, self.counts, self.error = width, Counter(), 0

    def add(self, terms: list[str]) -> None:
        self.counts.update(terms)
        if len(self.counts) > 4 * self.width:
            self.cut()

    def cut(self) -> None:
        if len(self.counts) > self.width:
            off = sorted(self.counts.values(), reverse=True)[self.width]
            self.counts = Counter({t: n - off for t, n in self.counts.items() if n > off})
            self.error += off


def sketches(rows: DataFrame, width: int) -> DataFrame:
    """``group, term, n`` of every task from rows ``group, terms``; the error of a task's group has a null term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, Sketch] = {}
        for batch in batches:
            for group, terms in zip(batch.column(0).to_pylist(), batch.column(1)):
                if terms.is_valid:
                    held.setdefault(group, Sketch(width)).add(terms.as_py())
        for group, sketch in held.items():
            sketch.cut()
            found = [*sketch.counts.items(), (None, sketch.error)]
            terms, counts = zip(*found)
            yield pa.record_batch([pa.array([group] * len(found), pa.string()), pa.array(terms, pa.string()), pa.array(counts, pa.int64())], names=["group", "term", "n"])

    return rows.mapInArrow(run, "group string, term string, n bigint")


def candidates(rows: DataFrame, k: int, width: int) -> tuple[DataFrame, bool]:
    """``group, term`` of all terms that may be among the first k, and whether that is certain."""
    sums = materialize(sketches(rows, width).groupBy("group", "term").agg(F.sum("n").alias("n")), "term_sketch")
    errors = sums.filter("term is null").select("group", F.col("n").alias("error"))
    low = first_k(sums.filter("term is not null"), "group", k, F.desc("n"), "term").filter(F.col("place") == k)
    bounds = errors.join(low.select(F.col("group").alias("g"), F.col("n").alias("least")), F.col("group").eqNullSafe(F.col("g")), "left")
    bounds = bounds.select(F.col("group").alias("of"), "error", "least")
    sure = bounds.filter("error > 0 and (least is null or error >= least)").isEmpty()
    open_ = F.col("least").isNull() | (F.col("n") + F.col("error") >= F.col("least"))
    kept = sums.filter("term is not null").join(F.broadcast(bounds), F.col("group").eqNullSafe(F.col("of")))   # one row per group
    return kept.filter(open_).select("group", "term"), sure


def top_terms(rows: DataFrame, k: int, width: int = WIDTH) -> DataFrame:
    """``group, term, n, place`` of the k most frequent terms of each group; equal counts in alphabetical order."""
    words = rows.select("group", F.explode("terms").alias("term"))
    while width <= WIDEST:
        some, sure = candidates(rows, k, width)
        if sure:
            some = some.select(F.col("group").alias("g"), F.col("term").alias("t"))
            words = words.join(some, F.col("group").eqNullSafe(F.col("g")) & (F.col("term") == F.col("t")), "left_semi")
            break
        width *= WIDER
    counts = words.groupBy("group", "term").agg(F.count("*").alias("n"))
    return first_k(counts, "group", k, F.desc("n"), "term")
