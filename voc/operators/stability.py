"""How far the clusters' shares, scores and ranks would move on another sample of reviews.

Poisson bootstrap: in each replicate a row counts as often as a Poisson number of mean 1 says, which is made from a hash of its
``ord`` and the replicate's number. All replicates are summed in one pass over the rows, and a rerun gives the same numbers. An
interval's ends are the replicates' values at ``TAIL`` from either end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voc.functions.scores import prevalence, share

REPLICATES, TAIL = 200, 0.025
ROWS = 2048              # worked on at once
PRIME = 2**31 - 1
# a hash below the k-th bound is a number of at most k
BOUNDS = [math.floor(PRIME * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(10)]


def _squared(x: Column, more: Column) -> Column:
    # the value is built once
    return F.transform(F.array(x), lambda v: (v * v + more) % PRIME)[0]


def copies(ord_: Column, replicate: Column) -> Column:
    """The Poisson number of a row in a replicate; products stay below 2^62."""
    x = (F.pmod(ord_, F.lit(PRIME)) * (replicate * 7919 + 104729) + replicate) % PRIME
    for more in (replicate * 12289 + 1, F.lit(24593), F.lit(49157)):
        x = _squared(x, more)
    return F.aggregate(F.array(*map(F.lit, BOUNDS)), F.lit(0), lambda n, b: n + (x >= b).cast("int"))


def copies_of(ords: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """The numbers of ``copies`` of many rows in many replicates at once, one row each."""
    r = replicates.astype(np.int64)
    x = (np.mod(ords, PRIME)[:, None] * (r * 7919 + 104729) + r) % PRIME
    for more in (r * 12289 + 1, 24593, 49157):
        x = (x * x + more) % PRIME
    return np.searchsorted(BOUNDS, x, side="right")


def _drawn(replicates: int):
    """``sub_domain, source, r, w, n`` of a task's rows: the sums of their copies and how many rows there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[tuple, int] = {}
        sums, sizes, valid = (np.zeros((0, *shape), np.int64) for shape in ((replicates,), (), ()))
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                names = zip(batch.column("sub_domain").to_pylist(), batch.column("source").to_pylist())
                group = np.array([number.setdefault(g, len(number)) for g in names], np.int64)
                more = len(number) - len(sizes)
                sums = np.concatenate([sums, np.zeros((more, replicates), np.int64)])
                sizes, valid = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (sizes, valid))
                ords = batch.column("ord")
                known = ords.is_valid().to_numpy(zero_copy_only=False)
                sizes += np.bincount(group, minlength=len(number))
                group = group[known]
                valid += np.bincount(group, minlength=len(number))
                drawn = copies_of(ords.drop_null().to_numpy(), np.arange(replicates))
                member = (np.arange(len(number))[:, None] == group).astype(np.float64)
                sums += (member @ drawn).astype(np.int64)   # whole numbers below 2^53
        for (domain, source), i in number.items():
            w = pa.array(sums[i]) if valid[i] else pa.nulls(replicates, pa.int64())
            some = [pa.array([x] * replicates, pa.string()) for x in (domain, source)]
            yield pa.record_batch([*some, pa.array(np.arange(replicates)), w, pa.array(np.full(replicates, sizes[i]))], names=["sub_domain", "source", "r", "w", "n"])

    return run


def intervals(classified: DataFrame, replicates: int = REPLICATES) -> DataFrame:
    """``sub_domain, n, share, rank`` and the intervals of share, prevalence score and rank, one row per cluster."""
    at = max(math.floor(TAIL * replicates), 0) + 1
    rows = classified.select("sub_domain", "source", F.col("ord").cast("bigint").alias("ord"))
    drawn = rows.mapInArrow(_drawn(replicates), "sub_domain string, source string, r bigint, w bigint, n bigint")
    sums = drawn.groupBy("sub_domain", "source", "r").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
    # at most one row per domain and replicate from here on
    sums = sums.groupBy("sub_domain", "r").agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.count_if(F.col("w") > 0).alias("n_sources"))
    of_all = Window.partitionBy("r")
    drawn = sums.withColumns({
        "total": F.sum("w").over(of_all), "all": F.sum("n").over(of_all), "rank": F.rank().over(of_all.orderBy(F.desc("n"))),
        "drawn_rank": F.rank().over(of_all.orderBy(F.desc("w"))),
    })
    drawn = drawn.withColumns({
        "drawn_share": F.round(share(F.col("w"), F.col("total")), 6), "drawn_score": prevalence(F.col("w"), F.col("total"), F.greatest("n_sources", F.lit(1))),
    })
    values = {name: F.sort_array(F.collect_list(f"drawn_{name}")) for name in ("share", "score", "rank")}
    out = drawn.groupBy("sub_domain").agg(
        F.first("n").alias("n"), F.round(F.first(share(F.col("n"), F.col("all"))), 6).alias("share"), F.first("rank").alias("rank"),
        *[F.element_at(v, at).alias(f"{name}_low") for name, v in values.items()],
        *[F.element_at(v, -at).alias(f"{name}_high") for name, v in values.items()],
    )
    return out
