"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Every document may be taken 0, 1 or 2 times; untilted, the number of copies has the binomial law with mean 1. Among all laws
whose expected tokens meet each source's target, the one of least relative entropy tilts this law exponentially in the
document's tokens, which makes its rate ``2 / (1 + exp(-l x))`` with x the tokens in units of the source's mean. The l of all
sources solve the convex dual; its Newton steps are aggregates over (source, size) counts, all sources at once. Started
at 0 each step stays on the near side of the root, so that no step has to be cut. A target at the bound (twice the size)
gives rate 2, a target of 0 gives rate 0.

Rounding: the documents of one source and size are alike, so a whole number of copies is dealt to each such cell. The cells'
running sum of expected copies, from the largest size down, is rounded, and what is left of the target is then handed to
cells whose size fits, in a few passes from large to small. Within a cell, copies go to documents in the order of a hash
of id and text: all get the floor, the first ones one more.

Rows: a null source is a source of its own, after all others; null, empty and wordless texts have size 0 and cost nothing;
repeated rows are documents of their own (their tie is broken arbitrarily, which changes no sum); an empty table gives an
empty result. Names starting with ``_`` are taken by this module.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voc.llm.columns import shielded
from voc.storage import materialize

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, COPIES = 1.5, 2
SPACE = " \t\n\x0b\x0c\r"      # fixed value: the characters that separate words
STEPS, STEPS_A_JOB, SETTLED = 60, 3, 1e-9
PASSES = 12
BUCKETS = 64                   # parts a cell is ranked in


def n_words(text: Column) -> Column:
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, f"[{SPACE}]+"))).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """``_source, source_size, target``: one row per source, from rows ``_source, source_size``.

    The common level L solves sum(min(2 size, weight L)) = share * sum(size); sources are passed in the order in which they
    reach their bound.
    """
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    every, so_far = Window.partitionBy(), Window.orderBy("_full", F.col("_source").asc_nulls_last())
    before = so_far.rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.withColumn("_w", F.get(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    rows = rows.withColumns({"_cap": COPIES * F.col("source_size").cast("double")}).withColumn("_full", F.col("_cap") / F.col("_w"))
    rows = rows.withColumns({
        "_all": share * F.sum("source_size").over(every), "_w_all": F.sum("_w").over(every),
        "_capped": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), "_w_gone": F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
    })
    # the level if the sources before this one stop at their bound: it rises up to the last source that does, then falls
    rows = rows.withColumn("_level", (F.col("_all") - F.col("_capped")) / (F.col("_w_all") - F.col("_w_gone")))
    rows = rows.withColumn("_l", F.max("_level").over(every))
    return rows.select("_source", "source_size", F.least("_cap", F.col("_w") * F.col("_l")).alias("target"))


def _rate(l: Column, x: Column) -> Column:
    return COPIES / (1 + F.exp(-l * x))


def _mean() -> Column:
    """Mean size of the source's documents that have words, on rows of cells."""
    return F.col("source_size") / F.sum(F.when(F.col("size") > 0, F.col("n"))).over(Window.partitionBy("_source"))


def tilts(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """``_source, _l``: the dual's solution per source; cells are rows ``_source, size, n``.

    Sources with target 0 or at the bound have no finite solution and get a null.
    """
    inner = (F.col("target") > 0) & (F.col("target") < COPIES * F.col("source_size"))
    rows = cells.join(wanted, F.col("_source").eqNullSafe(F.col("_s")), "inner").filter(inner & (F.col("size") > 0))
    rows = materialize(rows.withColumn("_x", F.col("size") / _mean()).select("_source", "size", "n", "_x", "target", "source_size"), "cells")
    now = rows.groupBy("_source").agg(F.lit(0.0).alias("_l"))
    for _ in range(0, STEPS, STEPS_A_JOB):
        for _ in range(STEPS_A_JOB):
            at = rows.join(now.withColumnRenamed("_source", "_k"), F.col("_source").eqNullSafe(F.col("_k")))
            r = _rate(F.col("_l"), F.col("_x"))
            at = at.groupBy("_source").agg(
                F.first("_l").alias("_l"), F.first("target").alias("_t"),
                F.sum(F.col("n") * F.col("size") * r).alias("_g"),
                F.sum(F.col("n") * F.col("size") * F.col("_x") * r * (1 - r / COPIES)).alias("_h"),
            )
            step = F.when(F.col("_h") > 0, (F.col("_t") - F.col("_g")) / F.col("_h")).otherwise(F.lit(0.0))
            now = at.select("_source", (F.col("_l") + step).alias("_l"), (F.abs(F.col("_t") - F.col("_g")) / F.col("_t")).alias("_off"))
        now = materialize(now, "tilts")
        off = now.agg(F.max("_off")).first()[0]
        if off is None or off < SETTLED:
            break
        now = now.drop("_off")
    return now.select("_source", "_l")


def dealt(cells: DataFrame) -> DataFrame:
    """``_copies`` per cell: whole copies for the expected ones ``_want``, near ``target`` in every source.

    The number of cells of a source is bounded by the number of different sizes in it.
    """
    by = Window.partitionBy("_source").orderBy(F.desc("size"))
    upto, before = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_want").over(upto)
    rows = cells.withColumn("_most", COPIES * F.col("n"))
    rows = rows.withColumn("_sum", F.round(total, 6)).withColumn(
        "_copies", (F.floor(F.col("_sum") + 0.5) - F.floor(F.coalesce(F.lag("_sum").over(by), F.lit(0.0)) + 0.5))
    )
    rows = rows.withColumn("_copies", F.greatest(F.lit(0), F.least("_copies", "_most")).cast("bigint")).drop("_sum")
    every = Window.partitionBy("_source")
    for _ in range(PASSES):
        left = F.col("target") - F.sum(F.col("_copies") * F.col("size")).over(every)
        rows = rows.withColumn("_left", left)
        size = F.greatest("size", F.lit(1))
        room = F.when(F.col("_left") > 0, F.col("_most") - F.col("_copies")).otherwise(F.col("_copies"))
        fits = F.least(room, F.floor(F.abs("_left") / size).cast("bigint"))
        rows = rows.withColumn("_fits", F.when(F.col("size") > 0, fits).otherwise(0))
        taken = F.coalesce(F.sum(F.col("_fits") * F.col("size")).over(before), F.lit(0))
        rows = rows.withColumn("_rest", F.abs("_left") - taken)
        move = F.when(F.col("_rest") <= 0, 0).otherwise(F.least("_fits", F.floor(F.col("_rest") / size).cast("bigint")))
        rows = rows.withColumn("_copies", F.col("_copies") + F.when(F.col("_left") > 0, move).otherwise(-move)).drop("_left", "_fits", "_rest")
    return rows


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """The documents with ``size, source_size, target, rate, copies``."""
    sized = docs.withColumns({
        "_source": F.col("source"), "_size": n_words(F.col("text")), "_hash": F.xxhash64("doc_id", "text"),
    }).withColumn("_bucket", F.pmod("_hash", F.lit(BUCKETS)))
    narrow = sized.select("_source", F.col("_size").alias("size"), "_bucket", "_hash")
    narrow = materialize(narrow.groupBy("_source", "size", "_bucket", "_hash").agg(F.count("*").alias("n")), "sizes")
    parts = materialize(narrow.groupBy("_source", "size", "_bucket").agg(F.sum("n").alias("n")), "buckets")
    cells = parts.groupBy("_source", "size").agg(F.sum("n").alias("n"))
    totals = cells.groupBy("_source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    wanted = materialize(targets(totals, weights, share), "targets").withColumnRenamed("_source", "_s")
    solved = tilts(cells, wanted).withColumnRenamed("_source", "_k")
    rows = cells.join(wanted, F.col("_source").eqNullSafe(F.col("_s"))).join(solved, F.col("_source").eqNullSafe(F.col("_k")), "left")
    bound = F.when(F.col("target") >= COPIES * F.col("source_size"), float(COPIES)).when(F.col("target") <= 0, 0.0)
    tilted = F.round(_rate(F.col("_l"), F.col("size") / _mean()), 9)  # sums differ in the last bits between runs
    rate = F.when(F.col("size") == 0, 1.0).otherwise(F.coalesce(bound, tilted))
    rows = rows.withColumn("rate", rate).withColumn("_want", F.col("rate") * F.col("n"))
    rows = materialize(dealt(rows.select("_source", "size", "n", "source_size", "target", "rate", "_want")), "dealt")

    # places inside a cell: whole buckets first, then a rank within the bucket
    ahead = Window.partitionBy("_source", "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("_start", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    starts = starts.alias("a").join(rows.alias("b"), [F.col("a._source").eqNullSafe(F.col("b._source")), F.col("a.size") == F.col("b.size")])
    starts = starts.select("a._source", "a.size", "_bucket", "_start", "n", "_copies", "source_size", "target", "rate")
    starts = starts.select(
        F.col("_source").alias("_s"), F.col("size").alias("_z"), F.col("_bucket").alias("_b"), "source_size", "target", "rate",
        F.floor(F.col("_copies") / F.col("n")).cast("int").alias("_floor"),
        (F.col("_copies") % F.col("n") - F.col("_start")).alias("_more"),
    )
    rank = F.row_number().over(Window.partitionBy("_source", "_size", "_bucket").orderBy("_hash"))
    ranked = sized.withColumn("_rank", rank)
    out = ranked.join(
        starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z")) & (F.col("_bucket") == F.col("_b"))
    )
    copies = F.col("_floor") + F.when(F.col("_rank") <= F.col("_more"), 1).otherwise(0)
    return out.select(*[out[c] for c in docs.columns], F.col("_size").alias("size"), "source_size", "target", "rate", copies.alias("copies"))


def mixture(docs: DataFrame) -> DataFrame:
    """Every document as often as the mix takes it, with the columns it came with."""
    rows, _, back = shielded(docs, "doc_id", "text", "source")
    out = mixed(rows).filter(F.col("copies") > 0)
    return back(out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))))
