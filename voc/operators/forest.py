"""Minimum spanning forests of weighted links by Boruvka rounds.

Each round every component takes its smallest link to another one, components hook along them, and pointers are halved until
all point to a root; at least half of the components go. Links between the same two components are then cut to the smallest.
Links are ordered by weight, then by their ends, so the forest is unique. Every round is written, so a lost executor costs
one round. Labels are looked up in as many copies of the shrinking table of components as keep it at the first table's size,
so that the links of one large component are dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voc.storage import materialize

MAX_COPIES, MAX_ROUNDS = 64, 60
EDGE = "struct<w: double, u: bigint, v: bigint>"


def ordered(links: DataFrame) -> DataFrame:
    """``u, v, w`` with u < v, each pair once with its smallest weight."""
    rows = links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.col("w").cast("double").alias("w"))
    return rows.filter("u <> v").groupBy("u", "v").agg(F.min("w").alias("w"))


def looked_up(rows: DataFrame, column: str, table: DataFrame, key: str, value: str, copies: int) -> DataFrame:
    """``rows`` with ``column`` replaced by the table's value, null where it has none; the table stands ``copies`` times."""
    names = rows.columns
    spread = table.select(F.col(key).alias("_key"), F.col(value).alias("_value"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_copy"))
    dealt = rows.withColumn("_copy", F.pmod(F.xxhash64(*names), F.lit(copies)).cast("int"))
    joined = dealt.join(spread, (F.col(column) == F.col("_key")) & (dealt["_copy"] == spread["_copy"]), "left")
    return joined.select(*[F.col("_value").alias(n) if n == column else F.col(n) for n in names])


def _roots(pointers: DataFrame) -> DataFrame:
    """``c, p``: every component with the root its pointers lead to."""
    for _ in range(MAX_ROUNDS):
        step = pointers.select(F.col("c").alias("p"), F.col("p").alias("q"))
        twice = pointers.join(step, "p").select("c", "p", F.col("q"))
        pointers = materialize(twice.select("c", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")), "pointers")
        if pointers.filter("moved").isEmpty():
            return pointers.select("c", "p")
        pointers = pointers.select("c", "p")
    raise RuntimeError("pointers did not settle")


def spanning_forest(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The forest's links ``u, v, w``, and ``node, component`` of every node that has a link."""
    live = materialize(ordered(links).select("u", "v", "w", F.col("u").alias("cu"), F.col("v").alias("cv")), "live_links")
    labels = materialize(live.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    nodes, taken = labels.count(), []
    for _ in range(MAX_ROUNDS):
        if live.isEmpty():
            break
        edge = F.struct("w", "u", "v")
        ends = live.select(F.col("cu").alias("c"), F.struct(edge.alias("e"), F.col("cv").alias("other")).alias("x"))
        ends = ends.unionByName(live.select(F.col("cv").alias("c"), F.struct(edge.alias("e"), F.col("cu").alias("other")).alias("x")))
        best = materialize(ends.groupBy("c").agg(F.min("x").alias("x")).select("c", "x.e", "x.other"), "smallest_links")
        taken.append(best.select("e").distinct())
        back = best.select(F.col("c").alias("other"), F.col("e").alias("back"))
        root = (F.col("e") == F.col("back")) & (F.col("c") < F.col("other"))
        roots = _roots(best.join(back, "other").select("c", F.when(root, F.col("c")).otherwise(F.col("other")).alias("p")))
        copies = max(min(nodes // max(roots.count(), 1), MAX_COPIES), 1)
        labels = labels.withColumn("old", F.col("component"))
        labels = looked_up(labels, "component", roots, "c", "p", copies).select("node", F.coalesce("component", "old").alias("component"))
        labels = materialize(labels, "labels")
        for side in ("cu", "cv"):
            live = looked_up(live, side, roots, "c", "p", copies)
        pair = (F.least("cu", "cv").alias("cu"), F.greatest("cu", "cv").alias("cv"))
        live = live.filter("cu <> cv").groupBy(*pair).agg(F.min(edge).alias("e")).select("e.u", "e.v", "e.w", "cu", "cv")
        live = materialize(live, "live_links")
    else:
        raise RuntimeError("the forest did not settle")
    forest = taken[0] if taken else live.select(F.struct("w", "u", "v").alias("e"))
    for more in taken[1:]:
        forest = forest.unionByName(more)
    return materialize(forest.select("e.u", "e.v", "e.w"), "forest"), labels
