"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voc.storage import materialize

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges ``u > v``: every neighbour on the step's side is tied to the smallest one around the node."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    tied = both.join(least, "u")
    if large:
        out = tied.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node that has a link; the root is the smallest node reachable.

    Each round is written, so that a lost executor costs one round at most. The star steps need a logarithmic number of
    rounds; ``MAX_ROUNDS`` is a guard that raises rather than returning a partial answer.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = materialize(edges.filter(F.col("u") != F.col("v")).distinct(), "edges")
    state = None
    for _ in range(MAX_ROUNDS):
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint"))).first()
        if now[0] == 0 or now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root"))
            ).distinct()
        state = now
        edges = materialize(_star(_star(edges, True), False), "edges")
    raise RuntimeError("components did not settle")
