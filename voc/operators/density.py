"""Density clusters of vectors: the condensed tree of a minimum spanning forest under mutual reachability.

Every vector is linked to its ``k`` nearest neighbours by cosine distance. The core distance of a vector is that to the
farthest of them; a link weighs the largest of its distance and its ends' core distances. Joining the links of their minimum
spanning forest by weight gives a hierarchy, of which only parts of at least ``least`` members count: a part that grows by
fewer joins no other, and fewer that fall off a shrinking part are just lost to it. Of nested parts those are clusters
that are most stable, summed over their members' reciprocal distances; other vectors are noise, -1.

Where a member's part first has ``least`` members (its birth) is found for all members at once: parts below that size take
their smallest links, both sides at once if it is the smallest of both, and sizes are summed along these links, in rounds that
each cut the number of open parts. Links whose two ends were born before them join two large parts. Only these, at most one for
``least`` members, are collected, up to ``MAX_PARTS`` of them; a larger hierarchy is an error that asks for a larger ``least``.

Rows: vectors without direction or key are noise or left out; equal vectors are at distance 0; a repeated key is one member.
If the hierarchy has one root, the root is no cluster, so a table without two dense parts is all noise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voc.operators.forest import EDGE, looked_up, ordered, spanning_forest
from voc.operators.neighbours import NEIGHBOURS, TUNED, neighbours
from voc.storage import materialize

LEAST, MAX_PARTS, MAX_ROUNDS = 15, 1 << 18, 60
NEAREST = 1e-9          # distances below this count as this in reciprocals
NOISE = -1


def mutual_links(near: DataFrame) -> DataFrame:
    """``u, v, w`` from rows ``key, neighbour, cosine``."""
    away = near.select(F.col("key").alias("u"), F.col("neighbour").alias("v"), F.round(1 - F.col("cosine"), 9).alias("d"))
    away = materialize(away, "distances")
    core = materialize(away.groupBy("u").agg(F.max("d").alias("core")), "core_distances")
    ends = away.withColumn("cu", F.col("u")).withColumn("cv", F.col("v"))
    for side in ("cu", "cv"):
        ends = looked_up(ends, side, core, "u", "core", 4)
    return materialize(ordered(ends.select("u", "v", F.greatest("d", "cu", "cv").alias("w"))), "mutual_links")


def births(forest: DataFrame, least: int = LEAST) -> DataFrame:
    """``node, born``: the link at which the node's part first has ``least`` members, null if it never has."""
    edges = materialize(forest.select(F.struct("w", "u", "v").alias("e"), F.col("u").alias("cu"), F.col("v").alias("cv")), "open_links")
    members = materialize(forest.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("c", F.col("node")), "open_members")
    nodes, done = members.count(), []
    hops = max(least - 1, 1).bit_length()
    for _ in range(MAX_ROUNDS):
        parts = materialize(members.groupBy("c").agg(F.count("*").alias("size")), "parts")
        open_parts = parts.count()
        if not open_parts:
            break
        copies = max(min(nodes // open_parts, 64), 1)
        ends = edges.filter("cu is not null").select(F.col("cu").alias("c"), F.struct("e", F.col("cv").alias("other")).alias("x"))
        ends = ends.unionByName(edges.filter("cv is not null").select(F.col("cv").alias("c"), F.struct("e", F.col("cu").alias("other")).alias("x")))
        best = ends.groupBy("c").agg(F.min("x").alias("x")).select("c", "x.e", "x.other")
        best = materialize(parts.join(best, "c", "left").withColumn("key", F.col("other")), "smallest_links")
        # the other side's smallest link; none if the other side is a large part already
        back = looked_up(best, "key", best, "c", "e", copies).withColumnRenamed("key", "back")
        both, large = F.col("e") == F.col("back"), F.col("e").isNotNull() & F.col("other").isNull()
        sized = looked_up(back.withColumn("there", F.col("other")), "there", parts, "c", "size", copies)
        walk = sized.select(
            "c", "e", "other", "size", F.coalesce(both, F.lit(False)).alias("pair"),
            F.when(large, F.lit(least)).when(both, F.col("size") + F.col("there")).otherwise(F.col("size")).cast("bigint").alias("total"),
            F.when(~F.coalesce(both, F.lit(True)), F.col("other")).alias("next"),
        )
        walk = materialize(walk, "walks")
        for _ in range(hops):   # members along the links of falling weight, up to ``least`` links
            there = materialize(walk.select("c", F.struct("total", "next").alias("ahead")), "ahead")
            step = looked_up(walk.withColumn("ahead", F.col("next")), "ahead", there, "c", "ahead", copies)
            step = step.withColumns({"total": F.col("total") + F.coalesce("ahead.total", F.lit(0)), "next": F.col("ahead.next")})
            walk = materialize(step.select(*walk.columns), "walks")
        born = (F.col("total") >= least) | F.col("e").isNull()
        joined = F.when(born, F.lit(None)).when(F.col("pair"), F.least("c", "other")).otherwise(F.col("c"))
        moved = materialize(walk.select("c", F.struct(born.alias("born"), "e", joined.alias("to")).alias("m")), "moves")
        members = looked_up(members.withColumn("m", F.col("c")), "m", moved, "c", "m", copies)
        members = materialize(members.select("node", "m"), "open_members")
        done.append(members.filter("m.born").select("node", F.col("m.e").alias("born")))
        members = members.filter("not m.born").select("node", F.col("m.to").alias("c"))
        moved = moved.select("c", F.col("m.to").alias("to"))
        for side in ("cu", "cv"):
            edges = looked_up(edges, side, moved, "c", "to", copies)
        edges = materialize(edges.filter("(cu is not null or cv is not null) and not (cu <=> cv)"), "open_links")
    else:
        raise RuntimeError("births did not settle")
    out = forest.sparkSession.createDataFrame([], f"node bigint, born {EDGE}")
    for some in done:
        out = out.unionByName(some)
    return materialize(out, "births")


@dataclass
class Hierarchy:
    """Parts as numbers: the first ones are ``groups``; ``parent`` (-1: none) and the link at which a part joins it."""

    groups: list[int]
    parent: np.ndarray
    joins: np.ndarray      # w, u, v of the link; infinity for a root
    split: np.ndarray      # weight of the link that made the part of two, 0 for a group

    def fallen(self, group: np.ndarray, born: np.ndarray) -> np.ndarray:
        """The smallest part of its group's line that a member still is in when it is born."""
        at = group.copy()
        while True:
            up, late = self.joins[at], np.zeros(len(at), bool)
            equal = np.ones(len(at), bool)
            for i in range(3):   # by weight, then by the ends
                late |= equal & (born[:, i] > up[:, i])
                equal &= born[:, i] == up[:, i]
            late |= equal
            if not late.any():
                return at
            at = np.where(late, self.parent[at], at)


def hierarchy(groups: list[int], joins: list[tuple[float, int, int, int, int]]) -> Hierarchy:
    """From the links ``w, u, v, group of u, group of v`` between groups."""
    number = {g: i for i, g in enumerate(groups)}
    parent, links, split = [-1] * len(groups), [(np.inf, np.inf, np.inf)] * len(groups), [0.0] * len(groups)
    top = list(range(len(groups)))                # union-find over groups
    part = list(range(len(groups)))               # the part a root of the union-find stands for

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for w, u, v, gu, gv in sorted(joins):
        a, b = root(number[gu]), root(number[gv])
        for side in (a, b):
            parent[part[side]], links[part[side]] = len(parent), (w, u, v)
        top[b], part[a] = a, len(parent)
        parent.append(-1)
        links.append((np.inf, np.inf, np.inf))
        split.append(w)
    return Hierarchy(groups, np.array(parent, np.int64), np.array(links, np.float64).reshape(-1, 3), np.array(split))


def chosen(tree: Hierarchy, count: np.ndarray, reciprocals: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The cluster of every part, -1 for noise: count, sum of reciprocal births and smallest key of the members lost in it."""
    n = len(tree.parent)
    begin = 1 / np.maximum(tree.joins[:, 0], NEAREST)
    end = 1 / np.maximum(tree.split, NEAREST)
    below, best, first = np.zeros(n), np.zeros(n), first.copy()
    picked = np.zeros(n, bool)
    single = (tree.parent < 0).sum() == 1
    for x in range(n):                            # parts come after those they are made of
        own = reciprocals[x] - count[x] * begin[x] + below[x] * (end[x] - begin[x] if below[x] else 0.0)
        picked[x] = own >= best[x] and not (single and tree.parent[x] < 0)
        best[x] = max(own, best[x])
        p = tree.parent[x]
        if p >= 0:
            below[p] += below[x] + count[x]
            best[p] += best[x]
            first[p] = min(first[p], first[x])
    cluster = np.full(n, -1, np.int64)
    for x in range(n - 1, -1, -1):                # the outermost picked part holds all that is in it
        p = tree.parent[x]
        cluster[x] = cluster[p] if p >= 0 and cluster[p] >= 0 else (x if picked[x] else -1)
    order = sorted(set(cluster[cluster >= 0].tolist()), key=lambda x: first[x])
    rank = {x: i for i, x in enumerate(order)}
    return np.array([rank.get(x, NOISE) for x in cluster.tolist()], np.int64)


def _bounded(rows: DataFrame) -> list:
    found = rows.limit(MAX_PARTS + 1).collect()
    if len(found) > MAX_PARTS:
        raise ValueError("the hierarchy has too many parts: raise the least number of members")
    return found


def clusters_of_links(links: DataFrame, least: int = LEAST) -> DataFrame:
    """``node, cluster_id`` of every node that has a link."""
    forest, _ = spanning_forest(links)
    born = births(forest, least)
    ends = forest.select(F.struct("w", "u", "v").alias("e"), F.col("u").alias("bu"), F.col("v").alias("bv"))
    for side in ("bu", "bv"):
        ends = looked_up(ends, side, born, "node", "born", 1)
    joint: Column = F.coalesce((F.col("bu") < F.col("e")) & (F.col("bv") < F.col("e")), F.lit(False))
    ends = materialize(ends.select("e.w", "e.u", "e.v", joint.alias("joint")), "joints")
    _, labels = spanning_forest(ends.filter("not joint"))
    members = born.join(labels, "node", "left").select("node", "born", F.coalesce("component", "node").alias("g"))
    members = materialize(members.filter("born is not null"), "members")
    joins = ends.filter("joint").select("w", "u", "v", F.col("u").alias("gu"), F.col("v").alias("gv"))
    for side in ("gu", "gv"):
        joins = looked_up(joins, side, members, "node", "g", 1)
    groups = sorted(r[0] for r in _bounded(members.select("g").distinct()))
    tree = hierarchy(groups, [tuple(r) for r in _bounded(joins)])
    shared = forest.sparkSession.sparkContext.broadcast(tree)   # at most 2 * MAX_PARTS parts

    def fall(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        numbers = np.array(known.groups, np.int64)
        for batch in batches:
            link = batch.column("born")
            born_at = np.stack([link.field(f).to_numpy().astype(np.float64) for f in ("w", "u", "v")], 1)
            part = known.fallen(np.searchsorted(numbers, batch.column("g").to_numpy()), born_at)
            yield pa.record_batch([batch.column("node"), pa.array(1 / np.maximum(born_at[:, 0], NEAREST)), pa.array(part)], names=["node", "near", "part"])

    fallen = materialize(members.mapInArrow(fall, "node bigint, near double, part bigint"), "fallen")
    n = len(tree.parent)
    count, near, first = np.zeros(n), np.zeros(n), np.full(n, np.inf)
    for r in fallen.groupBy("part").agg(F.count("*").alias("n"), F.sum("near").alias("s"), F.min("node").alias("f")).collect():
        count[r.part], near[r.part], first[r.part] = r.n, r.s, r.f
    of_part = forest.sparkSession.sparkContext.broadcast(chosen(tree, count, near, first))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("node"), pa.array(of_part.value[batch.column("part").to_numpy()])], names=["node", "cluster_id"])

    found = fallen.select("node", "part").mapInArrow(label, "node bigint, cluster_id bigint")
    return found.unionByName(born.filter("born is null").select("node", F.lit(NOISE).cast("bigint").alias("cluster_id")))


def density_clusters(vectors: DataFrame, key: str, col: str, k: int = NEIGHBOURS, least: int = LEAST, probes: int | None = TUNED) -> DataFrame:
    """``key, cluster_id`` of every key: clusters numbered by their smallest key, -1 for noise."""
    found = clusters_of_links(mutual_links(neighbours(vectors, key, col, k=k, probes=probes)), least)
    keys = vectors.select(F.col(key).alias("key")).filter("key is not null").distinct()
    rows = keys.join(found.withColumnRenamed("node", "key"), "key", "left")
    return rows.select(F.col("key").alias(key), F.coalesce("cluster_id", F.lit(NOISE)).alias("cluster_id"))
