"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through BK-trees within a radius.

Two fingerprints within ``RADIUS`` = 4 bits agree on at least two of six blocks of their bits, so every pair meets in at
least one of the 15 shards ``(two blocks, their values)``. Each shard builds a BK-tree (children keyed by their Hamming
distance to the parent) and its members follow only the edges within the radius. All small trees of a partition are built
and searched together, level by level, in numpy. A shard above ``SHARD_ROWS`` members is cut into trees of about that size
and each tree is sent to every block of queries of the shard. A shard emits a spanning forest, not its pairs.

Rows: null and empty texts have no words and get fingerprint zero, linked like any other; a null ``doc_id`` takes part in
links but is never the smallest id; repeated rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate, combinations
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voc.llm.columns import shielded
from voc.llm.components import components
from voc.storage import materialize

SHINGLE, RADIUS, SEED = 4, 4, 42
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))  # (first bit, bits)
SHARD_ROWS = 20_000
PAIRS = 1 << 21      # bound on the nodes that the queries searched at once can meet
HASHES = 1 << 16     # counted at once


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """The fingerprint of one UTF-8 text as an unsigned number."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < size:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - size + 1
    for low in range(0, n, HASHES):
        part = starts[low : low + HASHES + size]
        hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(part, part[size:])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, text_hash, fp``: the fingerprint's bits as a signed BIGINT, beside a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py(), size) for t in texts), np.uint64, len(texts))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, fp bigint")


class Forest:
    """BK-trees over ``fp``; rows of one ``group`` (sorted) with ``is_tree`` form one tree."""

    def __init__(self, group: np.ndarray, fp: np.ndarray, is_tree: np.ndarray):
        self.fp = fp
        members = np.flatnonzero(is_tree)
        first = np.ones(len(members), bool)
        first[1:] = group[members][1:] != group[members][:-1]
        self.groups, self.roots = group[members[first]], members[first]
        parent = np.repeat(self.roots, np.diff(np.append(np.flatnonzero(first), len(members))))
        items, parent, links = members[~first], parent[~first], []
        while len(items):
            # all items that reach a node arrive together: the first at each distance becomes the child
            edge = parent * 65 + np.bitwise_count(fp[items] ^ fp[parent])
            order = np.argsort(edge, kind="stable")
            items, edge = items[order], edge[order]
            head = np.ones(len(items), bool)
            head[1:] = edge[1:] != edge[:-1]
            child = items[head]
            links.append((edge[head], child))
            parent = np.repeat(child, np.diff(np.append(np.flatnonzero(head), len(items))))[~head]
            items = items[~head]
        edges = np.concatenate([e for e, _ in links]) if links else np.zeros(0, np.int64)
        nodes = np.concatenate([c for _, c in links]) if links else np.zeros(0, np.int64)
        order = np.argsort(edges)
        self.edges, self.nodes = edges[order], nodes[order]

    def search(self, queries: np.ndarray, groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) within the radius, a query's own row aside."""
        at = np.minimum(np.searchsorted(self.groups, groups), max(len(self.groups) - 1, 0))
        there = self.groups[at] == groups if len(self.groups) else np.zeros(len(queries), bool)
        query, node, hits = queries[there], self.roots[at[there]] if len(self.groups) else queries[there], []
        while len(query):
            away = np.bitwise_count(self.fp[query] ^ self.fp[node]).astype(np.int64)
            near = (away <= radius) & (query != node)
            hits.append((query[near], node[near]))
            low = np.searchsorted(self.edges, node * 65 + np.maximum(away - radius, 0), "left")
            count = np.searchsorted(self.edges, node * 65 + np.minimum(away + radius, 64), "right") - low
            query = np.repeat(query, count)
            node = self.nodes[np.repeat(low - np.cumsum(count) + count, count) + np.arange(len(query))]
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([a for a, _ in hits]), np.concatenate([b for _, b in hits])


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest label per component after adding the edges."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, shorter := label[label]):
            label = shorter


def linked(group: np.ndarray, fp: np.ndarray, is_tree: np.ndarray, is_query: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all links within the radius, as pairs of fingerprints."""
    order = np.argsort(group, kind="stable")
    group, fp, is_tree, is_query = group[order], fp[order], is_tree[order], is_query[order]
    _, at, sizes = np.unique(group, return_inverse=True, return_counts=True)
    sizes = sizes[at]
    several = sizes > 1
    group, fp, is_tree, is_query, sizes = group[several], fp[several], is_tree[several], is_query[several], sizes[several]
    label = np.arange(len(fp))
    if len(fp):
        forest, queries = Forest(group, fp, is_tree), np.flatnonzero(is_query)
        turns = np.cumsum(sizes[queries]) // PAIRS
        for some in np.split(queries, np.flatnonzero(np.diff(turns)) + 1):
            label = _merge(label, *forest.search(some, group[some], radius))
    moved = np.flatnonzero(label != np.arange(len(label)))
    return fp[moved], fp[label[moved]]


def _link_partitions(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if parts:
            shard, fp, role = (np.concatenate(c) for c in zip(*parts))
            a, b = linked(shard, fp.view(np.uint64), role != 2, role != 1, radius)
            yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])

    return run


def links(distinct: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``u, v``: links that span every component of distinct fingerprints ``fp``; radius at most 4."""
    if radius > len(BLOCKS) - 2:
        raise ValueError("the shards find pairs of at most 4 differing bits")
    fp = F.col("fp")
    block = [F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << n) - 1)) for low, n in BLOCKS]
    keys = [
        F.lit(t << 44) + F.shiftleft(block[i], 22) + block[j]
        for t, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))
    ]
    keyed = distinct.select(F.explode(F.array(*keys)).alias("shard"), "fp")
    # shards above the bound are cut into blocks; every pair of blocks is one tree with its queries
    large = keyed.groupBy("shard").count().filter(F.col("count") > shard_rows)
    large = large.select("shard", F.ceil(F.col("count") / shard_rows).cast("int").alias("blocks"))
    rows = keyed.join(large, "shard", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pair = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(
            F.xxhash64("shard", F.least(own, other), F.greatest(own, other)).alias("shard"), "fp",
            F.when(own == other, 0).when(own < other, 1).otherwise(2).alias("role"),
        ),
    )
    whole = F.array(F.struct("shard", "fp", F.lit(0).alias("role")))
    rows = rows.select(F.explode(F.when(F.col("blocks").isNull(), whole).otherwise(pair)).alias("r")).select("r.*")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "shard").mapInArrow(_link_partitions(radius), "u bigint, v bigint")


def _grouped(docs: DataFrame, size: int, radius: int) -> DataFrame:
    """``doc_id, text_hash, fp``, the component's smallest fingerprint ``root`` and its smallest id ``component_id``."""
    found = materialize(fingerprints(docs, size), "fingerprints")
    distinct = found.groupBy("fp").agg(F.min("doc_id").alias("first"))
    of = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(of.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root")
    return found.join(named, "fp")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row."""
    fingerprint_ = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return _grouped(docs, size, radius).select("doc_id", fingerprint_, "component_id")


def without_near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The documents with one row of each component: that of the smallest id, of equal ids the smallest text hash.

    A row without id has a large id made from its text, so that it stays only if its component has no row with an id.
    """
    key = F.coalesce("doc_id", F.lit(2**63 - 1) - F.shiftrightunsigned(F.xxhash64("text"), 2))
    rows, _, back = shielded(docs, "doc_id", "text")
    keyed = rows.withColumn("_key", key)
    found = _grouped(keyed.select(F.col("_key").alias("doc_id"), "text"), size, radius)
    first = found.filter(F.col("doc_id") == F.col("component_id")).groupBy("root")
    stay = first.agg(F.first("doc_id").alias("_key"), F.min("text_hash").alias("_hash")).drop("root")
    turn = F.row_number().over(Window.partitionBy("_key", "_hash").orderBy("_key"))
    hashed = keyed.withColumn("_hash", F.xxhash64("text"))
    kept = hashed.join(stay, ["_key", "_hash"]).withColumn("_turn", turn).filter(F.col("_turn") == 1)
    return back(kept)
