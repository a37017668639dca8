"""Nearest neighbours by cosine over an inverted-file index.

Equal vectors are one entry of the index, with the smallest keys of their rows. Coarse centres are fitted by k-means of unit
vectors on a bounded sample: the ``SAMPLE`` entries of the smallest hash, about sqrt(n) centres, at most ``MAX_CELLS``. Every
entry belongs to the cell of its nearest centre; a cell of more than ``HOT`` times the wanted rows gets finer centres from
a bounded sample of its own. Cells are packed in blocks of about ``BLOCK_ROWS`` vectors: small ones together, a large one as many
blocks.

A query visits the cells of its ``probes`` nearest centres and is sent once to each block of them, where its cosines are exact;
the best of the blocks are merged. A block and at most about ``UNIT_QUERIES`` of its queries are one unit of work: the block's rows
come first and are held, the queries stream by, ``QUERY_ROWS`` at once, so that a task's memory does not grow with the table.

``probes=None`` visits every cell, which gives the exact answer. There the queries are held, at most about ``UNIT_QUERIES`` in a
unit, and the rows of a slice of the table stream by: a query keeps its best so far, so only what comes near them is looked at,
and a unit returns one short list a query. Rows are found by cosines of 4-byte numbers with a margin above their error, and
compared by exact ones. Unless a number is given,
the exact neighbours of ``TUNING`` sampled entries tell how many cells hold the share ``RECALL`` of them.

Rows: null, empty and all-zero vectors, and rows without a key, have no neighbours and are none; a row is never its own
neighbour, other rows of its key are not told from it; vectors of different lengths are an error. Equal cosines (to nine
decimals) go by key. Fewer other rows than ``k`` give fewer neighbours; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voc.storage import materialize

NEIGHBOURS = 15
TUNED, TUNING, RECALL = 0, 256, 0.95
SAMPLE, MAX_CELLS, HOT, HOT_ROUNDS, HOT_SAMPLE, HOT_AT_ONCE = 20_000, 4096, 4, 3, 500, 32
BLOCK_ROWS, QUERY_ROWS, UNIT_QUERIES, UNITS, PAIRS = 8192, 256, 32768, 3, 1 << 16
SALTS, EQUAL_ROWS = 16, 4096
STEPS, DECIMALS = 12, 9


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Unit vectors, one a row, of a list array without nulls."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _kmeans(rows: np.ndarray, k: int) -> np.ndarray:
    """Centres of unit length; the first ones are spread evenly over the rows, which come in hashed order."""
    centres = rows[np.linspace(0, len(rows) - 1, min(k, len(rows))).astype(int)]
    for _ in range(STEPS):
        nearest = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        sizes = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(sizes > 0, sums / np.maximum(sizes, 1e-300), centres)
    return centres


def _sample(entries: DataFrame, n: int) -> np.ndarray:
    rows = entries.orderBy(F.xxhash64("vector"), "vector").limit(n).select("vector").toArrow()   # at most n rows
    return _matrix(rows.column(0).combine_chunks()) if rows.num_rows else np.zeros((0, 1))


@dataclass
class Index:
    """``blocks``: group of cells, part, entries with cells, vectors and keys; ``centres`` one a row; ``parts`` of every group."""

    entries: DataFrame
    blocks: DataFrame
    centres: np.ndarray
    group_of: np.ndarray
    parts: np.ndarray
    k: int
    narrow: bool = False   # the vectors are of 4-byte numbers

    def sent(self, vector: str) -> Column:
        return F.col(vector).cast("array<float>" if self.narrow else "array<double>").alias(vector)


def _at(numbers: np.ndarray, i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, numbers.tolist())), i + 1)


def usable(vectors: DataFrame, key: str, col: str) -> DataFrame:
    """``key, vector`` of the rows that have both and a direction."""
    v = F.col(col).cast("array<double>")
    rows = vectors.select(F.col(key).cast("bigint").alias("key"), v.alias("vector"))
    some = F.exists("vector", lambda x: x != 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x))
    return rows.filter(F.col("key").isNotNull() & some)


def entries_of(rows: DataFrame, k: int) -> DataFrame:
    """``vector, keys``: different vectors with the k + 1 smallest keys of their rows."""
    place = F.row_number().over(Window.partitionBy("h", "vector").orderBy("key"))
    first = rows.withColumn("h", F.xxhash64("vector")).withColumn("place", place).filter(F.col("place") <= k + 1)
    grouped = first.groupBy("h", "vector").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    return grouped.select("vector", "keys")


def _with_cells(entries: DataFrame, centres: np.ndarray, probes: int, keep: tuple[str, ...]) -> DataFrame:
    """The rows with the numbers of their ``probes`` nearest centres, in that order."""
    known = entries.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _matrix(batch.column("vector")) @ known.value.T
            cells = np.argsort(-near, axis=1, kind="stable")[:, :probes] if probes > 1 else near.argmax(axis=1)[:, None]
            column = pa.array(list(cells.astype(np.int32)), pa.list_(pa.int32()))
            yield pa.record_batch([*[batch.column(c) for c in keep], column], names=[*keep, "cells"])

    kinds = {f.name: f.dataType.simpleString() for f in entries.schema.fields}
    return entries.select(*keep).mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "cells array<int>"]))


def build(vectors: DataFrame, key: str, col: str, k: int = NEIGHBOURS, cells: int | None = None) -> Index:
    entries = materialize(entries_of(usable(vectors, key, col), k).withColumn("entry", F.monotonically_increasing_id()), "vector_entries")
    lengths = entries.agg(F.count("*"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    n = lengths[0]
    if lengths[1] != lengths[2]:
        raise ValueError(f"vectors of {lengths[1]} and of {lengths[2]} numbers")
    wanted = min(cells or math.isqrt(max(n - 1, 0)) + 1, MAX_CELLS)
    rows_a_cell = max(n // wanted, 1)
    centres = _kmeans(_sample(entries, SAMPLE), wanted) if n else np.zeros((1, 1))
    for turn in range(HOT_ROUNDS + 1):
        placed = _with_cells(entries, centres, 1, ("entry", "vector", "keys")).withColumn("cell", F.get("cells", F.lit(0)))
        placed = materialize(placed.drop("cells"), "vector_cells")
        sizes = np.zeros(len(centres), np.int64)
        for cell, size in placed.groupBy("cell").count().collect():   # at most MAX_CELLS rows
            sizes[cell] = size
        hot = np.argsort(-sizes)[:HOT_AT_ONCE]
        hot = hot[sizes[hot] > HOT * rows_a_cell]
        room = MAX_CELLS - len(centres)
        if turn == HOT_ROUNDS or not len(hot) or room <= 0 or cells:
            break
        for cell in hot.tolist():
            finer = _kmeans(_sample(placed.filter(F.col("cell") == cell), HOT_SAMPLE), min(int(sizes[cell]) // rows_a_cell, room + 1))
            centres = np.concatenate([centres, finer[1:]])
            centres[cell] = finer[0]
            room = MAX_CELLS - len(centres)
    # neighbouring numbers share a group while it has room
    group_of, room, group = np.zeros(len(sizes), np.int64), BLOCK_ROWS, 0
    for cell, size in enumerate(sizes.tolist()):
        if size > room and room < BLOCK_ROWS:
            group, room = group + 1, BLOCK_ROWS
        group_of[cell], room = group, max(room - size, 0)
    parts = np.maximum(-(-np.bincount(group_of, sizes).astype(np.int64) // BLOCK_ROWS), 1)
    blocks = placed.withColumn("group", _at(group_of, F.col("cell")).cast("int"))
    blocks = blocks.withColumn("part", F.pmod(F.xxhash64("entry"), _at(parts, F.col("group"))).cast("int"))
    blocks = blocks.groupBy("group", "part").agg(F.collect_list(F.struct("cell", "entry", "vector", "keys")).alias("rows"))
    narrow = vectors.schema[col].dataType.simpleString() == "array<float>"
    return Index(entries, materialize(blocks, "vector_blocks"), centres, group_of, parts, k, narrow)


def _visited(cells: pa.Array, of_row: np.ndarray) -> np.ndarray:
    """Which rows each query visits."""
    known, row = np.unique(of_row, return_inverse=True)
    visits = np.zeros((len(cells), len(known)), bool)
    for i, some in enumerate(cells.to_pylist()):
        at = np.searchsorted(known, some)
        at = at[at < len(known)]
        visits[i, at[np.isin(known[at], some)]] = True
    return visits[:, row]


class _Block:
    """The rows of a block, held while its queries come by."""

    def __init__(self, rows: list[pa.RecordBatch]):
        self.matrix = np.concatenate([_matrix(r.column("vector")) for r in rows])
        self.cells, self.entries = (np.concatenate([r.column(n).to_numpy() for r in rows]) for n in ("cell", "entry"))
        self.keys = pa.concat_arrays([r.column("keys") for r in rows])

    def nearest(self, asked: pa.RecordBatch, k: int) -> list[list[dict]]:
        """The k + 1 nearest rows of each query."""
        cosines = _matrix(asked.column("vector")) @ self.matrix.T
        cosines[~_visited(asked.column("cells"), self.cells)] = -2.0
        count = min(k + 1, cosines.shape[1])
        least = np.partition(cosines, cosines.shape[1] - count, axis=1)[:, cosines.shape[1] - count]
        near = []
        for row, low in zip(cosines, least):
            # cosines are compared as rounded: what rounds to the least one is less than a unit below it
            at = np.flatnonzero(row >= max(low, -1.5) - 1.01 * 10.0**-DECIMALS)
            rounded = np.round(row[at], DECIMALS)
            at, rounded = (x[rounded >= max(np.round(low, DECIMALS), -1.5)] for x in (at, rounded))
            first = np.lexsort((self.entries[at], -rounded))[:count]
            some = zip(at[first].tolist(), rounded[first].tolist())
            found = sorted((-c, key, int(self.cells[i])) for i, c in some for key in self.keys[i].as_py())[: k + 1]
            near.append([{"cosine": -c, "key": key, "cell": cell} for c, key, cell in found])
        return near


def _best(k: int):
    """``entry, near``: the k + 1 nearest rows of a block for each query, from rows sorted by unit, a block's own rows first."""
    kind = pa.list_(pa.struct([("cosine", pa.float64()), ("key", pa.int64()), ("cell", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows, block = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(n).to_numpy() for n in ("group", "part", "copy", "query")])
            begins = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(begins, begins[1:]):
                some = batch.slice(low, high - low)
                if not len(some):
                    continue
                if tuple(marks[:3, low]) != unit:
                    unit, rows, block = tuple(marks[:3, low]), [], None
                if not marks[3, low]:
                    rows.append(some)
                    continue
                if block is None and rows:
                    block, rows = _Block(rows), []
                for at in range(0, len(some) if block else 0, QUERY_ROWS):
                    asked = some.slice(at, QUERY_ROWS)
                    yield pa.record_batch([asked.column("entry"), pa.array(block.nearest(asked, k), kind)], names=["entry", "near"])

    return run


class _Unit:
    """Queries held with the nearest of the rows that have come by."""

    def __init__(self, queries: list[pa.RecordBatch], k: int):
        self.entries = np.concatenate([q.column("entry").to_numpy() for q in queries])
        self.exact = np.concatenate([_matrix(q.column("vector")) for q in queries])
        self.short, self.count = self.exact.astype(np.float32), k + 1
        self.least, self.last = np.full(len(self.entries), -2.0), np.full(len(self.entries), np.iinfo(np.int64).max)
        none = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32))
        self.best = [none for _ in range(0, len(self.entries), QUERY_ROWS)]   # query, minus cosine, key, cell

    def meet(self, rows: pa.RecordBatch) -> None:
        exact, cells, keys = _matrix(rows.column("vector")), rows.column("cell").to_numpy(), rows.column("keys")
        short, margin = np.ascontiguousarray(exact.astype(np.float32).T), (exact.shape[1] + 8) * 2.0**-23
        sizes, keys = pc.list_value_length(keys).to_numpy().astype(np.int64), keys.flatten().to_numpy()
        heads = np.cumsum(sizes) - sizes
        width = max(len(cells) // (4 * self.count), 1)
        blocks = len(cells) // width
        for turn, low in enumerate(range(0, len(self.entries), QUERY_ROWS)):
            near = self.short[low : low + QUERY_ROWS] @ short
            least = self.least[low : low + QUERY_ROWS]
            cut = least - margin
            if least.min() == -2.0 and blocks >= self.count:   # as many rows as blocks are at least as near as the blocks' nearest
                most = near[:, : blocks * width].reshape(len(near), blocks, width).max(axis=2)
                cut = np.maximum(cut, np.partition(most, blocks - self.count, axis=1)[:, blocks - self.count] - 2 * margin)
            found = np.flatnonzero(near >= np.nextafter(cut.astype(np.float32), np.float32(-9))[:, None])
            for at in range(0, len(found), PAIRS):
                query, row = np.divmod(found[at : at + PAIRS], near.shape[1])
                cosine = np.round(np.einsum("ij,ij->i", self.exact[low + query], exact[row]), DECIMALS)
                nearer = (cosine > self.least[low + query]) | (cosine == self.least[low + query]) & (keys[heads[row]] < self.last[low + query])
                if nearer.any():
                    query, row, cosine = query[nearer], row[nearer], cosine[nearer]
                    of = np.repeat(np.arange(len(row)), sizes[row])
                    place = np.arange(len(of)) + np.repeat(heads[row] - (np.cumsum(sizes[row]) - sizes[row]), sizes[row])
                    self._keep(turn, low, (query[of], -cosine[of], keys[place], cells[row[of]]))

    def _keep(self, turn: int, low: int, more: tuple[np.ndarray, ...]) -> None:
        query, less, key, cell = (np.concatenate(x) for x in zip(self.best[turn], more))
        order = np.lexsort((key, less, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order = order[place < self.count]
        self.best[turn] = query, less, key, _ = query[order], less[order], key[order], cell[order]
        full = np.flatnonzero(place[place < self.count] == self.count - 1)
        self.least[low + query[full]], self.last[low + query[full]] = -less[full], key[full]

    def nearest(self) -> Iterator[pa.RecordBatch]:
        for turn, low in enumerate(range(0, len(self.entries), QUERY_ROWS)):
            entries = self.entries[low : low + QUERY_ROWS]
            query, less, key, cell = self.best[turn]
            ends = pa.array(np.searchsorted(query, np.arange(len(entries) + 1)).astype(np.int32))
            near = pa.StructArray.from_arrays([pa.array(less), pa.array(key), pa.array(cell)], names=["less", "key", "cell"])
            yield pa.record_batch([pa.array(entries), pa.ListArray.from_arrays(ends, near)], names=["entry", "near"])


def _met(k: int):
    """``entry, near``: the k + 1 nearest rows of a unit's slice for each of its queries, which come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, queries, unit = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(n).to_numpy() for n in ("unit", "turn")])
            begins = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(begins, begins[1:]):
                if low == high:
                    continue
                if marks[0, low] != at:
                    if unit:
                        yield from unit.nearest()
                    at, queries, unit = marks[0, low], [], None
                if not marks[1, low]:
                    queries.append(batch.slice(low, high - low))
                    continue
                if queries:
                    unit, queries = _Unit(queries, k), []
                for first in range(low, high if unit else low, BLOCK_ROWS):
                    unit.meet(batch.slice(first, min(BLOCK_ROWS, high - first)))
        if unit:
            yield from unit.nearest()

    return run


def _exact(index: Index, entries: DataFrame) -> DataFrame:
    """``entry, near``: the k + 1 nearest rows of different vectors, sorted, as minus cosine, key and cell."""
    groups = max(-(-entries.count() // UNIT_QUERIES), 1)
    # work for all cores: the table in slices that each are met by all queries
    slices = -(-UNITS * entries.sparkSession.sparkContext.defaultParallelism // groups)
    slices = max(min(slices, int(index.parts.sum())), 1)

    def dealt(entry: str, count: int) -> Column:
        return F.pmod(F.xxhash64(entry), F.lit(count)).cast("int")

    group, part = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))), F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    own = index.blocks.select(F.inline("rows")).withColumn("group", group)
    own = own.withColumn("unit", F.col("group") * slices + dealt("entry", slices))
    asked = entries.withColumn("part", part).withColumn("unit", dealt("entry", groups) * slices + F.col("part"))
    none = (F.lit(None).cast("int").alias("cell"), F.lit(None).cast("array<bigint>").alias("keys"))
    both = asked.select("unit", F.lit(0).alias("turn"), "entry", index.sent("vector"), *none)
    both = both.unionByName(own.select("unit", F.lit(1).alias("turn"), "entry", index.sent("vector"), "cell", "keys"))
    both = both.repartition(4 * groups * slices, "unit").sortWithinPartitions("unit", "turn")
    found = both.mapInArrow(_met(index.k), "entry bigint, near array<struct<less: double, key: bigint, cell: int>>")
    return found.groupBy("entry").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, index.k + 1).alias("near")).filter(F.size("near") > 0)


def _nearest(index: Index, entries: DataFrame, probes: int | None) -> DataFrame:
    """``entry, place, key, cosine, cell``: the k + 1 nearest rows of different vectors."""
    k, count = index.k, len(index.centres)
    groups = len(index.parts)
    if probes is None or probes >= count:
        near = _exact(index, entries).select("entry", F.posexplode("near").alias("at", "x"))
        return near.select("entry", (F.col("at") + 1).alias("place"), "x.key", (-F.col("x.less")).alias("cosine"), "x.cell")
    visited = materialize(_with_cells(entries, index.centres, probes, ("entry", "vector")), "query_cells")
    visits = visited.select("entry", "vector", F.transform("cells", lambda c: F.struct(_at(index.group_of, c).cast("int").alias("group"), c.alias("cell"))).alias("cells"))
    visits = visits.withColumn("group", F.explode(F.array_distinct("cells.group")))
    visits = visits.withColumn("cells", F.transform(F.filter("cells", lambda c: c["group"] == F.col("group")), lambda c: c["cell"]))
    copies = np.ones(groups, np.int64)
    for group, size in visits.groupBy("group").count().collect():   # at most MAX_CELLS rows
        copies[group] = -(-size // UNIT_QUERIES)
    # small rows on both sides: a block's rows go to each of its copies, a query to one copy of each block
    unit = (F.col("group"), F.col("part"), F.col("copy"))
    own = index.blocks.select("group", "part", F.inline("rows"))
    own = own.withColumn("copy", F.explode(F.sequence(F.lit(0), _at(copies, F.col("group")).cast("int") - 1)))
    asked = visits.withColumn("copy", F.pmod(F.xxhash64("entry"), _at(copies, F.col("group"))).cast("int"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), _at(index.parts, F.col("group")).cast("int") - 1)))
    none = (F.lit(None).cast("int").alias("cell"), F.lit(None).cast("array<bigint>").alias("keys"), F.lit(1).alias("query"))
    own = own.select(*unit, "entry", index.sent("vector"), F.lit(None).cast("array<int>").alias("cells"), "cell", "keys", F.lit(0).alias("query"))
    both = own.unionByName(asked.select(*unit, "entry", index.sent("vector"), "cells", *none))
    both = both.repartition(*unit).sortWithinPartitions(*unit, "query")
    found = both.mapInArrow(_best(k), "entry bigint, near array<struct<cosine: double, key: bigint, cell: int>>")
    order = Window.partitionBy("entry").orderBy(F.desc("cosine"), "key")
    found = found.select("entry", F.inline("near")).withColumn("place", F.row_number().over(order))
    return found.filter(F.col("place") <= k + 1)


def tuned_probes(index: Index, share: float = RECALL, asked: int = TUNING) -> int:
    """How many cells hold the share of the exact neighbours of sampled entries; all cells if there are none."""
    sample = materialize(index.entries.orderBy(F.xxhash64("vector"), "vector").limit(asked), "tuning")
    order = _with_cells(sample, index.centres, len(index.centres), ("entry", "vector", "keys")).select("entry", "keys", "cells")
    found = _nearest(index, sample.select("entry", "vector"), None).join(order, "entry").filter(~F.array_contains("keys", F.col("key")))
    # at most asked * (k + 1) numbers
    at = np.sort([r[0] for r in found.select(F.array_position("cells", F.col("cell"))).collect()])
    return int(at[min(math.ceil(share * len(at)), len(at)) - 1]) if len(at) else len(index.centres)


def search(index: Index, queries: DataFrame, key: str, col: str, probes: int | None = TUNED) -> DataFrame:
    """``key, rank, neighbour, cosine`` for every row of ``queries``: its nearest other rows of the index."""
    if probes == TUNED:
        probes = tuned_probes(index)
    asked = usable(queries, key, col).withColumn("h", F.xxhash64("vector"))
    # equal query vectors are asked once
    entries = asked.select("h", "vector").distinct().withColumn("entry", F.monotonically_increasing_id())
    entries = materialize(entries, "query_entries")
    wide = queries.schema[col].dataType.simpleString() != "array<float>"
    index, sent = replace(index, narrow=False) if wide else index, entries.select("entry", "vector")
    if probes is None or probes >= len(index.centres):
        found = _exact(index, sent).select("entry", F.transform("near", lambda x: F.struct(x["key"].alias("key"), (-x["less"]).alias("cosine"))).alias("all"))
    else:
        found = _nearest(index, sent, probes)
        found = found.groupBy("entry").agg(F.sort_array(F.collect_list(F.struct("place", "key", "cosine"))).alias("all"))
    # rows of one vector are dealt to SALTS places to get its neighbours if they are many, which few vectors' rows can be
    many = F.broadcast(asked.groupBy("h").count().filter(F.col("count") > EQUAL_ROWS).select("h", F.lit(SALTS).alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    answers = entries.join(found, "entry").drop("entry").join(many, "h", "left")
    answers = answers.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    rows = asked.join(many, "h", "left").withColumn("salt", F.pmod(F.xxhash64("key"), salts).cast("int")).drop("salts")
    rows = rows.join(answers, ["h", "vector", "salt"])
    others = F.slice(F.filter("all", lambda x: x["key"] != F.col("key")), 1, index.k)
    rows = rows.select(F.col("key").alias("of"), F.posexplode(others).alias("at", "x"))
    return rows.select(
        F.col("of").alias("key"), (F.col("at") + 1).cast("bigint").alias("rank"), F.col("x.key").alias("neighbour"), F.col("x.cosine").alias("cosine")
    )


def neighbours(
    vectors: DataFrame, key: str, col: str, which: Column | None = None, k: int = NEIGHBOURS, probes: int | None = TUNED,
    cells: int | None = None,
) -> DataFrame:
    """The ``k`` nearest rows of every row, or of those that ``which`` holds for."""
    return search(build(vectors, key, col, k, cells), vectors if which is None else vectors.filter(which), key, col, probes)


def recall(vectors: DataFrame, key: str, col: str, which: Column, k: int = NEIGHBOURS, probes: int = TUNED, cells: int | None = None) -> DataFrame:
    """One row: queries, true neighbours, and those of them that ``probes`` cells find."""
    index = build(vectors, key, col, k, cells)
    asked = vectors.filter(which)
    true = search(index, asked, key, col, None).select("key", "neighbour")
    found = search(index, asked, key, col, probes).select("key", "neighbour").withColumn("found", F.lit(1))
    both = true.join(found, ["key", "neighbour"], "left")
    return both.agg(F.count_distinct("key").alias("queries"), F.count("*").alias("neighbours"), F.count("found").alias("found"))
