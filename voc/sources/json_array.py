"""JSON array files read by many tasks each.

Spark's text reader cuts a file into byte ranges and gives every range the fragments between closing braces that begin in it.
A range is lexed on its own, once as if it began outside of a string and once as if inside: what it does to the string state
and to the depth, and at which depths its braces close. Two neighbouring summaries combine into one, so a prefix scan over the
ranges gives the state in which each begins. A second pass then knows which braces end a record. Records that lie in one range
are cut out there; only the first and last pieces of the ranges are put together in a shuffle, by record number.

The summaries are collected, one row per range: ``MAX_RANGES`` bounds them, ``spark.sql.files.maxPartitionBytes`` sets their
number. Elements of an array are objects. A file that is no array of them is an error, wherever it is damaged; a file of no
bytes has no rows. Files of a folder count in the order of their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_RANGES = 1 << 20
CLOSE = "}"
_ESCAPED = re.compile(rb"\\.", re.DOTALL)
_CORRUPT = "_damaged_record"


def _brackets(fragment: bytes) -> tuple[int, int, int]:
    """Whether the string state turns, and the change of depth if it begins outside, or inside, of a string."""
    if b"\\" in fragment:
        fragment = _ESCAPED.sub(b"", fragment)
    parts = fragment.split(b'"')
    change = []
    for side in (parts[::2], parts[1::2]):
        text = b"".join(side)
        change.append(text.count(b"{") + text.count(b"[") - text.count(b"]"))
    return (len(parts) - 1) & 1, change[0], change[1]


@dataclass
class Summary:
    """What a range does: for both states at its begin, the change of depth, and how often, first and last where braces close.

    ``closes[inside][depth]`` is ``(count, first fragment, last fragment)`` of the braces that close to a relative depth.
    """

    turns: int = 0
    depth: tuple[int, int] = (0, 0)
    closes: tuple[dict[int, tuple[int, int, int]], dict[int, tuple[int, int, int]]] = field(default_factory=lambda: ({}, {}))

    def then(self, other: "Summary") -> tuple[int, tuple[int, int]]:
        """State and depths of two ranges in a row."""
        return self.turns ^ other.turns, tuple(self.depth[s] + other.depth[s ^ self.turns] for s in (0, 1))


def summary(fragments: Iterable[bytes], begins_file: bool) -> Summary:
    """Every fragment but the first one of a file has a closing brace in front of it."""
    state, depth, closes = [0, 1], [0, 0], ({}, {})
    for i, fragment in enumerate(fragments):
        turns, *change = _brackets(fragment)
        for s in (0, 1):
            if state[s] == 0 and (i or not begins_file):
                depth[s] -= 1
                n, first, _ = closes[s].get(depth[s], (0, i, i))
                closes[s][depth[s]] = (n + 1, first, i)
            depth[s] += change[state[s]]
            state[s] ^= turns
    return Summary(state[0], (depth[0], depth[1]), closes)


@dataclass
class Place:
    """Where a range begins: state, depth and record; ``ends`` records end in it, at the fragments ``first`` to ``last``."""

    inside: int
    depth: int
    record: int
    ends: int
    first: int
    last: int


def places(rows: Iterable[tuple[str, int, Summary]]) -> tuple[dict[tuple[str, int], Place], dict[str, tuple[int, int]]]:
    """The prefix scan over all ranges, and the first record and number of records of each file."""
    found: dict[tuple[str, int], Place] = {}
    files: dict[str, tuple[int, int]] = {}
    record, file, so_far = 0, None, Summary()
    for name, start, own in sorted(rows, key=lambda r: r[:2]):
        if name != file:
            _check_end(file, so_far)
            file, so_far, files[name] = name, Summary(), (record, 0)
        inside, depth = so_far.turns, so_far.depth[0]
        ends, first, last = own.closes[inside].get(1 - depth, (0, 0, 0))
        found[name, start] = Place(inside, depth, record, ends, first, last)
        record += ends
        files[name] = (files[name][0], files[name][1] + ends)
        so_far = Summary(*so_far.then(own))
    _check_end(file, so_far)
    return found, files


def _check_end(file: str | None, whole: Summary) -> None:
    if file is not None and (whole.turns or whole.depth[0]):
        raise ValueError(f"{file} is not a whole JSON array")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """``file, start, fragment number, fragment`` of the ranges of a task, one after the other."""
    at, i = None, 0
    for batch in batches:
        names, starts, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()
        for name, start, text in zip(names, starts, texts):
            at, i = ((name, start), 0) if (name, start) != at else (at, i + 1)
            yield name, start, i, text


_SUMMARY = (
    "file string, start bigint, turns int, depth array<bigint>, "
    "closes array<array<struct<depth: bigint, n: bigint, first: bigint, last: bigint>>>"
)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = _ranges(batches)
    row = next(rows, None)
    kind = pa.list_(pa.list_(pa.struct([(n, pa.int64()) for n in ("depth", "n", "first", "last")])))

    def of_range(head: tuple[str, int, int, bytes], rest: Iterator) -> Iterator[bytes]:
        nonlocal row
        yield head[3]
        row = None
        for row in rest:
            if row[:2] != head[:2]:
                return
            yield row[3]
            row = None

    while row is not None:
        head = row
        own = summary(of_range(head, rows), head[1] == 0)
        closes = [[dict(depth=d, n=n, first=a, last=b) for d, (n, a, b) in sorted(side.items())] for side in own.closes]
        yield pa.record_batch(
            [pa.array([head[0]]), pa.array([head[1]]), pa.array([own.turns], pa.int32()), pa.array([list(own.depth)]), pa.array([closes], kind)],
            names=["file", "start", "turns", "depth", "closes"],
        )


def _scan(fragments: DataFrame) -> tuple[dict[tuple[str, int], Place], dict[str, tuple[int, int]]]:
    found = fragments.mapInArrow(_summaries, _SUMMARY).limit(MAX_RANGES + 1).collect()
    if len(found) > MAX_RANGES:
        raise ValueError("too many byte ranges: raise spark.sql.files.maxPartitionBytes")
    rows = []
    for r in found:
        closes = tuple({c.depth: (c.n, c.first, c.last) for c in side} for side in r.closes)
        rows.append((r.file, r.start, Summary(r.turns, tuple(r.depth), closes)))
    return places(rows)


def _batches(rows: Iterator[tuple], names: list[str], at_once: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows whose last field is a text, as batches of about so many bytes."""
    waiting, size = [], 0
    for row in rows:
        waiting.append(row)
        size += len(row[-1]) + 16
        if size >= at_once:
            yield pa.record_batch([pa.array(c) for c in zip(*waiting)], names=names)
            waiting, size = [], 0
    if waiting:
        yield pa.record_batch([pa.array(c) for c in zip(*waiting)], names=names)


def _inner_records(known):
    """``record, text`` of the records that begin and end in one range."""

    def cut(rows: Iterator[tuple[str, int, int, bytes]]) -> Iterator[tuple[int, str]]:
        inside = depth = record = 0
        pieces: list[bytes] = []
        for name, start, i, fragment in rows:
            place = known.value[name, start]
            if i == 0:
                inside, depth, record, pieces = place.inside, place.depth, place.record, []
            turns, *change = _brackets(fragment)
            if i or start:
                closes = not inside
                depth -= closes
                if closes and depth == 1:
                    if i > place.first:
                        yield record, b"".join([*pieces, b"}"]).decode()
                    record, pieces = record + 1, []
                else:
                    pieces.append(b"}")
            depth += change[inside]
            inside ^= turns
            if place.first <= i < place.last:
                pieces.append(fragment)
            else:
                pieces = []

    return lambda batches: _batches(cut(_ranges(batches)), ["record", "text"])


def _outer_pieces(known):
    """``file, record, start, i, text``: what a range has before its first record end and after its last one."""

    def cut(rows: Iterator[tuple[str, int, int, bytes]]) -> Iterator[tuple[str, int, int, int, str]]:
        for name, start, i, fragment in rows:
            place = known.value[name, start]
            text = (CLOSE if i or start else "") + fragment.decode()
            if not place.ends or i < place.first:
                yield name, place.record, start, i, text
                continue
            if i == place.first:
                yield name, place.record, start, i, CLOSE
            if i >= place.last:
                yield name, place.record + place.ends, start, i, text if i > place.last else text[1:]

    return lambda batches: _batches(cut(_ranges(batches)), ["file", "record", "start", "i", "text"])


def _checked(good: Column) -> Column:
    error = F.raise_error(F.concat(F.lit("damaged JSON array near: "), F.substring("text", 1, 80))).cast("string")
    return F.when(good, F.col("text")).otherwise(error).alias("text")


def json_texts(spark: SparkSession, path: str) -> DataFrame:
    """``record, text``: the objects of the arrays in their order, numbered over all files."""
    fragments = spark.read.option("lineSep", CLOSE).text(path).select("_metadata.file_path", "_metadata.file_block_start", "value")
    found, files = _scan(fragments)
    known = spark.sparkContext.broadcast(found)
    inner = fragments.mapInArrow(_inner_records(known), "record bigint, text string")
    pieces = fragments.mapInArrow(_outer_pieces(known), "file string, record bigint, start bigint, i bigint, text string")
    joined = pieces.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("start", "i", "text"))).alias("p"))
    # a row per file, of which there are at most MAX_RANGES; what stands behind a file's last record has the number ``stop``
    bounds = spark.createDataFrame([(f, a, a + n) for f, (a, n) in files.items()], "file string, first bigint, stop bigint")
    joined = joined.join(F.broadcast(bounds), "file").select("record", "first", "stop", F.array_join(F.col("p.text"), "").alias("text"))
    end = F.col("record") == F.col("stop")
    shape = (
        F.when(F.col("first") == F.col("stop"), r"^\uFEFF?\s*\[\s*\]\s*$").when(end, r"^\s*\]\s*$")
        .when(F.col("record") == F.col("first"), r"^\uFEFF?\s*\[\s*\{").otherwise(r"^\s*,\s*\{")
    )
    joined = joined.select("record", end.alias("end"), _checked(F.regexp("text", shape)))
    inner = inner.select("record", _checked(F.col("text").rlike(r"^\s*,\s*\{")))
    rows = inner.unionByName(joined.filter(~F.col("end") | F.col("text").isNull()).select("record", "text"))
    return rows.select("record", F.regexp_replace("text", r"^[^{]*", "").alias("text"))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType, position: str = "pos") -> DataFrame:
    """The objects as rows of the schema; ``position`` is the object's own value or else its number.

    Values that do not fit their type are null, as in any JSON reader; text that is no JSON is an error.
    """
    parsed = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    rows = json_texts(spark, path).withColumn("r", F.from_json("text", parsed, {"columnNameOfCorruptRecord": _CORRUPT}))
    broken = F.col(f"r.{_CORRUPT}").isNotNull() & F.try_parse_json("text").isNull()
    rows = rows.withColumn("r", F.when(broken, F.raise_error(F.concat(F.lit("damaged JSON record: "), F.substring("text", 1, 80)))).otherwise(F.col("r")))
    own = [F.col(f"r.`{f.name}`").alias(f.name) for f in schema.fields if f.name != position]
    place = F.coalesce(f"r.`{position}`", "record") if position in schema.fieldNames() else F.col("record")
    names = schema.fieldNames() if position in schema.fieldNames() else [*schema.fieldNames(), position]
    return rows.select(place.alias(position), *own).select(*[f"`{n}`" for n in names])


def write_json_array(df: DataFrame, path: str) -> None:
    """One file per partition, each of them a JSON array; nulls are written."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i in range(0, len(texts), 1024):
                yield pa.record_batch([pa.array([lead if i == 0 else ",", *[","] * (len(texts[i : i + 1024]) - 1)]), pa.array(texts[i : i + 1024])], names=["lead", "text"])
                lead = ","
        yield pa.record_batch([pa.array(["[]" if lead == "[" else "]"]), pa.array([""])], names=["lead", "text"])

    columns = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    out = df.select(columns.alias("text")).mapInArrow(rows, "lead string, text string")
    out.select(F.concat("lead", "text").alias("value")).write.mode("overwrite").text(path)
