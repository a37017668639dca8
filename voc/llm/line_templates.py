"""Line deduplication by log templates: a fixed-depth tree of token count and leading tokens, with variable fields.

A line's way through the tree is its number of tokens and its first ``DEPTH`` tokens; tokens with a digit count as the
variable ``<*>``. In its leaf a line belongs to the template that has all its other tokens, and, if it is long enough, to
templates in which one of ``FIELDS`` equal stretches of the tokens behind the leading ones is variable too. A template is
looked up by a hash of all that, so lines of one leaf meet only where they agree: no leaf is ever gathered in one place,
and a template that a third of all documents share is one partially aggregated counter.

A template recurs if enough documents hold it: ``LONG_DOCS`` for at least ``LONG`` constant tokens, else ``SHORT_DOCS``.
Its lines stay in the first of these documents (smallest ``doc_id``, null last) and are dropped from the others.

Rows: null texts stay null and empty ones empty, both without lines; lines under ``LEAST`` tokens stay; rows with equal
``doc_id`` and text are judged alike, and two rows of equal ``doc_id`` are both "first"; an empty table gives an empty
result. Other columns are carried along; names starting with ``_`` are taken by this module.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voc.llm.columns import shielded
from voc.storage import materialize

DEPTH, FIELDS = 3, 4
LEAST = 3                      # tokens of a line that can belong to a template
FIELD_LEAST = 12               # tokens of a line that can belong to a template with a variable stretch
LONG, LONG_DOCS, SHORT_DOCS = 12, 2, 8
SEED = 7
DIGITS = b"0123456789"
_HAS_DIGIT = bytes(48) + b"\x01" * 10 + bytes(198)


def masked(line: bytes) -> list[bytes]:
    """The tokens of a line, those with a digit as ``<*>``."""
    tokens = line.split()
    if any(line.translate(_HAS_DIGIT)):
        tokens = [b"<*>" if any(t.translate(_HAS_DIGIT)) else t for t in tokens]
    return tokens


def templates(tokens: list[bytes]) -> list[tuple[int, int]]:
    """(key, constant tokens) of the templates of one line."""
    n, digest = len(tokens), xxhash.xxh64_intdigest
    if n < LEAST:
        return []
    variable = tokens.count(b"<*>")
    if variable == n:
        return []
    way = b"%d\x00%s\x00" % (n, b" ".join(tokens[:DEPTH]))
    out = [(digest(way + b" ".join(tokens[DEPTH:]), SEED), n - variable)]
    if n >= FIELD_LEAST:
        edges = [DEPTH + (n - DEPTH) * k // FIELDS for k in range(FIELDS + 1)]
        parts = [b" ".join(tokens[a:b]) for a, b in zip(edges, edges[1:])]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            rest = b"\x00".join([*parts[:k], b"<*>", *parts[k + 1 :]])
            constant = n - variable - (b - a) + tokens[a:b].count(b"<*>")
            out.append((digest(way + b"%d\x00" % k + rest, SEED), constant))
    return out


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, row, line, ord, need, once`` for each line and template; ``once`` on the first line of a document that has it."""
    names = ["key", "row", "line", "ord", "need", "once"]
    kinds = [np.uint64, np.int64, np.int32, np.int64, np.int8, np.int8]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = [np.array(c, k) for c, k in zip(zip(*rows), kinds)]
        columns[0] = columns[0].view(np.int64)
        return pa.record_batch([pa.array(c) for c in columns], names=names)

    for batch in batches:
        rows: list[tuple] = []
        for row, order, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            seen: set[int] = set()
            for at, line in enumerate((text.as_py() or "").encode().split(b"\n")):
                for key, constant in templates(masked(line)):
                    rows.append((key, row, at, order, LONG_DOCS if constant >= LONG else SHORT_DOCS, key not in seen))
                    seen.add(key)
            if len(rows) > 200_000:
                yield packed(rows)
                rows = []
        if rows:
            yield packed(rows)


def _drop_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces ``_text`` by its remaining lines and ``_drop`` by their number, in the batches' own columns."""
    for batch in batches:
        texts, drops = batch.column("_text"), batch.column("_drop")
        out, counts, dropped = [], [], []
        for text, drop in zip(texts, drops):
            lines = text.as_py().split("\n") if text.is_valid and len(text.as_py()) else []
            gone = set(drop.as_py() or ())
            out.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if text.is_valid else None)
            counts.append(len(lines))
            dropped.append(len(gone))
        rest = [batch.column(n) for n in batch.schema.names if n not in ("_text", "_drop")]
        names = [n for n in batch.schema.names if n not in ("_text", "_drop")]
        yield pa.record_batch(
            [*rest, pa.array(out, pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())],
            names=[*names, "_text", "_lines", "_dropped"],
        )


def deduplicated(docs: DataFrame) -> DataFrame:
    """All columns, ``text`` without the lines of recurring templates, and ``_lines``, ``_dropped``: lines before, dropped."""
    keyed = docs.withColumns({
        "_row": F.xxhash64("doc_id", "text"), "_ord": F.coalesce("doc_id", F.lit(2**63 - 1)),
    })
    found = keyed.select("_row", "_ord", "text").mapInArrow(
        _occurrences, "key bigint, row bigint, line int, ord bigint, need tinyint, once tinyint"
    )
    found = materialize(found, "line_templates")
    recurring = (
        found.groupBy("key").agg(F.sum("once").alias("docs"), F.min("ord").alias("first"), F.max("need").alias("need"))
        .filter(F.col("docs") >= F.col("need")).select("key", "first")
    )
    gone = found.join(recurring, "key").filter(F.col("ord") != F.col("first"))
    drops = gone.groupBy(F.col("row").alias("_row")).agg(F.collect_set("line").alias("_drop"))
    joined = keyed.withColumnRenamed("text", "_text").drop("_ord").join(drops, "_row", "left").drop("_row")
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields if f.name not in ("_text", "_drop")]
    out = joined.mapInArrow(_drop_lines, ", ".join([*schema, "_text string", "_lines bigint", "_dropped bigint"]))
    return out.select(*["_text" if c == "text" else c for c in docs.columns], "_lines", "_dropped").withColumnRenamed("_text", "text")


def without_recurring_lines(docs: DataFrame) -> DataFrame:
    """The documents with the columns they came with; ``n_chars``, if there, counts the text that is left."""
    rows, names, back = shielded(docs, "doc_id", "text", "n_chars")
    out = deduplicated(rows)
    if "n_chars" in names:
        left = F.when(F.col("_dropped") == 0, F.col("n_chars")).otherwise(F.length("text"))
        out = out.withColumn("n_chars", left.cast(rows.schema["n_chars"].dataType))
    return back(out)
