"""Keeps a table's other columns out of an operator's way, whatever they are called."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def shielded(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """The table with all but the needed columns renamed, its column names, and the way back to the given columns."""
    names = [
        name if name in needed and docs.columns.index(name) == i else f"own_{i}" for i, name in enumerate(docs.columns)
    ]
    return docs.toDF(*names), names, lambda out: out.select(*names).toDF(*docs.columns)
