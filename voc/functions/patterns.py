"""Many patterns over one text column in a single Arrow pass.

Matching uses the linear-time regular expressions of Arrow's compute kernels on whole batches. On the theme rules this
was measured about thirty times faster than one ``rlike`` per rule, whose backtracking matcher tries every word of
every alternation at every position.
"""

from __future__ import annotations

import re
from typing import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode letters, digits and underscore
WORD_CHAR = r"[\p{L}\p{N}_]"
NO_WORD_CHAR = r"[^\p{L}\p{N}_]"


def whole_words(pattern: str) -> str:
    r"""``\b(a|b)\b`` with Unicode word boundaries, for a matcher whose ``\b`` and ``\d`` know ASCII only.

    Every alternative begins with a word character. After one that ends with another character, a boundary means that
    a word character follows. Patterns of another shape are returned as they are.
    """
    inner = re.fullmatch(r"\\b\((.*)\)\\b", pattern)
    if not inner:
        return pattern
    parts = [p.replace(r"\d", r"\p{Nd}") for p in inner.group(1).split("|")]
    open_end = [p for p in parts if p.endswith("/")]
    words = [p for p in parts if not p.endswith("/")]
    ends = f"(?:{'|'.join(words)})(?:$|{NO_WORD_CHAR})"
    if open_end:
        ends = f"(?:{ends}|(?:{'|'.join(open_end)}){WORD_CHAR})"
    return f"(?:^|{NO_WORD_CHAR}){ends}"


def literal(words: Sequence[str]) -> tuple[str, ...]:
    """Patterns that match words as plain substrings."""
    return tuple(re.escape(x) for x in words)


def any_of(patterns: Sequence[str]) -> str:
    return "|".join(f"(?:{whole_words(p)})" for p in patterns)


def match_mask(text: Column, groups: Sequence[Sequence[str]]) -> Column:
    """A BIGINT whose bit i is set if a pattern of group i is found. NULL texts give 0. At most 63 groups."""
    patterns = [any_of(g) for g in groups]
    if len(patterns) > 63:
        raise ValueError("at most 63 groups")

    @F.arrow_udf("bigint")
    def mask(texts: pa.Array) -> pa.Array:
        found = pa.array([0] * len(texts), pa.int64())
        for i, pattern in enumerate(patterns):
            hit = pc.fill_null(pc.match_substring_regex(texts, pattern=pattern), False)
            found = pc.add(found, pc.multiply(hit.cast(pa.int64()), pa.scalar(1 << i, pa.int64())))
        return found

    return mask(text)


def has_group(mask: Column, i: int) -> Column:
    return mask.bitwiseAND(F.lit(1 << i)) != 0
