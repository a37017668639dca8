"""Scan for personal data, gate result, and redaction followed by a second scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voc import rules
from voc.functions.text import EMAIL, may_hold_pii, redact

# fixed value: the line boundaries of Unicode-aware line splitting
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def _found(line: Column, pattern: str) -> Column:
    return F.regexp_extract_all(line, F.lit("(?U)" + pattern), F.lit(0))


def _is_phone(line: Column):
    """Not a date, not a short dashed number, and not on a line with a percent sign."""

    def keep(match: Column) -> Column:
        short = match.contains("-") & (F.length(F.trim(F.replace(match, F.lit("-"), F.lit("")))) < 8)
        return ~match.rlike(rules.DATE_IN_PHONE) & ~short & ~line.contains("%")

    return keep


def _typed(no: int, name: str, found: Column) -> Column:
    return F.transform(found, lambda match, i: F.struct(
        F.lit(no).alias("type_no"), F.lit(name).alias("type"), match.alias("match"), (i + 1).cast("bigint").alias("place"),
    ))


def line_findings(line: Column) -> Column:
    """All findings of one line: type in scan order, match, position within its type."""
    phones = F.filter(_found(line, rules.PHONE), _is_phone(line))
    matches = (_found(line, EMAIL), phones, _found(line, rules.HANDLE), _found(line, rules.LONG_ID))
    return F.concat(*[_typed(no, name, found) for no, (name, found) in enumerate(zip(rules.PII_TYPES, matches))])


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per finding with its line (from 1). Texts and lines that cannot hold one go first."""
    keys = [c for c in df.columns if c != text]
    lines = df.where(may_hold_pii(F.col(text))).select(
        *keys, F.posexplode(F.split(F.col(text), LINE_BREAK)).alias("line", "line_text")
    )
    return (
        lines.where(may_hold_pii(F.col("line_text")))
        .select(*keys, (F.col("line") + 1).cast("bigint").alias("line"), F.inline(line_findings(F.col("line_text"))))
    )


def gate(findings: DataFrame) -> DataFrame:
    """Pass or fail with counts; the counts cover all findings and are summed before the shuffle."""
    by_type = [F.count_if(F.col("type") == t).alias(t) for t in rules.PII_TYPES]
    return findings.agg(F.count("*").alias("blockers_count"), *by_type).select(
        (F.col("blockers_count") == 0).alias("passed"), "blockers_count", *rules.PII_TYPES
    )


def gate_document(findings: DataFrame, *keys: str) -> DataFrame:
    """The gate result of one short text (a note), or of each text that has findings, as JSON in scan order."""
    ordered = F.array_sort(F.collect_list(F.struct("line", "type_no", "place", "type", "match")))
    listed = F.transform(ordered, lambda f: F.struct(f["type"].alias("type"), f["match"].alias("match"), f["line"].alias("line")))
    return findings.groupBy(*keys).agg(F.count("*").alias("n"), listed.alias("findings")).select(
        *keys, F.to_json(F.struct((F.col("n") == 0).alias("passed"), F.col("n").alias("blockers_count"), "findings")).alias("document")
    )


def redacted(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, redact(F.col(text)))
