"""Scores, confidence, actions and other expressions on theme rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voc import rules, wording as w
from voc.functions.text import contains_any, word_list


def round1(x: Column) -> Column:
    """A non-negative double rounded to one decimal by its exact binary value, ties to even.

    ``round`` and ``bround`` work on the shortest decimal text, so 0.35 (stored just below) would go up. The
    fraction times 2^57 is an exact integer for all values that can tie, so the comparison is done in BIGINT.
    """
    whole = F.floor(x)
    scaled = ((x - whole) * F.lit(float(2**57))).cast("bigint") * 10
    digit = F.shiftright(scaled, 57)
    rest = scaled - F.shiftleft(digit, 57)
    half = F.lit(2**56)
    up = (rest > half) | ((rest == half) & (digit % 2 == 1))
    return (whole * 10 + digit + F.when(up, 1).otherwise(0)) / F.lit(10.0)


def share(part: Column, total: Column) -> Column:
    """Percentage, evaluated as (part / total) * 100; 0 for an empty total."""
    return F.when(total > 0, part / total * 100).otherwise(F.lit(0.0))


def volume_score(count: Column, total: Column) -> Column:
    pct = share(count, total)
    return F.when(pct >= 10, 5.0).when(pct >= 6, 4.0).when(pct >= 3, 3.0).when(pct >= 1, 2.0).otherwise(1.0)


def prevalence(count: Column, total: Column, n_sources: Column) -> Column:
    """Volume score plus half a point per further source, at most 5."""
    return F.least(F.lit(5.0), volume_score(count, total) + (n_sources - 1) * 0.5)


def signal_strength(total_chars: Column, count: Column, pos_pct: Column, neg_pct: Column) -> Column:
    """Longer texts score higher; a point less if both moods exceed 30 %."""
    avg = total_chars / count
    base = F.when(avg >= 120, 4.5).when(avg >= 70, 3.5).otherwise(2.5)
    split_mood = F.when((pos_pct > 30) & (neg_pct > 30), 1.0).otherwise(0.0)
    return F.greatest(F.lit(1.0), F.least(F.lit(5.0), base - split_mood))


def dominant_sentiment(counts: dict[str, Column]) -> Column:
    """Name of the largest count; on a tie the earlier of ``rules.SENTIMENT_ORDER``."""
    order = rules.SENTIMENT_ORDER
    best = F.array_max(
        F.array(*[F.struct(counts[n].alias("n"), F.lit(-i).alias("rank")) for i, n in enumerate(order)])
    )
    return F.element_at(word_list(order), F.lit(1) - best["rank"])


def action(relevance: Column, prev: Column, signal: Column) -> Column:
    rel = F.upper(F.trim(relevance))
    return (
        F.when(rel == w.OUT, w.OUT_ACTION)
        .when((rel == w.DIRECT) & (prev >= 3) & (signal >= 3), w.PROMOTE)
        .when((rel == w.INDIRECT) | ((rel == w.DIRECT) & (prev >= 3)), w.MONITOR)
        .when(signal >= 3, w.NICHE)
        .otherwise(w.DROP)
    )


def percentile_prevalence(rank: Column, n_sources: Column) -> Column:
    """1 to 5 by the percent rank of the count: the top tenth in all three sources 5, the bottom fifth in one source 1."""
    return (
        F.when((rank >= 0.9) & (n_sources >= 3), 5.0).when((rank <= 0.2) & (n_sources <= 1), 1.0)
        .when(rank >= 0.7, 4.0).when(rank >= 0.4, 3.0).otherwise(2.0)
    )


def action_rank(col: Column) -> Column:
    ranks = F
    for i, name in enumerate(w.ACTION_ORDER, 1):
        ranks = ranks.when(col == name, i)
    return ranks.otherwise(99)


def confidence_level(count: Column, relevance: Column) -> Column:
    return (
        F.when((count >= w.HIGH_COUNT) & (relevance == w.DIRECT), "High")
        .when(count >= w.MEDIUM_COUNT, "Medium")
        .otherwise("Low")
    )


def confidence_text(level: Column, count: Column, sources: Column, opposing: Column) -> Column:
    known = F.size(sources) > 0
    n = F.when(known, F.size(sources)).otherwise(w.DEFAULT_SOURCE_COUNT).cast("string")
    names = F.when(known, F.concat_ws(", ", sources)).otherwise(w.DEFAULT_SOURCES)
    args = (n, names, count.cast("string"), opposing.cast("string"))
    return (
        F.when(level == "High", F.format_string(w.CONFIDENCE["High"], *args))
        .when(level == "Medium", F.format_string(w.CONFIDENCE["Medium"], *args))
        .otherwise(F.format_string(w.CONFIDENCE["Low"], *args))
    )


def reasoning_trace(facts: Column, theme: Column, relevance: Column) -> Column:
    """The first fact followed by the steps that belong to the theme's words."""
    low = F.lower(theme)
    steps = F
    for words, text in w.TRACES:
        steps = steps.when(contains_any(low, words), text)
    fact = F.coalesce(F.try_element_at(facts, F.lit(1)), F.lit(w.FIRST_FACT))
    return F.when(relevance == w.OUT, w.OUT_TRACE).otherwise(F.concat(fact, steps.otherwise(w.OTHER_TRACE)))


def with_defaults(columns, defaults: dict[str, str] = w.FIELD_DEFAULTS) -> list[Column]:
    """Each text column with its default for NULL; other columns unchanged."""
    return [F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in columns]


def evidence_quotes(quotes: Column, issue: Column) -> Column:
    """Up to three quotes that speak about the issue; the first three quotes if none does."""
    low_issue = F.lower(issue)

    def fits(quote: Column) -> Column:
        low = F.lower(quote)
        off_topic = contains_any(low, rules.OFF_TOPIC_QUOTES) | (
            low.contains(rules.OFF_TOPIC_FOR_AVAILABILITY) & low_issue.contains("availability")
        )
        by_issue = F.when(off_topic, F.lit(False))
        for issue_words, quote_words in rules.QUOTE_GROUPS:
            by_issue = by_issue.when(contains_any(low_issue, issue_words), contains_any(low, quote_words))
        return by_issue.otherwise(F.lit(True))

    kept = F.filter(quotes, fits)
    return F.slice(F.when(F.size(kept) > 0, kept).otherwise(quotes), 1, rules.KEPT_QUOTES)

