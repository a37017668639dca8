"""Scores of any range of days from a table of daily counts, without the texts.

The state has one row per issue domain, source and day of what ``clusters.source_stats`` counts. States of different loads, or
of parts of a stream, are merged by adding them, so a state grows by days, not by reviews.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voc.operators import clusters


def daily_state(classified: DataFrame, day: Column) -> DataFrame:
    """The state of classified rows; rows without a day are left out."""
    return clusters.source_stats(classified.withColumn("day", day.cast("date")).filter("day is not null"), "day")


def merged_states(*states: DataFrame) -> DataFrame:
    rows = states[0]
    for more in states[1:]:
        rows = rows.unionByName(more)
    return clusters.merged_stats(rows, "day")


def scores_between(state: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """As ``clusters.with_scores`` of the rows from the first to the last day; both may be equal, no days give no rows."""
    days = state.filter(F.col("day").between(F.lit(first), F.lit(last)))
    return clusters.with_scores(clusters.domain_stats(clusters.merged_stats(days)))
