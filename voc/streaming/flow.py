"""The stateless steps, deduplication and daily counts on a streaming feedback table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voc.functions.text import event_time
from voc.operators.clusters import classify, source_stats
from voc.operators.feedback import cleaned_rows, long_enough, noise_flagged


def classified_stream(feedback: DataFrame) -> DataFrame:
    """Cleaned, spam-free and noise-free rows with issue domain and sentiment; row by row, without state."""
    return classify(noise_flagged(cleaned_rows(long_enough(feedback))).where(~F.col("is_noise")))


def first_copies(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Copies of a cleaned text dropped while they arrive within the delay; older state is given up."""
    timed = stream.withColumn("event_ts", event_time(F.col("date"))).withWatermark("event_ts", delay)
    return timed.dropDuplicatesWithinWatermark(["cleaned_text"])


def daily_counts(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Rows of ``history.daily_state`` from a classified stream, each once its day is over for longer than the delay.

    Rows that come later than that are dropped; without a date they are never counted.
    """
    timed = stream.withColumn("event_ts", event_time(F.col("date"))).withWatermark("event_ts", delay)
    days = source_stats(timed.withColumn("span", F.window("event_ts", "1 day")), "span")
    return days.withColumn("day", F.col("span.start").cast("date")).drop("span")
