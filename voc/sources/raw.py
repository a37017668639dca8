"""The three raw sources mapped to the feedback schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voc import rules
from voc.functions.text import below, raw_text
from voc.operators.feedback import unify
from voc.schemas import APP_RAW, FEEDBACK, PLAY_RAW, REDDIT_RAW
from voc.settings import DEFAULT, Settings
from voc.sources.files import read_json


def _feedback(df: DataFrame, source: str, key: Column, **fields: Column) -> DataFrame:
    """``ord`` = source rank * 2^60 + position in the load, which array files give by their order.

    A row number is split * 2^33 + row, so 2^27 splits of a source fit; a position that does not fit is an error.
    """
    position = below(F.coalesce(F.col("pos"), F.monotonically_increasing_id()), rules.SOURCE_STRIDE)
    fields |= {
        "ord": F.lit(rules.SOURCE_RANK[source] * rules.SOURCE_STRIDE) + position,
        "id": F.concat(F.lit(rules.SOURCE_PREFIX[source]), F.coalesce(key, F.lit(""))),
        "source": F.lit(source),
    }
    return df.select(*[fields[f.name].cast(f.dataType).alias(f.name) for f in FEEDBACK.fields])


def play_feedback(raw: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return _feedback(
        raw, "play_store", F.col("reviewId"), text=raw_text(F.col("content")), rating=F.coalesce("score", F.lit(0)),
        date=F.coalesce("at", F.lit("")), upvotes=F.coalesce("thumbsUpCount", F.lit(0)), url=F.lit(settings.play_url),
    )


def app_feedback(raw: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """A review without an id is named by its position."""
    numbered = raw.withColumn("pos", F.coalesce("pos", F.monotonically_increasing_id()))
    return _feedback(
        numbered, "app_store", F.coalesce(F.col("review_id"), F.col("pos").cast("string")),
        text=raw_text(F.col("review")), rating=F.coalesce("rating", F.lit(0)), date=F.coalesce("date", F.lit("")),
        upvotes=F.lit(0), url=F.lit(settings.app_store_url),
    )


def reddit_feedback(raw: DataFrame) -> DataFrame:
    return _feedback(
        raw, "reddit", F.col("id"), text=raw_text(F.col("text")), rating=F.lit(None),
        date=F.coalesce(F.col("created_utc").cast("string"), F.lit("")), upvotes=F.coalesce("score", F.lit(0)),
        url=F.coalesce("url", F.lit("")),
    )


def load_feedback(
    spark: SparkSession, play: str, app: str, reddit: str, settings: Settings = DEFAULT, array_files: bool = True
) -> DataFrame:
    """All chosen sources as one table; missing files and sources not chosen contribute nothing."""
    tables = {
        "play_store": lambda: play_feedback(read_json(spark, play, PLAY_RAW, array_files), settings),
        "app_store": lambda: app_feedback(read_json(spark, app, APP_RAW, array_files), settings),
        "reddit": lambda: reddit_feedback(read_json(spark, reddit, REDDIT_RAW, array_files)),
    }
    return unify([tables[s]() for s in rules.SOURCE_RANK if s in settings.sources])
