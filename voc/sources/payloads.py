"""Landed service payloads flattened to raw records.

Input: a table with ``page BIGINT`` (order of arrival) and ``payload STRING`` (JSON).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voc import rules
from voc.functions.text import below, strip, title_and_body
from voc.operators.feedback import first_per_id, unify
from voc.schemas import FEED_PAYLOAD, FORUM_PAYLOAD, LIBRARY_REVIEW

# entries of one page keep their order below this stride; pages below 2^39 leave room for posts and comments
PAGE_STRIDE = 2**20


def _entries(payloads: DataFrame, schema, path: str) -> DataFrame:
    parsed = payloads.withColumn("body", F.from_json("payload", schema))
    return parsed.select(
        "page", F.posexplode(F.col(f"body.{path}")).alias("i", "e")
    ).withColumn("pos", below(F.col("page"), 2**39) * PAGE_STRIDE + below(F.col("i"), PAGE_STRIDE))


def _rating(col: Column) -> Column:
    return F.coalesce(strip(col).try_cast("int"), F.lit(0))


def _app_record(user: Column, title: Column, body: Column, rating: Column, date: Column, key: Column) -> list[Column]:
    return [
        F.coalesce(user, F.lit("")).alias("userName"), strip(title_and_body(title, body)).alias("review"),
        rating.alias("rating"), F.coalesce(date, F.lit("")).alias("date"), F.coalesce(key, F.lit("")).alias("review_id"),
    ]


def feed_reviews(payloads: DataFrame) -> DataFrame:
    """Review feed: labels unwrapped, the entry that describes the app itself skipped, empty reviews dropped."""
    rows = _entries(payloads, FEED_PAYLOAD, "feed.entry").where(F.col("e").isNotNull() & F.col("e.`im:name`").isNull())
    return rows.select("pos", *_app_record(
        F.col("e.author.name.label"), F.col("e.title.label"), F.col("e.content.label"),
        _rating(F.col("e.`im:rating`.label")), F.lit(""), F.col("e.id.label"),
    )).where(F.col("review") != "")


def library_reviews(payloads: DataFrame) -> DataFrame:
    """Review objects of the client library, one per payload."""
    rows = payloads.select(F.col("page").alias("pos"), F.from_json("payload", LIBRARY_REVIEW).alias("e"))
    return rows.select("pos", *_app_record(
        F.col("e.userName"), F.col("e.title"), F.col("e.review"), _rating(F.col("e.rating")), F.col("e.date"), F.col("e.id"),
    )).where(F.col("review") != "")


def _forum_record(prefix: str, kind: str, text: Column, url: Column) -> list[Column]:
    return [
        F.concat(F.lit(prefix), F.coalesce("e.id", F.lit(""))).alias("id"),
        F.coalesce("e.subreddit", F.lit("")).alias("subreddit"), text.alias("text"),
        F.coalesce("e.score", F.lit(0)).alias("score"), url.alias("url"),
        F.coalesce("e.created_utc", F.lit(0)).alias("created_utc"), F.lit(kind).alias("type"),
    ]


def forum_posts(payloads: DataFrame) -> DataFrame:
    """Submissions: title and body on two lines, more than 15 characters; the address is built if it is missing."""
    e = F.col("e")
    text = strip(F.concat(F.coalesce(e["title"], F.lit("")), F.lit("\n"), F.coalesce(e["selftext"], F.lit(""))))
    built = F.concat(
        F.lit("https://reddit.com/r/"), F.coalesce(e["subreddit"], F.lit("")), F.lit("/comments/"), F.coalesce(e["id"], F.lit(""))
    )
    rows = _entries(payloads, FORUM_PAYLOAD, "data")
    return rows.select("pos", *_forum_record("sub_", "post", text, F.coalesce(e["full_link"], built))).where(
        F.length("text") > rules.MIN_POST_CHARS
    )


def forum_comments(payloads: DataFrame) -> DataFrame:
    """Comments of more than 20 characters that were not removed."""
    e = F.col("e")
    text = strip(F.coalesce(e["body"], F.lit("")))
    url = F.concat(F.lit("https://reddit.com"), F.coalesce(e["permalink"], F.lit("")))
    rows = _entries(payloads, FORUM_PAYLOAD, "data")
    return rows.select("pos", *_forum_record("com_", "comment", text, url)).where(
        (F.length("text") > rules.MIN_COMMENT_CHARS) & ~F.col("text").isin(*rules.REMOVED_COMMENTS)
    )


def forum_items(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Posts before comments of the same page, each id once."""
    place = F.col("pos") * 2
    both = unify([posts.withColumn("pos", place), comments.withColumn("pos", place + 1)])
    return first_per_id(both, order="pos")


def play_records(reviews: DataFrame) -> DataFrame:
    """Store reviews with their date-times written as text, as they are landed."""
    as_text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return reviews.select(*[as_text(c) if c in ("at", "repliedAt") else F.col(c) for c in reviews.columns])
