"""Explicit schemas of every table that is read or passed between stages."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)

TEXT, INT, BIG, DOUBLE = StringType(), IntegerType(), LongType(), DoubleType()
TEXTS = ArrayType(TEXT)


def table(**columns: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


FEEDBACK = table(ord=BIG, id=TEXT, source=TEXT, text=TEXT, rating=DOUBLE, date=TEXT, upvotes=INT, url=TEXT)
CLEANED = StructType([*FEEDBACK.fields, StructField("cleaned_text", TEXT)])

# raw records; pos is the optional position in the load, written by our own landing sink
PLAY_RAW = table(pos=BIG, reviewId=TEXT, content=TEXT, score=INT, at=TEXT, thumbsUpCount=INT, repliedAt=TEXT)
APP_RAW = table(pos=BIG, userName=TEXT, review=TEXT, rating=INT, date=TEXT, review_id=TEXT)
REDDIT_RAW = table(
    pos=BIG, id=TEXT, subreddit=TEXT, text=TEXT, score=INT, url=TEXT, created_utc=BIG, type=TEXT
)

_LABEL = table(label=TEXT)
FEED_PAYLOAD = table(
    feed=table(entry=ArrayType(table(**{
        "id": _LABEL, "title": _LABEL, "content": _LABEL, "im:rating": _LABEL, "im:name": _LABEL,
        "author": table(name=_LABEL),
    })))
)
LIBRARY_REVIEW = table(userName=TEXT, title=TEXT, review=TEXT, rating=TEXT, date=TEXT, id=TEXT)
FORUM_PAYLOAD = table(
    data=ArrayType(table(
        id=TEXT, title=TEXT, selftext=TEXT, body=TEXT, subreddit=TEXT, score=INT, full_link=TEXT, permalink=TEXT,
        created_utc=BIG,
    ))
)

THEME = table(
    cluster_id=INT, theme=TEXT, primary_issue=TEXT, research_relevance=TEXT, evidence_summary=TEXT,
    observed_facts=TEXTS, observed_behavior=TEXT, behavioral_mechanism=TEXT, underlying_need=TEXT,
    barrier_or_driver=TEXT, business_impact=TEXT, confidence=TEXT, confidence_explanation=TEXT, signal_strength=TEXT,
    customer_journey_stage=TEXT, alternative_explanations=TEXTS, contradictory_evidence=TEXT,
    product_opportunity=TEXT, research_hypothesis=TEXT, research_questions=TEXTS, why_these_quotes_matter=TEXT,
    assumptions=TEXTS, reasoning_trace=TEXT, out_of_scope_reason=TEXT, example_quotes=TEXTS, frequency=BIG,
    prevalence_score=DOUBLE, signal_strength_score=DOUBLE, sources=TEXTS, sentiment=TEXT, action=TEXT,
)
THEME_COLUMNS = THEME.fieldNames()
RESULT_THEME = StructType([
    *THEME.fields,
    *table(status=TEXT, suggested_insight=TEXT, suggested_research_question=TEXT, relevance_reason=TEXT).fields,
])
RESULT_METADATA = table(
    total_feedback_analyzed=BIG, total_themes_discovered=BIG, promoted_research_questions_count=BIG,
    out_of_scope_themes_count=BIG, coverage_warning=TEXT,
)
RESULTS = table(metadata=RESULT_METADATA, themes=ArrayType(RESULT_THEME))

# a stored labelling reply; every field may be missing
REPLY = table(
    research_relevance=TEXT, relevance_reason=TEXT, primary_issue=TEXT, theme_name=TEXT, evidence_summary=TEXT,
    observed_facts=TEXTS, observed_behavior=TEXT, behavioral_mechanism=TEXT, underlying_need=TEXT,
    barrier_or_driver=TEXT, business_impact=TEXT, signal_strength=TEXT, customer_journey_stage=TEXT,
    alternative_explanations=TEXTS, product_opportunity=TEXT, research_hypothesis=TEXT, research_questions=TEXTS,
    why_these_quotes_matter=TEXT, assumptions=TEXTS, out_of_scope_reason=TEXT,
)
