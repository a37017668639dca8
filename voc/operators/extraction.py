"""Multi-label theme extraction by pattern rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voc import rules
from voc.functions.classify import matching_rules
from voc.functions.scores import round1
from voc.functions.text import cut
from voc.operators.clusters import first_k, sample_key
from voc.operators.feedback import masked

ALL_ROWS = "*"


def substantive(df: DataFrame) -> DataFrame:
    return df.where(F.length("cleaned_text") > rules.MIN_SUBSTANTIVE_CHARS)


def tagged(df: DataFrame, theme_rules) -> DataFrame:
    """Substantive rows with the ids of all rules they match; every pattern is tried once per row.

    A ``mask`` the rows bring along must have been made with these rules.
    """
    rows = masked(substantive(df), theme_rules)
    return rows.withColumn("theme_ids", matching_rules(F.col("mask"), theme_rules)).drop("mask")


def with_rule(rows: DataFrame, theme_rules) -> DataFrame:
    """Label and class of ``theme_id`` from the fixed rule table."""
    facts = F.create_map(*[
        x for r in theme_rules
        for x in (F.lit(r.theme_id), F.struct(F.lit(r.label).alias("label"), F.lit(r.kind).alias("class")))
    ])
    rule = F.element_at(facts, F.col("theme_id"))
    return rows.withColumns({"label": rule["label"], "class": rule["class"]})


def labelled(tagged_rows: DataFrame, theme_rules) -> DataFrame:
    """One row per row and matching rule."""
    return with_rule(tagged_rows.withColumn("theme_id", F.explode("theme_ids")).drop("theme_ids"), theme_rules)


def unclassified(tagged_rows: DataFrame) -> DataFrame:
    return tagged_rows.where(F.size("theme_ids") == 0).drop("theme_ids")


def rating_key(col: str = "rating"):
    """Whole ratings as text; no rating is the empty text."""
    return F.coalesce(F.col(col).cast("int").cast("string"), F.lit(""))


def rule_counts(tagged_rows: DataFrame, theme_rules) -> DataFrame:
    """Per theme: reviews, share of substantive reviews, rating histogram. Ordered columns for ranking included.

    The first aggregate is per theme and rating; the second one sees at most rules x ratings rows.
    """
    # one extra id counts the rows themselves, in the same pass
    ids = F.explode(F.concat("theme_ids", F.array(F.lit(ALL_ROWS)))).alias("theme_id")
    per_rating = tagged_rows.select(ids, rating_key().alias("rating")).groupBy("theme_id", "rating").agg(
        F.count("*").alias("n")
    )
    rows = F.sum(F.when(F.col("theme_id") == ALL_ROWS, F.col("n"))).over(Window.partitionBy())
    counted = per_rating.withColumn("rows", rows).where(F.col("theme_id") != ALL_ROWS)
    order = F.create_map(*[x for i, r in enumerate(theme_rules) for x in (F.lit(r.theme_id), F.lit(i))])
    return (
        with_rule(counted, theme_rules)
        .groupBy("theme_id", "label", "class")
        .agg(
            F.sum("n").alias("count"),
            F.max("rows").alias("rows"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("rating", "n")))).alias("rating_dist"),
        )
        .withColumns({
            "pct_of_substantive": round1(F.col("count") * 100 / F.col("rows")),
            "rule_no": F.element_at(order, F.col("theme_id")),
        })
        .drop("rows")
    )


def rule_quotes(tagged_rows: DataFrame, k: int = rules.RULE_QUOTES) -> DataFrame:
    """The first k texts of each theme in load order, cut to a fixed length: ``theme_id, place, quote``.

    Only keys are sorted; texts are fetched for the picked rows (at most k per rule, hence the broadcast).
    """
    keys = tagged_rows.select("ord", F.explode("theme_ids").alias("theme_id"))
    picked = first_k(keys, "theme_id", k, "ord")
    quote = cut(F.col("cleaned_text"), rules.RULE_QUOTE_CHARS).alias("quote")
    return tagged_rows.select("ord", "cleaned_text").join(F.broadcast(picked), "ord").select("theme_id", "place", quote)


def unclassified_sample(tagged_rows: DataFrame, k: int = rules.UNCLASSIFIED_SAMPLE, seed: str = rules.UNCLASSIFIED_SEED) -> DataFrame:
    """k random rows without any theme (a sampling operator: top k by a hashed key, kept per task)."""
    return unclassified(tagged_rows).orderBy(sample_key(seed), "ord").limit(k)


def extraction_meta(df: DataFrame) -> DataFrame:
    """Total, substantive and short reviews, and reviews per source."""
    long = F.length("cleaned_text") > rules.MIN_SUBSTANTIVE_CHARS
    return df.agg(
        F.count("*").alias("total_reviews"),
        F.count_if(long).alias("substantive_reviews"),
        F.count_if(~long).alias("short_noise_discarded"),
        *[F.count_if(F.col("source") == s).alias(s) for s in rules.SOURCE_RANK],
    )


def extraction_document(df: DataFrame, tagged_rows: DataFrame, theme_rules) -> DataFrame:
    """The whole extraction as one JSON text; holds at most one entry per rule."""
    quotes = rule_quotes(tagged_rows).groupBy("theme_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "quote"))), lambda s: s["quote"]).alias("sample_quotes")
    )
    entry = F.struct(
        F.struct(-F.col("count"), "rule_no").alias("key"), "class",
        F.struct("theme_id", "label", F.col("class").alias("classification"), "count", "pct_of_substantive",
                 "rating_dist", "sample_quotes").alias("entry"),
    )
    themes = rule_counts(tagged_rows, theme_rules).join(quotes, "theme_id").agg(
        F.array_sort(F.collect_list(entry), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1)).alias("all")
    )

    def of(kind: str):
        return F.transform(F.filter("all", lambda e: e["class"] == kind), lambda e: e["entry"])

    meta = extraction_meta(df).select(F.struct(
        "total_reviews", "substantive_reviews", "short_noise_discarded",
        F.struct(*rules.SOURCE_RANK).alias("source_coverage"),
    ).alias("meta")).scalar()
    rest = unclassified(tagged_rows).agg(F.count("*").alias("n")).scalar()
    return themes.select(
        F.to_json(F.struct(
            meta.alias("meta"),
            of("behavioral").alias("behavioral_themes"),
            of("operational").alias("operational_themes"),
            rest.alias("unclassified_count"),
        )).alias("document")
    )
