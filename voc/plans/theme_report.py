"""The whole way from loaded feedback to ranked themes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voc import rules
from voc.functions.text import word_list
from voc.operators import clusters, feedback, keywords, themes
from voc.settings import DEFAULT, Settings
from voc.storage import materialize, spread


# what the analysis reads; the raw text and other columns do not travel through the shuffle
COLUMNS = ("ord", "source", "rating", "cleaned_text", "mask")


def _raw(fb: DataFrame) -> DataFrame:
    return feedback.long_enough(fb).select("ord", "source", "rating", "text")


def cleaned_feedback(fb: DataFrame, theme_rules=()) -> DataFrame:
    """Clean rows with noise flag, issue domain and sentiment: one shuffle, on the cleaned text.

    Besides the text only numbers go through the deduplication, the source as its rank: a hash aggregate.
    """
    ranks = F.create_map(*[F.lit(x) for kv in rules.SOURCE_RANK.items() for x in kv])
    rank = F.coalesce(F.element_at(ranks, F.col("source")), F.raise_error(F.concat(F.lit("unknown source: "), "source")))
    name = F.element_at(word_list(rules.SOURCE_RANK), F.col("source") + 1)
    rows = feedback.cleaned_rows(spread(_raw(fb)), theme_rules).select(*COLUMNS).withColumn("source", rank.cast("int"))
    first = feedback.keep_first(rows, "cleaned_text").withColumn("source", name)
    return clusters.classify(feedback.noise_flagged(first))


def classified_feedback(fb: DataFrame, theme_rules=()) -> DataFrame:
    """Clean, noise-free rows from a table written once: texts are cleaned, matched and shuffled one time."""
    return feedback.drop_noise(materialize(cleaned_feedback(fb, theme_rules), "classified"))


@dataclass(frozen=True)
class ClusterTables:
    rows: DataFrame      # classified feedback, written once
    stats: DataFrame     # one row per cluster, with scores and counter-evidence
    samples: DataFrame   # sub_domain, sample_quotes
    keywords: DataFrame  # sub_domain, keywords


def cluster_tables(rows: DataFrame, settings: Settings = DEFAULT) -> ClusterTables:
    """From written rows: statistics, samples, keywords and look-ups read only their columns."""
    sampled = clusters.sampled_rows(rows)
    # at most one row per domain; written too, because three later steps start from it
    stats = materialize(clusters.with_scores(clusters.cluster_stats(rows)), "cluster_stats")
    # one look-up for all texts that are shown: eight per domain and one per phrase group
    wanted = sampled.unionByName(themes.evidence_rows(stats), allowMissingColumns=True)
    texts = materialize(clusters.texts_of(rows, wanted), "texts")
    stats = themes.with_evidence_texts(stats, texts)
    samples = themes.sample_lists(texts)
    top = keywords.top_keywords(rows, rules.stop_words(settings))
    return ClusterTables(rows, stats, samples, keywords.keyword_lists(top, stats))


def theme_table(rows: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Ranked, consolidated themes of written rows, with insights and the total number of reviews on every row.

    At most one row per domain, written once: every report reads them several times.
    """
    t = cluster_tables(rows, settings)
    labels = themes.heuristic_labels(t.stats, t.samples, t.keywords, settings)
    merged = themes.merge_standing_themes(themes.merge_same_names(themes.scored_themes(labels)))
    return materialize(themes.with_insights(themes.ranked(merged), settings), "themes")


def domain_prevalence(fb: DataFrame) -> DataFrame:
    """Reviews, share and prevalence score per issue domain."""
    stats = clusters.with_scores(clusters.cluster_stats(classified_feedback(fb)))
    return stats.select(
        "cluster_id", "sub_domain", "n", "total", F.concat_ws(",", F.array_sort("sources")).alias("sources"),
        F.size("sources").cast("bigint").alias("n_sources"), "prevalence_score",
    )
