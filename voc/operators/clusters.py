"""Issue clusters: assignment, statistics, samples and sentiment. A cluster is an issue domain that occurs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voc import rules
from voc.functions.classify import issue_domain, opposing, sentiment
from voc.functions.scores import dominant_sentiment, percentile_prevalence, prevalence, round1, share, signal_strength
from voc.operators.feedback import masked, noise_flagged

def classify(df: DataFrame) -> DataFrame:
    """Adds issue domain, sentiment and length, so that statistics need not read the text."""
    return masked(df).withColumns({
        "sub_domain": issue_domain(F.col("mask")),
        "sentiment": sentiment(F.col("cleaned_text"), F.col("rating")),
        "chars": F.length("cleaned_text"),
    })


def cluster_ids(df: DataFrame) -> DataFrame:
    """Issue domains present with their number in alphabetical order, from 0."""
    present = df.select("sub_domain").distinct()
    return present.withColumn("cluster_id", F.dense_rank().over(Window.orderBy("sub_domain")) - 1)


def assign_clusters(df: DataFrame) -> DataFrame:
    """Cluster id on every row; the id table has at most one row per domain name, so it is broadcast."""
    return df.join(F.broadcast(cluster_ids(df)), "sub_domain").where(F.col("cluster_id") != -1)


def _evidence(i: int) -> Column:
    return opposing(F.col("mask"), i) & ~F.col("is_noise")


_GROUPS = range(len(rules.EVIDENCE_GROUPS))
SUMS = ("n", "chars", *rules.SENTIMENT_ORDER, *(f"e{i}_n" for i in _GROUPS))
FIRSTS = ("first_ord", *(f"e{i}_ord" for i in _GROUPS))


def source_stats(df: DataFrame, *more: str) -> DataFrame:
    """Counts and first rows per domain, source and ``more``: fixed-size numbers only, so that it is a hash aggregate.

    First texts are held as the ``ord`` of their row.
    """
    return noise_flagged(df).groupBy("sub_domain", "source", *more).agg(
        F.count("*").alias("n"),
        F.sum("chars").alias("chars"),
        *[F.count_if(F.col("sentiment") == m).alias(m) for m in rules.SENTIMENT_ORDER],
        *[F.count_if(_evidence(i)).alias(f"e{i}_n") for i in _GROUPS],
        F.min("ord").alias("first_ord"),
        *[F.min(F.when(_evidence(i), F.col("ord"))).alias(f"e{i}_ord") for i in _GROUPS],
    )


def merged_stats(stats: DataFrame, *more: str) -> DataFrame:
    """Rows of ``source_stats`` of any parts of a table, put together."""
    return stats.groupBy("sub_domain", "source", *more).agg(*[F.sum(c).alias(c) for c in SUMS], *[F.min(c).alias(c) for c in FIRSTS])


def domain_stats(per_source: DataFrame) -> DataFrame:
    """One row per cluster from one row per domain and source.

    ``total`` and the ``e*`` columns (counter-evidence: reviews found and first one, per phrase group) are the same on
    every row.
    """
    whole = Window.partitionBy()  # over at most one row per issue domain
    stats = per_source.groupBy("sub_domain").agg(
        *[F.sum(c).alias(c) for c in SUMS],
        F.min("first_ord").alias("cluster_ord"),
        F.transform(F.array_sort(F.collect_list(F.struct("first_ord", "source"))), lambda s: s["source"])
        .alias("sources"),
        *[F.min(f"e{i}_ord").alias(f"e{i}_ord") for i in _GROUPS],
    )
    return stats.withColumns({
        "cluster_id": F.dense_rank().over(Window.orderBy("sub_domain")) - 1,
        "total": F.sum("n").over(whole),
        **{f"e{i}_n": F.sum(f"e{i}_n").over(whole) for i in _GROUPS},
        **{f"e{i}_ord": F.min(f"e{i}_ord").over(whole) for i in _GROUPS},
    })


def cluster_stats(df: DataFrame) -> DataFrame:
    """One row per cluster with all counts the later steps need, in a single pass over the rows."""
    return domain_stats(source_stats(df))


def with_scores(stats: DataFrame) -> DataFrame:
    """Sentiment shares, dominant sentiment, prevalence and signal strength per cluster."""
    n = F.col("n")
    stats = stats.withColumns({f"{m}_pct": round1(share(F.col(m), n)) for m in rules.SENTIMENT_ORDER})
    stats = stats.withColumn("dominant", dominant_sentiment({m: F.col(m) for m in rules.SENTIMENT_ORDER}))

    def pct(mood: str) -> Column:
        return F.concat(F.col(f"{mood}_pct").cast("string"), F.lit(f"% {mood}"))

    return stats.withColumns({
        "sentiment": F.concat(
            F.col("dominant"), F.lit(" ("), F.concat_ws(", ", pct("negative"), pct("positive"), pct("neutral")),
            F.lit(")"),
        ),
        "prevalence_score": prevalence(n, F.col("total"), F.size("sources")),
        "signal_strength_score": signal_strength(F.col("chars"), n, F.col("positive_pct"), F.col("negative_pct")),
        "mixed_moods": (F.col("positive_pct") > 30) & (F.col("negative_pct") > 30),
    })


def percentile_scores(stats: DataFrame) -> DataFrame:
    """Prevalence by percentile among the clusters, beside the one by share."""
    rank = F.percent_rank().over(Window.orderBy("n"))  # over at most one row per issue domain
    return stats.withColumn("percent_rank", rank).withColumn(
        "percentile_score", percentile_prevalence(F.col("percent_rank"), F.size("sources"))
    )


def rank_stability(stats: DataFrame, sizes: tuple[int, ...] = rules.TOPIC_SIZES) -> DataFrame:
    """For each smallest cluster size: clusters left and the correlation of their ranks with those at the first size.

    Clusters below a size join the general one. All frames hold at most one row per domain and size.
    """
    ways = stats.select("sub_domain", "n", F.explode(F.array(*map(F.lit, sizes))).alias("size"))
    to = F.when(F.col("n") >= F.col("size"), F.col("sub_domain")).otherwise(rules.GENERAL_DOMAIN)
    kept = ways.groupBy("size", to.alias("sub_domain")).agg(F.sum("n").alias("n"))
    kept = kept.withColumn("rank", F.rank().over(Window.partitionBy("size").orderBy(F.desc("n"))))
    base = kept.where(F.col("size") == sizes[0]).select("sub_domain", F.col("rank").alias("base_rank"))
    both = kept.join(base, "sub_domain")
    same = both.groupBy("size").agg(F.corr("rank", "base_rank").alias("rank_correlation"))
    return kept.groupBy("size").agg(F.count("*").alias("clusters"), F.sum("n").alias("reviews")).join(same, "size")


def sample_key(seed: str, ord_col: str = "ord") -> Column:
    """A reproducible random sort key."""
    return F.md5(F.concat(F.col(ord_col).cast("string"), F.lit(f"|{seed}")))


def first_k(df: DataFrame, group: str, k: int, *order: Column | str) -> DataFrame:
    """The first k rows of every group, numbered in ``place``.

    Spark cuts each input partition to k rows per group before the shuffle (WindowGroupLimit). Pass narrow rows:
    they are sorted before the cut.
    """
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= k)


def sampled_rows(df: DataFrame, k: int = rules.SAMPLE_QUOTES, seed: str = rules.SAMPLE_SEED) -> DataFrame:
    """Keys of up to k random rows per cluster: ``sub_domain, ord, place``."""
    narrow = df.select("sub_domain", "ord", sample_key(seed).alias("key"))
    return first_k(narrow, "sub_domain", k, "key", "ord").drop("key")


def texts_of(df: DataFrame, picked: DataFrame) -> DataFrame:
    """The cleaned text of picked rows.

    ``picked`` is bounded by the operators it comes from (k rows per domain, one per phrase group), so it is broadcast.
    """
    return df.select("ord", "cleaned_text").join(F.broadcast(picked), "ord")
