import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from voc import rules
from voc.operators import clusters, extraction, feedback, keywords
from voc.plans import theme_report
from voc.settings import DEFAULT

STRIDE = rules.SOURCE_STRIDE


def make(spark, rows):
    """rows: (source, text, rating)"""
    data = [
        (rules.SOURCE_RANK[s] * STRIDE + i, f"{rules.SOURCE_PREFIX[s]}{i}", s, t, r, None, 0, "")
        for i, (s, t, r) in enumerate(rows)
    ]
    return spark.createDataFrame(
        data, "ord bigint, id string, source string, text string, rating double, date string, upvotes int, url string"
    )


def test_lengths_and_first_copy(spark):
    fb = make(spark, [
        ("reddit", "the same text twice here", None), ("play_store", "the same text twice here", 1.0),
        ("play_store", "x" * 10, 1.0), ("play_store", "y" * 11, 1.0), ("play_store", None, 1.0),
    ])
    rows = {r.text: r.source for r in feedback.ingest(fb).collect()}
    assert rows == {"the same text twice here": "play_store", "y" * 11: "play_store"}
    assert [r.source for r in feedback.clean(feedback.long_enough(fb)).collect()] == ["play_store"]


def test_clean_after_ingest_or_alone_is_the_same(spark):
    texts = ["rotten fruit in the box today", "rotten  fruit in the box today", "rotten fruit in the box today ",
             "use my code for free recharge now", "z" * 19, "z" * 20, "q www.link.example " + "w" * 30]
    fb = make(spark, [(s, t, 2.0) for t in texts for s in ("app_store", "play_store", "reddit")])
    key = lambda df: sorted((r.ord, r.cleaned_text) for r in df.collect())
    a, b = key(feedback.clean(feedback.ingest(fb))), key(feedback.clean(feedback.long_enough(fb)))
    assert a == b and len(a) == 3
    again = feedback.clean(feedback.clean(feedback.long_enough(fb)).drop("cleaned_text", "mask"))
    assert key(again) == a


def test_noise_fallback(spark):
    noise = make(spark, [("play_store", "late delivery, the guy never came", 1.0)])
    flagged = feedback.noise_flagged(feedback.clean(noise))
    assert flagged.where("is_noise").count() == 1
    assert feedback.drop_noise(flagged).count() == 1
    assert theme_report.classified_feedback(noise).count() == 1
    stats = clusters.cluster_stats(theme_report.classified_feedback(noise)).first()
    assert stats.n == 1 and stats.e0_n == 0


def test_noise_without_cleaned_text(spark):
    df = spark.createDataFrame([(1, "great app!!"), (2, "fresh fruit")], "ord bigint, text string")
    assert {r.ord: r.is_noise for r in feedback.noise_flagged(df).collect()} == {1: True, 2: False}


def test_limits_and_terms(spark):
    fb = make(spark, [("play_store", f"text number {i} about Quick Commerce", None) for i in range(5)]
              + [("reddit", "quick commerce app again", None)])
    assert feedback.limit_per_source(fb, {"play_store": 2}).count() == 3
    assert feedback.limit_per_source(fb, {"play_store": 0, "reddit": 1}).count() == 1
    assert feedback.limit_per_source(fb.repartition(4), {"play_store": 3, "reddit": 5}).count() == 4
    hits = feedback.search_terms(fb, ("quick commerce", "app"))
    assert hits.count() == 7
    found = hits.withColumn("found", F.struct("term_no", "ord"))
    assert feedback.first_per_id(found, "found").count() == 6


def test_hot_copies(spark):
    """A third of all rows are copies of one text; one row is left and its key is the smallest."""
    rows = spark.range(30000).select(
        F.col("id").alias("ord"), F.when(F.col("id") % 3 == 0, "one hot text that everybody posts").otherwise(
            F.concat(F.lit("a text of its own number "), F.col("id").cast("string"))).alias("text"),
        F.lit("play_store").alias("source"), F.lit(1.0).alias("rating"),
    )
    out = feedback.clean(feedback.long_enough(rows))
    assert out.count() == 20001
    assert out.where(F.col("text").startswith("one hot")).first().ord == 0


def test_cluster_stats_and_samples(spark):
    fb = make(spark, [("play_store", f"refund number {i} was denied for my order", 1.0) for i in range(12)]
              + [("reddit", "refund request was denied for my product", None), ("app_store", "handling fee on every small product", 5.0)])
    rows = theme_report.classified_feedback(fb)
    stats = {r.sub_domain: r for r in clusters.with_scores(clusters.cluster_stats(rows)).collect()}
    refunds = stats["Refunds & Returns"]
    assert (refunds.n, refunds.total, refunds.sources) == (13, 14, ["play_store", "reddit"])
    assert refunds.cluster_id == 1 and stats["Pricing & Fees"].cluster_id == 0
    assert refunds.sentiment == "negative (92.3% negative, 0.0% positive, 7.7% neutral)"
    assert refunds.prevalence_score == 5.0 and stats["Pricing & Fees"].prevalence_score == 4.0
    samples = clusters.sampled_rows(rows).groupBy("sub_domain").count().collect()
    assert {r.sub_domain: r["count"] for r in samples} == {"Refunds & Returns": 8, "Pricing & Fees": 1}
    assigned = clusters.assign_clusters(rows).select("sub_domain", "cluster_id").distinct().count()
    assert assigned == 2


def test_dominant_tie(spark):
    from voc.functions.scores import dominant_sentiment

    df = spark.createDataFrame([(1, 1, 1, 1), (0, 2, 2, 0), (0, 0, 0, 3)], "negative int, positive int, neutral int, mixed int")
    got = df.select(dominant_sentiment({m: F.col(m) for m in rules.SENTIMENT_ORDER}).alias("d")).collect()
    assert [r.d for r in got] == ["negative", "positive", "mixed"]


def test_keywords(spark):
    a, b = "Product Quality", "Payment Methods"
    df = spark.createDataFrame(
        [(a, 1, "milk milk bread the app"), (a, 2, "milk eggs"), (b, 3, "the a is")], "sub_domain string, ord bigint, cleaned_text string"
    )
    stop = rules.stop_words(DEFAULT)
    top = keywords.top_keywords(df, stop)
    lists = {r.sub_domain: r.keywords for r in keywords.keyword_lists(top, df.select("sub_domain").distinct()).collect()}
    assert lists == {a: ["milk", "bread", "eggs"], b: list(rules.EMPTY_KEYWORDS)}
    counts = {r.term: (r.tf, r.df) for r in keywords.term_counts(df, stop).collect()}
    assert counts == {"milk": (3, 2)}
    # a cluster is one text for the topic words: only terms of two clusters count
    assert keywords.topic_words(df, stop).count() == 0
    both = df.unionByName(spark.createDataFrame([(rules.GENERAL_DOMAIN, 4, "milk tea")], df.schema))
    assert {r.term for r in keywords.topic_words(both, stop).collect()} == {"milk"}


def test_terms_leave_a_task_once_a_chunk(spark, monkeypatch):
    rng = random.Random(7)
    names = [*rules.DOMAIN_NAMES[:3], None, "no such cluster"]
    rows = [(rng.choice(names), None if i % 17 == 0 else " ".join(rng.choices(["milk", "bread", "the", "eggs", "tea", "x"], k=i % 30))) for i in range(300)]
    df = spark.createDataFrame(rows, "sub_domain string, cleaned_text string").repartition(3)
    stop = {"the"}
    tf, texts, by_cluster = Counter(), Counter(), Counter()
    for name, text in rows:
        words = [w for w in (text or "").split() if len(w) > 1 and w not in stop]
        terms = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        tf.update(terms)
        texts.update(set(terms))
        by_cluster.update((name, t) for t in terms)
    expected = {t: (tf[t], n) for t, n in texts.items() if n >= 2}
    assert keywords._terms(df, stop).count() <= 3 * len(tf)   # 3 tasks; one row for each place before
    for chunk, sent in ((2 << 20, 100_000), (50, 3)):
        monkeypatch.setattr(keywords, "CHUNK_WORDS", chunk)
        monkeypatch.setattr(keywords, "SENT_ROWS", sent)
        assert {r.term: (r.tf, r.df) for r in keywords.term_counts(df, stop).collect()} == expected
        got = keywords.topic_words(df, stop, k=100).collect()
        common = {t for t in tf if sum(by_cluster[n, t] > 0 for n in names[:3]) >= 2}
        assert {(r.sub_domain, r.term): r.tf for r in got} == {(n, t): c for (n, t), c in by_cluster.items() if n in names[:3] and t in common}
    by_bytes = keywords._counted(pa.array([["b", "a", "b"], None, [], ["b"]], pa.list_(pa.string())), None).to_pylist()
    assert sorted((r["term"], r["tf"], r["df"]) for r in by_bytes) == [("a", 1, 1), ("a b", 1, 1), ("b", 3, 2), ("b a", 1, 1)]


def test_extraction_counts(spark):
    texts = [("no refund given, return policy is really bad and the price is higher than the mrp", 1.0),
             ("the refund was rejected and nobody helped me with it at all", 1.0),
             ("short one", 5.0), ("a longer sentence about nothing in particular, just words", None)]
    df = spark.createDataFrame([(i, "play_store", r, t) for i, (t, r) in enumerate(texts)],
                               "ord bigint, source string, rating double, cleaned_text string")
    theme_rules = rules.theme_rules(DEFAULT)
    tagged = extraction.tagged(df, theme_rules)
    counts = {r.theme_id: r for r in extraction.rule_counts(tagged, theme_rules).collect()}
    assert counts["B3"]["count"] == 2 and counts["B3"].pct_of_substantive == 66.7
    assert counts["B3"].rating_dist == {"1": 2} and counts["B1"]["count"] == 1
    assert [r.ord for r in extraction.unclassified(tagged).collect()] == [3]
    meta = extraction.extraction_meta(df).first()
    assert (meta.total_reviews, meta.substantive_reviews, meta.short_noise_discarded) == (4, 3, 1)
    assert extraction.unclassified_sample(tagged).count() == 1


def test_plan_has_one_shuffle_and_group_limits(spark):
    fb = make(spark, [("play_store", f"refund number {i} was denied for my order", 1.0) for i in range(9)]).repartition(8)
    plan = theme_report.cleaned_feedback(fb)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(cleaned_text") == 1
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    rows = theme_report.classified_feedback(fb)
    sample = clusters.sampled_rows(rows)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in sample and "cleaned_text" not in sample.split("ReadSchema")[1]
