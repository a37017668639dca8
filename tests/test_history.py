import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from voc.operators import clusters, history, stability
from voc.schemas import FEEDBACK
from voc.streaming import flow

SOURCES = ("play_store", "app_store", "reddit")
TEXTS = ("refund for my order was denied again", "late delivery and the rider was rude to me", "handling fee is far too high here", "the app crashes at login every time")


def feedback(spark, n=240):
    rows = [
        (i, f"id{i}", SOURCES[i % 3], f"{TEXTS[i * 7 % 4]} number {i}", float(i % 6) or None, str(1704067200 + 3600 * 7 * i) if i % 11 else "", 0, "")
        for i in range(n)
    ]
    return spark.createDataFrame(rows, FEEDBACK)


def classified(spark):
    return flow.classified_stream(feedback(spark)).withColumn("event_ts", flow.event_time(F.col("date")))


def plain(df):
    return sorted(map(tuple, df.select("sub_domain", "n", "total", "sources", "sentiment", "prevalence_score", "signal_strength_score", "cluster_ord", "e0_n", "e0_ord").collect()))


def test_any_range_equals_the_batch(spark):
    rows = classified(spark)
    parts = [history.daily_state(rows.filter(F.col("ord") % 3 == i), F.col("event_ts")) for i in range(3)]
    state = history.merged_states(*parts)
    for first, last in ((1, 70), (5, 5), (10, 33), (60, 61)):
        a, b = dt.date(2024, 1, 1) + dt.timedelta(first - 1), dt.date(2024, 1, 1) + dt.timedelta(last - 1)
        batch = rows.filter(F.col("event_ts").cast("date").between(F.lit(a), F.lit(b)))
        want = plain(clusters.with_scores(clusters.cluster_stats(batch)))
        assert want and plain(history.scores_between(state, a, b)) == want
    assert history.scores_between(state, dt.date(2023, 1, 1), dt.date(2023, 1, 2)).collect() == []
    assert history.daily_state(rows.limit(0), F.col("event_ts")).collect() == []


def test_stream_gives_the_days_that_are_over(spark, tmp_path):
    source, sink, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    rows = feedback(spark)

    def run():
        stream = flow.daily_counts(flow.classified_stream(spark.readStream.schema(FEEDBACK).parquet(source)))
        query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", marks).trigger(availableNow=True).start()
        query.awaitTermination()

    for low, high in ((0, 80), (80, 150), (150, 240)):      # restarted from its checkpoint each time
        rows.filter(F.col("ord").between(low, high - 1)).coalesce(1).write.mode("append").parquet(source)
        run()
    got = spark.read.parquet(sink)
    batch = history.daily_state(classified(spark), F.col("event_ts"))
    over = got.agg(F.max("day")).first()[0]
    assert over >= dt.date(2024, 3, 5)
    columns = ("sub_domain", "source", "day", "n", "chars", "first_ord", "negative")
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, batch.filter(F.col("day") <= F.lit(over)).select(*columns).collect()))


def test_copies_are_poisson_and_differ_by_row_and_replicate(spark):
    rows = spark.range(4000).select("id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(19).cast("bigint"))).alias("r"))
    drawn = rows.select("id", "r", stability.copies(F.col("id") + F.lit(2**60), F.col("r")).alias("w")).toPandas().pivot(index="id", columns="r", values="w")
    values = drawn.to_numpy()
    assert abs(values.mean() - 1) < 0.02 and abs(values.var() - 1) < 0.03
    assert abs((values == 0).mean() - np.exp(-1)) < 0.01
    off = np.corrcoef(values.T) - np.eye(20)
    assert np.abs(off).max() < 0.08 and abs(np.corrcoef(values[:-1, 0], values[1:, 0])[0, 1]) < 0.08


def test_intervals_hold_the_shares(spark):
    rows = classified(spark).select("sub_domain", "source", "ord")
    got = stability.intervals(rows).collect()
    n = sum(r.n for r in got)
    assert n == rows.count() and [r for r in got if r.share_low <= r.share <= r.share_high and r.rank_low <= r.rank <= r.rank_high] == got
    for r in got:
        width = 100 * 1.96 * 2 * np.sqrt(r.n / n * (1 - r.n / n) / n)
        assert 0.6 * width < r.share_high - r.share_low < 1.5 * width
    assert sorted(map(tuple, got)) == sorted(map(tuple, stability.intervals(rows.repartition(7)).collect()))
    assert stability.intervals(rows.limit(0)).collect() == []


def test_replicates_are_drawn_without_a_row_for_each(spark):
    ords, replicates = np.array([0, 5, 2**31, 2**60 + 7, -3]), np.arange(20)
    rows = spark.createDataFrame([(int(o), int(r)) for o in ords for r in replicates], "ord bigint, r bigint")
    want = [r[0] for r in rows.coalesce(1).select(stability.copies(F.col("ord"), F.col("r"))).collect()]
    assert stability.copies_of(ords, replicates).ravel().tolist() == want
    some = spark.createDataFrame([("a", "x", 1), ("a", "x", None), ("b", "y", 2), (None, None, 3)], "sub_domain string, source string, ord bigint")
    assert "Generate" not in stability.intervals(some)._jdf.queryExecution().optimizedPlan().toString()
    assert {r.sub_domain: r.n for r in stability.intervals(some).collect()} == {"a": 2, "b": 1, None: 1}
