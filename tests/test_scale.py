"""What only shows on inputs larger or stranger than the given ones."""

import time

import pytest
from pyspark.sql import functions as F

from voc import rules
from voc.functions.text import below, redact
from voc.operators import clusters, feedback, near, pii, vectors
from voc.plans import theme_report
from voc.plans.feedback_view import feedback_view, table
from voc.schemas import APP_RAW, PLAY_RAW, REDDIT_RAW
from voc.settings import DEFAULT
from voc.sources import raw
from voc.storage import materialize

SF = "/root/testdata/sf0.001"


def test_positions_are_distinct_over_many_splits(spark):
    n, splits = 4_000, 200
    ids = spark.range(n).repartition(splits)
    play = ids.select(F.concat(F.lit("p"), "id").alias("reviewId"), F.concat(F.lit("play review number "), "id").alias("content"))
    app = ids.select(F.concat(F.lit("a"), "id").alias("review_id"), F.concat(F.lit("app review number "), "id").alias("review"))
    forum = ids.select(F.concat(F.lit("r"), "id").alias("id"), F.concat(F.lit("forum post number "), "id").alias("text"))

    def shaped(df, schema):
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    rows = feedback.unify([
        raw.play_feedback(shaped(play, PLAY_RAW)), raw.app_feedback(shaped(app, APP_RAW)), raw.reddit_feedback(shaped(forum, REDDIT_RAW)),
    ])
    rows = materialize(rows, "positions")
    ends = {r.source: (r.n, r.d, r.lo, r.hi) for r in rows.groupBy("source").agg(
        F.count("*").alias("n"), F.count_distinct("ord").alias("d"), F.min("ord").alias("lo"), F.max("ord").alias("hi")
    ).collect()}
    assert all((e[0], e[1]) == (n, n) for e in ends.values())
    assert ends["play_store"][3] < ends["app_store"][2] and ends["app_store"][3] < ends["reddit"][2]
    cleaned = rows.withColumns({"sub_domain": F.lit("x"), "cleaned_text": F.col("text")})
    picked = clusters.sampled_rows(cleaned)
    assert clusters.texts_of(cleaned, picked).count() == picked.count() == rules.SAMPLE_QUOTES


def test_a_position_that_does_not_fit_is_an_error(spark):
    with pytest.raises(Exception, match="not below"):
        spark.range(1).select(below(F.lit(2**60), 2**60)).collect()


def test_the_view_holds_every_character(spark):
    docs, view = table(spark, SF, "documents"), feedback_view(spark, SF)
    whole = view.where(F.col("id").rlike("^.._[0-9]")).select((F.col("ord") % rules.SOURCE_STRIDE).alias("doc_id"), F.col("text").alias("review"))
    both = docs.join(whole, "doc_id")
    assert both.where(F.col("review").endswith(F.col("text"))).count() == docs.count()
    assert view.select("ord").distinct().count() == view.count() > docs.count()


def test_no_row_limits_by_default():
    assert DEFAULT.play_limit is None and DEFAULT.app_store_limit is None


@pytest.mark.parametrize("line", ["x@y " + "n" * 1_000_000, "a." * 500_000, "a@" * 300_000, "1 " * 500_000])
def test_personal_data_is_found_in_linear_time(spark, line):
    df = spark.createDataFrame([(1, line)], "doc_id int, text string")
    start = time.time()
    df.select(F.length(redact(F.col("text"))).alias("n")).collect()
    pii.scan(df).count()
    assert time.time() - start < 15


def test_mail_matches_are_those_of_the_plain_pattern(spark):
    import random
    import re

    rng = random.Random(1)
    texts = ["".join(rng.choices(["a", "b", ".", "-", "@", "_", " ", "é", "1", ","], k=rng.randint(0, 30))) for _ in range(3_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    from voc.functions.text import EMAIL

    got = {r.doc_id: r.m for r in df.select("doc_id", F.regexp_extract_all("text", F.lit("(?U)" + EMAIL), F.lit(0)).alias("m")).collect()}
    assert all(got[i] == re.findall(rules.EMAIL, t) for i, t in enumerate(texts))


def test_near_copies(spark):
    base = " ".join(f"word{i}" for i in range(120))
    rows = [(1, base), (2, base + " end"), (3, base.replace("word60", "other")), (4, " ".join(f"else{i}" for i in range(50))), (5, "short text"), (6, "short text"), (7, None)]
    rows += [(100 + i, base + f" tail{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "ord bigint, cleaned_text string")
    gone = {r.ord for r in near.similar_to_earlier(df).collect()}
    assert gone == {2, 6, *range(100, 140)} | ({3} if 3 in gone else set()) and not gone & {1, 4, 5, 7}
    assert near.without_near_copies(df).count() == len(rows) - len(gone)


def test_near_copies_behind_unlike_earlier_rows(spark):
    words = [f"word{i}" for i in range(200)]
    # each lacks another tenth, so every band of the whole text has one of these as its earliest row, and all are under 0.9
    rows = [(k, " ".join(words[: 20 * k] + words[20 * k + 20 :])) for k in range(10)]
    rows += [(20, " ".join(words)), (21, " ".join([*words, "end"])), (22, " ".join(words)), (23, " ".join(["start", *words]))]
    df = spark.createDataFrame(rows, "ord bigint, cleaned_text string")
    assert {r.ord for r in near.similar_to_earlier(df).collect()} == {21, 22, 23}


def test_centroids_in_blocks(spark, monkeypatch):
    rows = [(i, [float(i % 7 + 1), float(i % 5), 1.0], i % 6) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, v array<float>, g int")
    one = sorted(map(tuple, vectors.centroid_distances(df, "id", "g", "v").collect()))
    monkeypatch.setattr(vectors, "CENTROID_BLOCK", 2)
    assert sorted(map(tuple, vectors.centroid_distances(df, "id", "g", "v").collect())) == one


def test_one_pattern_pass_and_no_text_sort(spark):
    fb = feedback_view(spark, SF)
    plan = theme_report.cleaned_feedback(fb, rules.theme_rules(DEFAULT))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "SortAggregate" not in plan
    for df in (feedback.ingest(fb), feedback.clean(fb)):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_uncertain_and_english(spark):
    df = spark.createDataFrame([
        (1, "late delivery but i always buy vegetables here"), (2, "nothing of any kind at all in this text"),
        (3, "the rider was late again and again"), (4, "fresh fruit at a good price"),
    ], "ord bigint, cleaned_text string")
    from voc.functions.classify import noise_state

    got = {r.ord: r.s for r in feedback.masked(df).select("ord", noise_state(F.col("mask")).alias("s")).collect()}
    assert got == {1: "uncertain", 2: "uncertain", 3: "noise", 4: "keep"}
    texts = spark.createDataFrame([(1, "this is the text of a review"), (2, "das ist ein Text"), (3, "")], "ord int, text string")
    assert [r.ord for r in feedback.english_rows(texts).collect()] == [1]


def test_word_lists_on_literal_examples():
    stop = rules.stop_words(DEFAULT)
    assert {"the", "app", "delivery", "very", "hai", "because", "themselves", "nor"} <= set(stop)
    assert not {"refund", "rotten", "payment", "milk"} & set(stop)


def test_near_copies_are_made_of_few_texts_at_once():
    import numpy as np
    import pyarrow as pa

    batch = pa.record_batch([pa.array(range(1000)), pa.array([f"t{i}" for i in range(1000)])], names=["ord", "text"])
    pieces = list(near._pieces([batch.slice(3), batch.slice(0, 0)]))
    assert max(p.num_rows for p in pieces) <= near.PIECE and pa.Table.from_batches(pieces).to_pylist() == batch.slice(3).to_pylist()
    found = [np.array([1, 2**64 - 1], np.uint64), np.zeros(0, np.uint64), np.array([7], np.uint64)]
    assert near._lists(found).to_pylist() == [[1, -1], [], [7]] and near._lists([]).to_pylist() == []


def test_near_copies_keep_no_sets_of_all_rows(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    kept, write = {}, near.written

    def written(df, name):
        out, path = write(df, name)
        kept.setdefault(name, []).append((out.columns, out.count()))
        return out, path

    monkeypatch.setattr(near, "written", written)
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60))) for i in range(50)]
    rows += [(100, rows[3][1] + " end"), (101, rows[3][1]), (102, "two words"), (103, "Two  words"), (104, None), (105, "")]
    df = spark.createDataFrame(rows, "ord bigint, cleaned_text string")
    assert sorted(r.ord for r in near.similar_to_earlier(df).collect()) == [100, 101, 103, 105]
    assert [n for columns, n in kept["signatures"] if "shingles" not in columns] == [56]
    assert all(n <= 8 for _, n in kept["near_sets"])
    # the bound by parts loses no pair, whatever the sizes
    rng = np.random.default_rng(5)
    pool = np.unique(rng.integers(0, 2**64, 70_000, dtype=np.uint64))
    sets = [rng.choice(pool, n, replace=False) for n in (1, 40, 400, 69_000)] + [pool]
    sets += [np.concatenate([s[: int(0.97 * len(s))], rng.integers(0, 2**64, 1, dtype=np.uint64)]) for s in sets]
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets))]
    columns = [[i for i, _ in pairs], [j for _, j in pairs], [len(sets[i]) for i, _ in pairs], [len(sets[j]) for _, j in pairs]]
    parts = [pa.array([near._parts(sets[p[k]]) for p in pairs], pa.binary()) for k in (0, 1)]
    batch = pa.record_batch([*map(pa.array, columns), *parts], names=["ord", "first", "n", "m", "parts", "other"])
    left = {tuple(r.values()) for r in next(near._possible(0.9)([batch])).to_pylist()}
    alike = {(i, j) for i, j in pairs if (c := len(np.intersect1d(sets[i], sets[j]))) >= 0.9 * (len(sets[i]) + len(sets[j]) - c)}
    assert alike <= left < set(pairs) and None in parts[0].to_pylist()
