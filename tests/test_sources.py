import json

import pytest
from voc.operators import pii, vectors
from voc.plans import theme_report
from voc.plans.catalog import QUERIES
from voc.schemas import CLEANED, FEEDBACK
from voc.settings import Settings
from voc.sources import files, payloads, raw
from voc.streaming import flow

SF = "/root/testdata/sf0.001"


def test_array_files_and_missing_sources(spark, tmp_path):
    play = tmp_path / "play.json"
    play.write_text(json.dumps([
        {"reviewId": "a", "content": "  first text\n", "score": 5, "at": "2024-01-01 00:00:00", "thumbsUpCount": 2},
        {"content": None}, {"reviewId": "c", "content": "third"},
    ], indent=1))
    app = tmp_path / "app.json"
    app.write_text(json.dumps([{"review": "no id"}, {"review": "with id", "review_id": "r", "rating": 3}]))
    got = raw.load_feedback(spark, str(play), str(app), str(tmp_path / "none.json"), Settings(play_app_id="x.y"))
    assert got.schema.fieldNames() == FEEDBACK.fieldNames()
    rows = got.orderBy("ord").collect()
    assert [r.id for r in rows] == ["ps_a", "ps_", "ps_c", "as_0", "as_r"]
    assert [r.text for r in rows] == ["first text", "", "third", "no id", "with id"]
    assert [r.rating for r in rows] == [5.0, 0.0, 0.0, 0.0, 3.0]
    assert rows[0].url.endswith("id=x.y") and rows[3].ord == 2**60


def test_csv_keeps_text(spark, tmp_path):
    texts = ['say "hi", ok', "two\nlines", "", " outer blanks ", "back\\slash", None, "\\N not null"]
    data = [(i, f"id{i}", "reddit", t, None if i % 2 else 2.5, "", 1, "", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, CLEANED)
    files.write_csv(df, str(tmp_path / "csv"))
    back = files.read_csv(spark, str(tmp_path / "csv"), CLEANED).orderBy("ord").collect()
    assert [r.text for r in back] == texts and [r.rating for r in back] == [2.5, None] * 3 + [2.5]


def test_payloads(spark):
    feed = {"feed": {"entry": [
        {"im:name": {"label": "the app"}, "id": {"label": "0"}, "title": {"label": "t"}, "content": {"label": "c"}},
        {"id": {"label": "1"}, "title": {"label": "T"}, "content": {"label": "body"}, "im:rating": {"label": "4"}, "author": {"name": {"label": "u"}}},
        {"id": {"label": "2"}, "title": {"label": ""}, "content": {"label": " "}}, {"id": {"label": "3"}, "content": {"label": "only"}, "im:rating": {"label": "x"}},
    ]}}
    df = spark.createDataFrame([(0, json.dumps(feed))], "page bigint, payload string")
    got = payloads.feed_reviews(df).orderBy("pos").collect()
    assert [(r.review_id, r.review, r.rating, r.userName) for r in got] == [("1", "T - body", 4, "u"), ("3", "only", 0, "")]

    forum = {"data": [{"id": "1", "title": "A title", "selftext": "and a body"}, {"id": "2", "title": "short"},
                      {"id": "3", "body": "[removed]"}, {"id": "4", "body": "a comment long enough to stay"}]}
    df = spark.createDataFrame([(0, json.dumps(forum)), (1, json.dumps(forum))], "page bigint, payload string")
    items = payloads.forum_items(payloads.forum_posts(df), payloads.forum_comments(df)).collect()
    assert {r.id for r in items} == {"sub_1", "com_4"}
    assert next(r.text for r in items if r.id == "sub_1") == "A title\nand a body"


def test_pii_scan(spark):
    text = "\n".join([
        "mail a.b@mail.example.com now", "call +91 98765 43210", "date 2024-01-05 2024-01-06", "100% of 1234567890123",
        "id 1234567890123", "nothing here", "1-2-3-4-5-6", "@user",
    ])
    rows = pii.scan(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("line", "type_no", "place").collect()
    got = [(r.line, r.type, r.match) for r in rows]
    assert got == [
        (1, "email", "a.b@mail.example.com"), (1, "handle", "@mail"), (2, "phone", "+91 98765 43210"),
        (4, "long_numeric_id", "1234567890123"), (5, "phone", "1234567890123"), (5, "long_numeric_id", "1234567890123"), (8, "handle", "@user"),
    ]
    doc = json.loads(pii.gate_document(pii.scan(spark.createDataFrame([("see @me",)], "text string"))).first().document)
    assert doc == {"passed": False, "blockers_count": 1, "findings": [{"type": "handle", "match": "@me", "line": 1}]}
    clean = pii.gate(pii.scan(spark.createDataFrame([("fine",)], "text string"))).first()
    assert clean.passed and clean.blockers_count == 0


def test_encode_hook_and_centroids(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(130)], "ord bigint, cleaned_text string")
    out = vectors.encode(df, lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert out.count() == 130 and out.where("vector[1] = 1.0").count() == 130
    vecs = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 0.2], 0), (3, [0.0, 1.0], 1)], "id int, v array<float>, g int")
    got = {r.id: r.nearest for r in vectors.centroid_distances(vecs, "id", "g", "v").collect()}
    assert got == {1: 0, 2: 0, 3: 1}
    units = vectors.text_vectors(df).selectExpr("aggregate(vector, 0D, (a, x) -> a + x * x) as n").where("abs(n - 1) > 1e-4 and n > 0")
    assert units.count() == 0


@pytest.mark.parametrize("n, k", [(1, 4), (119, 4), (150, 5), (360, 12), (10**6, 12)])
def test_cluster_number(value, n, k):
    assert value(vectors.cluster_number, n=n) == k


def test_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    texts = ["rotten fruit in the box again", "rotten fruit in the  box again", "use my code for free recharge", "late delivery, guy never came", "short"]
    data = [(i, str(i), "reddit", t, None, str(1704067200 + i), 0, "") for i, t in enumerate(texts)]
    source = str(tmp_path / "in")
    spark.createDataFrame(data, FEEDBACK).write.parquet(source)
    stream = flow.first_copies(flow.classified_stream(spark.readStream.schema(FEEDBACK).parquet(source)))
    query = stream.writeStream.format("memory").queryName("copies").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        rows = spark.sql("select cleaned_text, sub_domain from copies").collect()
    finally:
        query.stop()
    assert [(r.cleaned_text, r.sub_domain) for r in rows] == [("rotten fruit in the box again", "Product Quality")]


def test_frequencies_sum_to_total(spark):
    from voc.plans.feedback_view import feedback_view

    fb = feedback_view(spark, SF)
    rows = theme_report.theme_table(theme_report.classified_feedback(fb)).collect()
    assert sum(r.frequency for r in rows) == rows[0].total == theme_report.classified_feedback(fb).count()


COMPARED = (
    "play_source", "feed_payload", "forum_payload", "csv_files", "noise_filtered", "cluster_signal", "topic_words", "rule_summary",
    "critic_rules", "themes_standing", "results_document", "pii_findings", "weekly_note", "last_messages",
)


@pytest.mark.parametrize("name", COMPARED)
def test_same_as_sql(spark, name):
    from compare import connect, differences
    from oracle.statements import STATEMENTS

    assert differences(QUERIES[name](spark, SF), connect(SF), STATEMENTS[name]) is None


def test_every_query_has_sql_or_a_reason():
    from oracle.statements import STATEMENTS

    # feature hashing, the clusters of k-means, a search of some cells only and density clusters have no counterpart in SQL
    assert set(QUERIES) - set(STATEMENTS) == {"text_vectors", "text_kmeans", "near_neighbours", "density_clusters"} and set(STATEMENTS) <= set(QUERIES)
