from collections import defaultdict

from pyspark.sql import functions as F

from voc.llm import line_templates as lt

from .conftest import prose


def brute(rows):
    """Remaining texts by dictionaries over all lines."""
    docs, first, need, held = defaultdict(int), {}, {}, []
    for row, (doc_id, text) in enumerate(rows):
        order = 2**63 - 1 if doc_id is None else doc_id
        seen = set()
        for at, line in enumerate((text or "").encode().split(b"\n")):
            for key, constant in lt.templates(lt.masked(line)):
                held.append((row, at, key, order))
                need[key] = max(need.get(key, 0), lt.LONG_DOCS if constant >= lt.LONG else lt.SHORT_DOCS)
                first[key] = min(order, first.get(key, order))
                docs[key] += key not in seen
                seen.add(key)
    gone = {(row, at) for row, at, key, order in held if docs[key] >= need[key] and order != first[key]}
    out = []
    for row, (doc_id, text) in enumerate(rows):
        lines = text.split("\n") if text else []
        left = "\n".join(x for at, x in enumerate(lines) if (row, at) not in gone)
        out.append((doc_id, None if text is None else left, len(lines), sum((row, at) in gone for at in range(len(lines)))))
    return sorted(out, key=repr)


LONG = "passage of words " * 20 + "that many documents share without any change at all"
CASES = (
    [(i, f"{prose(i, 60)}\nPage {i} of 300 printed 2024-01-{i:02}\n{prose(i + 500, 30)}") for i in range(20)]
    + [(100 + i, f"{prose(100 + i, 40)}\n{LONG}") for i in range(3)]
    + [(200 + i, f"Dear reader number this letter was sent by {n} {n}son of our office on a quiet day in the spring with all regards") for i, n in enumerate(("Anna", "Bert", "Carl"))]
    + [(300, prose(300, 90)), (301, "Les."), (302, "Les."), (None, LONG), (310, None), (303, ""), (304, "a\n\n\na")]
)


def test_equals_brute_force(spark, odd_docs, odd_rows):
    docs = spark.createDataFrame(CASES, "doc_id bigint, text string").union(odd_docs.select("doc_id", "text"))
    got = lt.deduplicated(docs).select("doc_id", "text", "_lines", "_dropped").collect()
    assert sorted(map(tuple, got), key=repr) == brute(CASES + [(r[0], r[1]) for r in odd_rows])


def test_what_recurs_is_dropped_and_the_rest_stays(spark):
    docs = spark.createDataFrame(CASES, "doc_id bigint, text string")
    out = {(r["doc_id"], r["_dropped"]): r["text"] for r in lt.deduplicated(docs).collect()}
    assert all(out[i, int(i > 0)].count("Page") == int(i == 0) for i in range(20))   # numbers are variable fields
    assert LONG in out[100, 0] and LONG not in out[101, 1] and LONG not in out[102, 1]
    assert "Anna" in out[200, 0] and out[201, 1] == "" and out[202, 1] == ""          # one variable stretch
    assert out[300, 0] == prose(300, 90) and out[302, 0] == "Les."


def test_a_template_of_a_third_of_all_rows(spark):
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the very same line of twelve words in a third of all documents here\nown"), F.when(F.col("id") % 3 == 0, "").otherwise(F.col("id").cast("string"))).alias("text"))
    out = lt.deduplicated(docs)
    assert out.agg(F.sum("_dropped")).first()[0] == 2_999


def test_columns_come_back(odd_docs, no_docs):
    out = lt.without_recurring_lines(odd_docs.withColumn("_row", F.lit(1)))
    assert out.columns == [*odd_docs.columns, "_row"] and out.count() == odd_docs.count()
    assert out.filter("text is not null and n_chars != length(text)").count() == 0
    assert lt.without_recurring_lines(no_docs).collect() == []
