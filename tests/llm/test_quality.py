import re
from collections import Counter

from pyspark.sql import functions as F

from voc.llm import quality

from .conftest import prose


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (
        len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed,
    )


def test_counts_equal_brute_force(spark, odd_docs, odd_rows):
    extra = ["a b c a b c", "x x x x", "#a |b *c\n\n#a |b *c\n \n", "one\rtwo\x0bthree\x0cfour\tfive", "a b c", "q w e r q w e"]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(900 + i, t) for i, t in enumerate(extra)], "doc_id bigint, text string"))
    got = quality.judged(docs).select("doc_id", *quality.COUNTS, "base_failed").collect()
    expected = [(r[0], *counts(r[1])) for r in odd_rows] + [(900 + i, *counts(t)) for i, t in enumerate(extra)]
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


def test_rules_are_weighed_and_clean_texts_kept(spark):
    clean = [(i, prose(i, 120), True) for i in range(300)]
    junk = [(1000 + i, " ".join(w + "$$$" for w in prose(i, 80).split()), False) for i in range(25)]
    loud = [(2000 + i, " ".join(w.upper() + "!!" for w in prose(i, 80).split()), False) for i in range(25)]
    table = [(3000 + i, " | ".join(prose(i, 80).split()), False) for i in range(25)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in clean + junk + loud + table], "doc_id bigint, text string")
    kept = {r["doc_id"]: r["kept"] for r in quality.judged(docs, ["doc_id"]).collect()}
    assert all(kept[d] == good for d, _, good in clean + junk + loud + table)


def test_estimates_recover_planted_accuracies(spark):
    names = [f"v_{n}" for n in quality.RULES]
    planted = spark.range(40_000).select(
        (F.rand(1) < 0.85).alias("good"), *[F.rand(10 + i).alias(n) for i, n in enumerate(names)]
    ).select(*[
        F.when(F.col("good"), F.when(F.col(n) < 0.8, 1).when(F.col(n) > 0.98, -1).otherwise(0))
        .otherwise(F.when(F.col(n) < 0.4, 1).when(F.col(n) > 0.6, -1).otherwise(0)).alias(n) for n in names
    ])
    model = quality.estimate(planted.groupBy(*names).count())
    assert abs(model.good - 0.85) < 0.02
    assert all(abs(r - 0.8 / 0.82) < 0.01 for r in model.right_on_good)
    assert all(abs(r - 0.5) < 0.05 for r in model.right_on_bad)


def test_columns_come_back_and_an_empty_table_is_empty(odd_docs, no_docs):
    out = quality.good_documents(odd_docs)
    assert out.schema.names == odd_docs.schema.names
    assert {r["copies"] for r in out.collect()} == {"b"}
    assert quality.good_documents(no_docs).collect() == []
