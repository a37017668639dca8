"""What the plans of the operators may not hold."""

import re

from voc.llm import catalog, mixing, quality

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_operators_run_no_python(spark):
    for query in (catalog.op4_mixing, catalog.op5_quality):
        assert not re.search("Python|Pandas|MapInArrow", plan(query(spark, SF)))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert not re.search("Python|Pandas|MapInArrow", plan(quality.features(docs)) + plan(mixing.targets(docs.selectExpr("source as _source", "n_chars as source_size"))))


def test_no_plan_has_a_product_of_rows(spark):
    for query in catalog.QUERIES.values():
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(query(spark, SF))), query.__name__


def test_whole_tables_give_one_row_each(spark):
    docs, pages = (spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "pages"))
    for name, query in catalog.QUERIES.items():
        if name == "op12_phrases":   # ranks phrases
            continue
        assert query(spark, SF).count() == (pages if name == "op9_page_text" else docs), name
