"""Inputs for the registered queries, derived row by row from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voc.plans.feedback_view import table

# fixed values: names and wordings the rules react to, picked by remainder
THEME_NAMES = (
    "Constitution Book Availability", "Monster drink shortage", "iPhone stock", "Refund quality doubts",
    "Trust in refund promises", "Return process", "Low Trust in High-Value Purchases",
    "Assortment Gaps in Long-Tail Categories", "Delivery time drift", "Coupon support gaps", "Surge fee at checkout",
    "Payment by COD", "Login trouble", "Limited choice of brands", "General Service Delivery Feedback",
    "Earphone refund wait", "Niche selection", "Late night charge", "Search results", "Fresh variety",
    "Risk of wrong size", "Returns take long", "Refund Risk", "Checkout value",
)
ISSUES = (
    "Refunds / Returns", "Assortment", "Delivery Experience", "Pricing / Fees", "Payment Methods", "Product Quality",
    "Discovery / Search", "Availability", "App Performance", "Trust / Risk", "Other", "Pricing",
)
MECHANISMS = (
    "", "May contribute to churn", "Could influence trial", " Users lose trust after a loss ",
    "Slow delivery breaks habits", "Payment uncertainty stops orders", "Poor quality is remembered",
)
RELEVANCES = ("DIRECT", "INDIRECT", "OUT_OF_SCOPE", " direct ", "indirect", "OTHER")
SCORES = (1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0)
SOURCE_LISTS = ((), ("play_store",), ("play_store", "reddit"), ("play_store", "app_store", "reddit"))
QUOTE_WORDS = (
    "refund rejected", "rotten fruit", "cod charge", "late driver", "out of stock item", "kaggle roadmap",
    "bring more healthy options", "nothing of note", "money back", "auction fee",
)


def pick(values, index: Column) -> Column:
    """The value at a remainder of a number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One proposed theme per document, with the columns the critic rules need."""
    d, n = F.col("doc_id"), F.col("n_chars")
    lists = F.array(*[F.array(*map(F.lit, s)).cast("array<string>") for s in SOURCE_LISTS])
    quotes = [F.concat(pick(QUOTE_WORDS, n + k), F.lit(" "), F.col("text")) for k in range(5)]
    empty = F.array().cast("array<string>")
    return table(spark, sf_dir, "documents").select(
        "doc_id", "n_chars",
        pick(THEME_NAMES, n).alias("theme_name"), pick(ISSUES, d).alias("primary_issue"),
        pick(MECHANISMS, d).alias("behavioral_mechanism"),
        F.when(d % 2 == 0, "given reason").otherwise("").alias("out_of_scope_reason"),
        F.when(d % 4 == 0, empty).otherwise(F.array(F.concat(F.lit("fact "), n.cast("string")), F.lit("more"))).alias("observed_facts"),
        F.array(F.lit("a question"), F.lit("another")).alias("research_questions"),
        (n % 150).alias("n"), F.element_at(lists, (d % 4 + 1).cast("int")).alias("sources"),
        F.array(*quotes).alias("sample_quotes"),
        pick(RELEVANCES, d).alias("relevance"), pick(SCORES, n).alias("prev"), pick(SCORES, d + n).alias("sig"),
        (n * 1000 + d).alias("total"),
        *[F.when(d % (i + 2) == 0, n).otherwise(0).alias(f"e{i}_n") for i in range(4)],
        *[F.concat(F.lit(f"{i} "), F.col("text")).alias(f"e{i}_text") for i in range(4)],
    )


# the same rows for the other engine
def _sql_list(values) -> str:
    def one(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"[{', '.join(one(x) for x in v)}]::varchar[]" if isinstance(v, tuple) else f"{v}::double"

    return f"[{', '.join(one(v) for v in values)}]"


def _sql_pick(values, index: str) -> str:
    return f"({_sql_list(values)})[({index}) % {len(values)} + 1]"


PROPOSALS_SQL = f"""
select doc_id, n_chars,
  {_sql_pick(THEME_NAMES, 'n_chars')} as theme_name, {_sql_pick(ISSUES, 'doc_id')} as primary_issue,
  {_sql_pick(MECHANISMS, 'doc_id')} as behavioral_mechanism,
  case when doc_id % 2 = 0 then 'given reason' else '' end as out_of_scope_reason,
  case when doc_id % 4 = 0 then []::varchar[] else ['fact ' || n_chars, 'more'] end as observed_facts,
  ['a question', 'another'] as research_questions, n_chars % 150 as n,
  {_sql_pick(SOURCE_LISTS, 'doc_id')} as sources,
  [{', '.join(f"{_sql_pick(QUOTE_WORDS, f'n_chars + {k}')} || ' ' || text" for k in range(5))}] as sample_quotes,
  {_sql_pick(RELEVANCES, 'doc_id')} as relevance, {_sql_pick(SCORES, 'n_chars')} as prev,
  {_sql_pick(SCORES, 'doc_id + n_chars')} as sig,
  n_chars * 1000 + doc_id as total,
  {', '.join(f"case when doc_id % {i + 2} = 0 then n_chars else 0 end as e{i}_n" for i in range(4))},
  {', '.join(f"'{i} ' || text as e{i}_text" for i in range(4))}
from documents
"""
