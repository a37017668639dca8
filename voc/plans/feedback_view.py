"""The review-like view of the ``documents`` table that the registered queries run on.

The prose of that table is invented, so a fixed phrase is put in front of each whole document: one or more for every rule.
The index is taken from the length, so exact copies of a document stay exact copies. Every fifth length also gives a review
that is the phrase alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voc import rules
from voc.functions.text import word_list

# fixed values, in index order
PHRASES = (
    "The refund was rejected for a defective charger and no return was allowed",
    "Vegetables were rotten and the quality was poor, expired milk again",
    "COD is not available, upi payment keeps failing",
    "Handling fee and surge charge are too high for a small cart",
    "Delivery boy was rude and kept calling me",
    "Order came late, slow delivery took hours",
    "App crash at login, otp not coming",
    "Many items out of stock, limited brand options",
    "Great app!!!!!!!!!!!!!!",
    "love it, fresh fruits and fast service every day",
    "Prices are higher than mrp compared to the local store",
    "I always order daily essentials here, my go-to app",
    "Zepto is cheaper and better, switched last week",
    "received different item than shown in the image",
    "ordered medicine, delivery was quick and helpful",
    "bought a bluetooth earphone, not working, cheap duplicate",
    "use my code for free recharge, join telegram",
    "follow me on youtube.com for coupons",
    "late delivery, delivery guy never came",
    "wallet money deducted twice, payment failed",
    "feedback: cashback code expired",
    "contact me at a.b@mail.example.com or +91 98765 43210",
    "tweet @support_team about order 123456789012",
    "see https://ex.example.com/a?b=1 and www.ex.example for details",
    "book not available, search shows nothing",
    "good but expensive and slow, bad packaging issue",
    "ok",
    "discount offer was worth it, reasonable price, free delivery",
    "app crash on every search, the screen shows an error",
    "the delivery boy was rude about my order and argued",
    "login error in the app, i could not try a new category",
)

_ROWS = ", ".join(f"({i}, '{p}')" for i, p in enumerate(PHRASES))

# phrase-only reviews have positions and ids of their own
PHRASE_POSITION = 2**40

_COLUMNS = f"""(doc_id % 3) * {rules.SOURCE_STRIDE} + {{position}} as ord,
       concat(case doc_id % 3 when 0 then 'ps_' when 1 then 'as_' else 'rd_' end, {{mark}}, cast(doc_id as string)) as id,
       case doc_id % 3 when 0 then 'play_store' when 1 then 'app_store' else 'reddit' end as source,
       {{text}} as text,
       case when doc_id % 3 = 2 then null else cast(doc_id % 6 as double) end as rating,
       cast(doc_id % 50 as int) as upvotes
from documents d
join (values {_ROWS}) as p(pid, phrase) on p.pid = d.n_chars % {len(PHRASES)}"""

# the same rows for the other engine
FEEDBACK_SQL = (
    "select " + _COLUMNS.format(position="doc_id", mark="''", text="concat(p.phrase, '. ', d.text)")
    + "\nunion all\nselect " + _COLUMNS.format(position=f"doc_id + {PHRASE_POSITION}", mark="'p'", text="p.phrase")
    + "\nwhere n_chars % 5 = 0"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feedback_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as ``FEEDBACK_SQL``; the phrase is an array element, so no join is needed."""
    docs = table(spark, sf_dir, "documents")
    phrase = F.element_at(word_list(PHRASES), (F.col("n_chars") % len(PHRASES) + 1).cast("int"))
    kind = (F.col("doc_id") % 3).cast("int")

    def reviews(df: DataFrame, position: Column, mark: str, text: Column) -> DataFrame:
        prefix = F.element_at(F.array(F.lit("ps_"), F.lit("as_"), F.lit("rd_")), kind + 1)
        return df.select(
            (F.col("doc_id") % 3 * F.lit(rules.SOURCE_STRIDE) + position).alias("ord"),
            F.concat(prefix, F.lit(mark), F.col("doc_id").cast("string")).alias("id"),
            F.element_at(F.array(F.lit("play_store"), F.lit("app_store"), F.lit("reddit")), kind + 1).alias("source"),
            text.alias("text"),
            F.when(kind == 2, F.lit(None)).otherwise((F.col("doc_id") % 6).cast("double")).alias("rating"),
            (F.col("doc_id") % 50).cast("int").alias("upvotes"),
        )

    whole = reviews(docs, F.col("doc_id"), "", F.concat(phrase, F.lit(". "), F.col("text")))
    alone = reviews(docs.where(F.col("n_chars") % 5 == 0), F.col("doc_id") + PHRASE_POSITION, "p", phrase)
    return whole.unionByName(alone)
