"""From loaded feedback to the clean set the analysis works on."""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampType

from voc import rules
from voc.functions.classify import is_noise, is_spam, review_mask
from voc.functions.text import clean_text, contains_any, once
from voc.settings import DEFAULT

# groups of input partitions ranked on their own before all survivors meet
_RANK_PARTS = 512
_FIXED_WIDTH = (NumericType, BooleanType, DateType, TimestampType)


def unify(tables: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def keep_first(df: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """One row per key, the one with the smallest ``order``, which is unique.

    A key held by a third of the rows leaves each input partition as a single row. Rows whose other columns have a fixed
    width go through a hash aggregate before and after the shuffle. With texts among them the rows are ranked by a
    digest of the key, which sorts by numbers and compares texts only where digests are equal; Spark cuts each partition
    to one row per key before the shuffle.
    """
    rest = [c for c in df.columns if c != key]
    if all(isinstance(df.schema[c].dataType, _FIXED_WIDTH) for c in rest):
        return df.groupBy(key).agg(*[F.min_by(c, order).alias(c) for c in rest]).select(*df.columns)
    place = F.row_number().over(Window.partitionBy("key_digest", key).orderBy(order))
    ranked = df.withColumn("key_digest", F.xxhash64(key)).withColumn("key_place", place)
    return ranked.where(F.col("key_place") == 1).select(*df.columns)


def long_enough(df: DataFrame) -> DataFrame:
    return df.where(F.length("text") > rules.MIN_INGEST_CHARS)


def ingest(df: DataFrame) -> DataFrame:
    """Texts of more than ten characters, exact copies removed; the earliest row stays."""
    return keep_first(long_enough(df), "text")


def cleaned_rows(df: DataFrame, theme_rules=()) -> DataFrame:
    """Cleaned text and pattern mask added, short texts and spam dropped. The length test comes first, it is cheap."""
    cleaned = once(df, "cleaned_text", clean_text(F.col("text")))
    long = cleaned.where(F.length("cleaned_text") >= rules.MIN_CLEAN_CHARS)
    return masked(long, theme_rules).where(~is_spam(F.col("mask")))


def clean(df: DataFrame, theme_rules=()) -> DataFrame:
    """Cleaned, spam-free, one row per cleaned text.

    Equal raw texts have equal cleaned texts, so this one shuffle also removes the copies ``ingest`` would remove;
    ``clean(long_enough(df))`` and ``clean(ingest(df))`` give the same rows.
    """
    return keep_first(cleaned_rows(df, theme_rules), "cleaned_text")


def masked(df: DataFrame, theme_rules=()) -> DataFrame:
    """Adds ``mask``: which fixed patterns a cleaned text holds, and which of the theme rules, in one pass.

    Without a cleaned text the text itself is taken.
    """
    if "mask" in df.columns:
        return df
    text = F.col("cleaned_text") if "cleaned_text" in df.columns else F.col("text").cast("string")
    return once(df.withColumn("cleaned_text", text), "mask", review_mask(F.col("cleaned_text"), theme_rules))


def noise_flagged(df: DataFrame) -> DataFrame:
    return masked(df).withColumn("is_noise", is_noise(F.col("mask")))


def drop_noise(flagged: DataFrame) -> DataFrame:
    """Rows that are not noise, or all rows if every row is noise.

    Whether any row is kept is a scalar of the same plan that reads the flag alone. Pass rows of a written table: other
    rows would be computed once for the scalar and once more for the result.
    """
    keep = ~F.col("is_noise")
    any_kept = flagged.agg(F.max(keep).alias("kept")).scalar()
    return flagged.where(keep | ~F.coalesce(any_kept, F.lit(False)))


def limit_per_source(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """The first n rows of each source by ``ord``; sources without a limit stay whole.

    Only ``(source, ord)`` is ranked, first among the rows of the same few input partitions, then among the survivors.
    That gives the last ``ord`` of each source, and the rows themselves are filtered without a shuffle.
    """
    none_left = [s for s, n in limits.items() if n <= 0]
    caps = {s: n for s, n in limits.items() if n > 0}
    rows = df.where(~F.col("source").isin(*none_left)) if none_left else df
    if not caps:
        return rows
    keys = rows.where(F.col("source").isin(*caps)).select("source", "ord")
    cap = F.element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("source"))
    parts = keys.withColumn("part", F.spark_partition_id() % _RANK_PARTS)
    best = _first(parts, ("source", "part"), max(caps.values()))
    last = _first(best, ("source",), max(caps.values())).where(F.col("place") == cap)
    cutoffs = last.agg(F.map_from_entries(F.collect_list(F.struct("source", "ord"))).alias("last")).scalar()
    with_last = rows.withColumn("last", F.try_element_at(cutoffs, F.col("source")))
    return with_last.where(F.col("ord") <= F.coalesce("last", "ord")).drop("last")


def _first(keys: DataFrame, group: tuple[str, ...], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*group).orderBy("ord"))
    return keys.withColumn("place", place).where(F.col("place") <= k)


def search_terms(df: DataFrame, terms: Iterable[str] = DEFAULT.search_terms, text: str = "text") -> DataFrame:
    """One row per row and search term found in it, with the term and its place in the list."""
    low = F.lower(F.col(text))
    hits = F.array_compact(
        F.array(*[
            F.when(low.contains(t.lower()), F.struct(F.lit(i).alias("term_no"), F.lit(t).alias("term")))
            for i, t in enumerate(terms)
        ])
    )
    return df.where(contains_any(low, [t.lower() for t in terms])).select("*", F.inline(hits))


def first_per_id(df: DataFrame, order: str = "ord", key: str = "id") -> DataFrame:
    """Items found by several search terms once, as first found."""
    return keep_first(df, key, order)


def english_share(text: Column) -> Column:
    """Share of a text's words that are English function words."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")
    listed = F.filter(words, lambda w: w.isin(*rules.ENGLISH_STOP_WORDS))
    return F.when(F.size(words) > 0, F.size(listed) / F.size(words)).otherwise(F.lit(0.0))


def english_rows(df: DataFrame, lang: str | None = None, text: str = "text", least: float = 0.1) -> DataFrame:
    """Rows in English: by a language column, or by their share of function words."""
    return df.where(F.col(lang) == "en") if lang else df.where(english_share(F.col(text)) >= least)


def source_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count("*").alias("n"))
