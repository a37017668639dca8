"""The weekly note: top themes, one quote and one action each, at most 250 words.

Input are ranked theme rows (``position``) and the total of analysed reviews; everything here is a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voc import wording as w
from voc.functions.scores import round1
from voc.functions.text import cut, paraphrase, word_count
from voc.settings import DEFAULT, Settings


def note_themes(themes: DataFrame) -> DataFrame:
    """The first three DIRECT themes, or the first three of all if fewer than three are DIRECT; numbered in ``no``."""
    direct = F.col("research_relevance") == w.DIRECT
    many = F.count_if(direct).over(Window.partitionBy()) >= w.NOTE_THEMES
    chosen = themes.withColumn("many", many).where(~F.col("many") | direct).drop("many")
    return (
        chosen.withColumn("no", F.row_number().over(Window.orderBy("position")))
        .where(F.col("no") <= w.NOTE_THEMES)
    )


def _one_decimal(x: Column) -> Column:
    return round1(x).cast("string")


def headline() -> Column:
    d = w.NOTE_DEFAULTS
    return F.concat(
        F.coalesce("theme", F.lit(d["theme"])), F.lit(" (Mentions: "),
        F.coalesce(F.col("frequency"), F.lit(d["mentions"])).cast("string"), F.lit(") — prevalence: "),
        _one_decimal(F.coalesce("prevalence_score", F.lit(d["prevalence"]))), F.lit("/5.0 | signal: "),
        _one_decimal(F.coalesce("signal_strength_score", F.lit(d["signal"]))), F.lit("/5.0"),
    )


def theme_action(issue: Column) -> Column:
    actions = F.create_map(*[F.lit(x) for kv in w.NOTE_ACTIONS.items() for x in kv])
    named = F.coalesce(issue, F.lit(w.NOTE_DEFAULTS["issue"]))
    return F.coalesce(
        F.try_element_at(actions, named),
        F.concat(F.lit(w.NOTE_ACTION_DEFAULT[0]), F.lower(named), F.lit(w.NOTE_ACTION_DEFAULT[1])),
    )


def note_rows(themes: DataFrame) -> DataFrame:
    """One row per note theme: id, headline, reported quote, action."""
    quote = F.coalesce(F.try_element_at("example_quotes", F.lit(1)), F.lit(w.NOTE_QUOTE_DEFAULT))
    return note_themes(themes).select(
        F.col("no").cast("bigint").alias("no"),
        F.concat(F.lit("theme_"), F.coalesce("cluster_id", "no").cast("string")).alias("id"),
        headline().alias("headline"),
        paraphrase(quote, w.NOTE_QUOTE_CHARS).alias("paraphrased"),
        theme_action(F.col("primary_issue")).alias("action"),
    )


def _markdown(quotes: Column) -> Column:
    heads = F.transform("items", lambda i: F.concat(F.lit("- **"), i["headline"], F.lit("**")))
    evidence = F.transform(quotes, lambda q: F.concat(F.lit("- "), q))
    actions = F.transform("items", lambda i: F.concat(F.lit("- "), i["action"]))
    lines = F.concat(
        F.array(F.concat(F.lit("# "), "title"), F.lit(""), F.lit(w.NOTE_HEADINGS[0])), heads,
        F.array(F.lit(""), F.lit(w.NOTE_HEADINGS[1])), evidence,
        F.array(F.lit(""), F.lit(w.NOTE_HEADINGS[2])), actions,
    )
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))


def weekly_note(rows: DataFrame, week: str, total: Column | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """The note as one row: title, Markdown, words, items and quotes. Over 250 words the quotes are cut, once."""
    items = F.array_sort(F.collect_list(F.struct("no", "id", "headline", "paraphrased", "action")))
    note = rows.agg(items.alias("items")).withColumn(
        "title", F.lit(f"{w.branded(w.NOTE_TITLE, settings.brand)}({week})")
    )
    quotes = F.transform("items", lambda i: i["paraphrased"])
    short = F.transform(quotes, lambda q: cut(q, w.NOTE_SHORT_CHARS, '..."'))
    note = note.withColumn("quotes", F.when(word_count(_markdown(quotes)) > w.NOTE_MAX_WORDS, short).otherwise(quotes))
    note = note.withColumn("markdown", _markdown(F.col("quotes")))
    return note.withColumns({
        "word_count": word_count(F.col("markdown")),
        "total": F.coalesce(total if total is not None else F.lit(None), F.lit(0)).cast("bigint"),
    }).where(F.size("items") > 0)


def note_document(note: DataFrame, generated_at: Column) -> DataFrame:
    """The note as one JSON text."""
    ids = F.transform("items", lambda i: i["id"])
    return note.select(F.to_json(F.struct(
        "title", "word_count", F.lit(w.NOTE_MAX_WORDS).alias("max_words"),
        F.transform("items", lambda i: F.struct(i["id"].alias("id"), i["headline"].alias("headline"))).alias("themes"),
        F.zip_with(ids, "quotes", lambda t, q: F.struct(t.alias("theme_id"), q.alias("paraphrased"), F.lit(1).alias("source_rating")))
        .alias("quotes"),
        F.transform("items", lambda i: F.struct(i["id"].alias("theme_id"), i["action"].alias("text"))).alias("actions"),
        F.struct(generated_at.alias("generated_at"), F.col("total").alias("total_feedback_analyzed")).alias("metadata"),
    )).alias("document"))
