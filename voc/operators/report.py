"""Result tables and documents built from ranked theme rows (a handful of rows each)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voc import wording as w
from voc.functions.scores import round1, share
from voc.schemas import RESULT_THEME
from voc.settings import DEFAULT, Settings


def results_table(themes: DataFrame) -> DataFrame:
    """The 30 report columns: lists joined by ``; ``, sources by ``, ``, three quotes in columns of their own."""
    lists = {"observed_facts", "alternative_explanations", "research_questions", "assumptions"}
    zero = {"prevalence_score": 0.0, "frequency": 0}

    def column(title: str, name: str) -> Column:
        if name == "example_quotes":
            value = F.coalesce(F.try_element_at(name, F.lit(int(title[-1]))), F.lit(""))
        elif name == "sources":
            value = F.concat_ws(", ", name)
        elif name in lists:
            value = F.concat_ws("; ", name)
        else:
            value = F.coalesce(F.col(name), F.lit(zero.get(name, "")))
        return value.alias(title)

    return themes.orderBy("position").select(*[column(t, n) for t, n in w.RESULT_COLUMNS])


def coverage_warning(play_share: Column) -> Column:
    text = F.concat(F.lit(w.COVERAGE_WARNING[0]), round1(play_share).cast("string"), F.lit(w.COVERAGE_WARNING[1]))
    return F.when(play_share > w.COVERAGE_LIMIT, text).otherwise("")


def result_metadata(themes: DataFrame) -> DataFrame:
    """One row: theme counts, reviews analysed, and the share of the play store among all theme sources."""
    is_play = lambda s: s == "play_store"
    counts = themes.agg(
        F.coalesce(F.max("total"), F.lit(0)).alias("total_feedback_analyzed"),
        F.count("*").alias("total_themes_discovered"),
        F.count_if(F.col("action") == w.PROMOTE).alias("promoted_research_questions_count"),
        F.count_if(F.col("action") == w.OUT_ACTION).alias("out_of_scope_themes_count"),
        F.coalesce(F.sum(F.size("sources")), F.lit(0)).alias("named_sources"),
        F.coalesce(F.sum(F.size(F.filter("sources", is_play))), F.lit(0)).alias("named_play"),
    )
    play_share = share(F.col("named_play"), F.col("named_sources"))
    return counts.withColumn("coverage_warning", coverage_warning(play_share)).withColumn(
        "play_store_pct", round1(play_share)
    ).drop("named_sources", "named_play")


def _ordered(*cols, by: str = "position") -> Column:
    """Theme structs in order; bounded by the number of themes."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(by).alias("_by"), F.struct(*cols).alias("_row"))))
    return F.transform(rows, lambda r: r["_row"])


METADATA_COLUMNS = (
    "total_feedback_analyzed", "total_themes_discovered", "promoted_research_questions_count",
    "out_of_scope_themes_count", "coverage_warning",
)


def results_document(themes: DataFrame) -> DataFrame:
    """One JSON text: metadata block and all theme rows in rank order."""
    meta = result_metadata(themes).select(F.struct(*METADATA_COLUMNS)).scalar()
    return themes.agg(_ordered(*RESULT_THEME.fieldNames()).alias("themes")).select(
        F.to_json(F.struct(meta.alias("metadata"), "themes")).alias("document")
    )


def _text(parts: tuple) -> Column:
    """A line of fixed texts and theme columns; lists are joined as their mark says."""

    def one(part) -> Column:
        if isinstance(part, w.Quoted):
            return F.array_join(F.transform(str(part), lambda q: F.concat(F.lit('"'), q, F.lit('"'))), ", ")
        if isinstance(part, w.Listed):
            return F.concat_ws(", ", str(part))
        return F.col(str(part)).cast("string") if isinstance(part, w.Field) else F.lit(part)

    return F.concat(*map(one, parts))


def _lines(rows: tuple[tuple, ...]) -> Column:
    return F.array(*map(_text, rows))


def _quote(mark: tuple[str, str]):
    return lambda q: F.concat(F.lit(mark[0]), q, F.lit(mark[1]))


def markdown_report(themes: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The Markdown summary: promoted themes in full, monitored and niche ones as list, out-of-scope ones."""
    action = F.coalesce("action", F.lit(""))
    section = (
        F.when(action == w.PROMOTE, 1).when(action.contains("Monitor"), 2).when(action.contains("Niche"), 3)
        .when(action == w.OUT_ACTION, 4).otherwise(5)
    )
    numbered = themes.withColumn("section", section).withColumn(
        "no", F.row_number().over(Window.partitionBy("section").orderBy("position"))
    )
    quote_lines = F.transform(F.slice("example_quotes", 1, 3), _quote(w.REPORT_QUOTE))
    promoted = F.concat(_lines(w.REPORT_PROMOTED), quote_lines, _lines((w.REPORT_RULE,)))
    watched = _lines((w.REPORT_WATCHED,))
    first_quote = F.transform(F.slice("example_quotes", 1, 1), _quote(w.REPORT_QUOTE))
    out = F.concat(_lines(w.REPORT_ASIDE), first_quote, F.array(F.lit("\n")))
    lines = F.when(F.col("section") == 1, promoted).when(F.col("section").isin(2, 3), watched).when(F.col("section") == 4, out)
    body = numbered.select("section", "position", F.coalesce(lines, F.array().cast("array<string>")).alias("lines")).agg(
        F.array_sort(F.collect_list(F.struct("section", "position", "lines"))).alias("blocks")
    )

    def part(*sections: int) -> Column:
        mine = F.filter("blocks", lambda b: b["section"].isin(*sections))
        return F.flatten(F.transform(mine, lambda b: b["lines"]))

    def lit(*texts: str) -> Column:
        return F.array(*map(F.lit, texts))

    def or_text(lines: Column, text: str) -> Column:
        return F.when(F.size(lines) > 0, lines).otherwise(lit(text))

    empty = F.array().cast("array<string>")
    warning = F.col("meta.coverage_warning")
    promoted_head, watched_head, aside_head = w.REPORT_HEADINGS
    md = F.concat(
        lit(*w.REPORT_TITLE),
        _lines((w.REPORT_TOTAL,)),
        F.when(warning != "", _lines((w.REPORT_WARNING,))).otherwise(empty),
        lit(promoted_head),
        or_text(part(1), w.REPORT_NO_PROMOTED),
        F.when(F.size(part(2, 3)) > 0, F.concat(lit(watched_head), part(2, 3))).otherwise(empty),
        lit(aside_head),
        or_text(part(4), w.REPORT_NO_ASIDE),
    )
    meta = result_metadata(themes).select(F.struct("total_feedback_analyzed", "coverage_warning")).scalar()
    return body.withColumn("meta", meta).select(F.array_join(md, "\n").alias("markdown"))


def chat_context(themes: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The grounding text for a chat: header counts and one block per theme in rank order."""
    quotes = F.transform("example_quotes", _quote(w.CONTEXT_QUOTE))
    empty = F.array().cast("array<string>")
    reason = F.coalesce("out_of_scope_reason", F.lit(""))
    block = F.concat(
        _lines(w.CONTEXT_THEME), F.when(reason != "", _lines((w.CONTEXT_REASON,))).otherwise(empty),
        F.array(F.lit(w.CONTEXT_QUOTES)), quotes,
    )
    blocks = themes.select("position", block.alias("lines")).agg(
        F.array_sort(F.collect_list(F.struct("position", "lines"))).alias("blocks")
    )
    meta = result_metadata(themes).select(F.struct(*METADATA_COLUMNS)).scalar()

    head = F.concat(F.array(F.lit(w.CONTEXT_TITLE[0] + settings.brand.upper() + w.CONTEXT_TITLE[1])), _lines(w.CONTEXT_HEAD))
    lines = F.concat(head, F.flatten(F.transform("blocks", lambda b: b["lines"])))
    return blocks.withColumn("meta", meta).select(F.array_join(lines, "\n").alias("context"))
