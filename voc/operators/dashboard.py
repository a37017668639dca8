"""Views of theme rows and messages a dashboard or chat asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voc import wording as w
from voc.functions.text import contains_any

BUCKETS = {
    "promote": lambda a: a == w.PROMOTE,
    "monitor": lambda a: a.contains("Monitor"),
    "niche": lambda a: a.contains("Niche"),
    "out_of_scope": lambda a: a.contains("Out of Scope"),
}


def bucket(action: Column) -> Column:
    """Quadrant of the priority matrix; dropped themes are shown with the out-of-scope ones."""
    name = F
    for key, test in BUCKETS.items():
        name = name.when(test(action) | (action.contains("Drop") if key == "out_of_scope" else F.lit(False)), key)
    return name.otherwise("other")


def bucket_counts(themes: DataFrame) -> DataFrame:
    return themes.groupBy(bucket(F.col("action")).alias("bucket")).agg(F.count("*").alias("n"))


def explore(themes: DataFrame, chosen: str = "all", query: str = "") -> DataFrame:
    """Themes of one bucket whose name, issue, action or any quote holds the query, in any case."""
    rows = themes.where(BUCKETS[chosen](F.col("action"))) if chosen in BUCKETS else themes
    term = query.lower().strip()
    if not term:
        return rows
    in_fields = [F.lower(F.coalesce(c, F.lit(""))).contains(term) for c in ("theme", "primary_issue", "action")]
    in_quotes = F.coalesce(F.exists("example_quotes", lambda q: F.lower(q).contains(term)), F.lit(False))
    return rows.where(in_fields[0] | in_fields[1] | in_fields[2] | in_quotes)


def theme_by_title(themes: DataFrame, title: str) -> DataFrame:
    """The first theme with this title."""
    return themes.where(F.col("theme") == title).orderBy("position").limit(1)


def percent(score: Column) -> Column:
    return score / 5.0 * 100


def badges(themes: DataFrame) -> DataFrame:
    """Display labels of each theme: score percentages, action label and badge, relevance text and badge."""
    action, rel = F.col("action"), F.col("research_relevance")
    action_badge, rel_badge = F, F
    for text, badge in w.ACTION_BADGES:
        action_badge = action_badge.when(action.contains(text), badge)
    for names, badge in w.RELEVANCE_BADGES:
        rel_badge = rel_badge.when(rel.isin(*names), badge)
    return themes.withColumns({
        "prevalence_pct": percent(F.coalesce("prevalence_score", F.lit(0.0))),
        "signal_pct": percent(F.coalesce("signal_strength_score", F.lit(0.0))),
        "action_badge": action_badge.otherwise(w.OTHER_BADGE),
        "action_label": F.when(action.contains("Promote"), w.PROMOTE_LABEL).otherwise(action),
        "relevance_badge": rel_badge.otherwise(w.OTHER_BADGE),
        "relevance_label": F.replace(F.coalesce(rel, F.lit("NO")), F.lit("_"), F.lit(" ")),
    })


def _policy(name: str, status: str, value: str | None, source: str | Column) -> Column:
    return F.struct(
        F.lit(name).alias("name"), F.lit(status).alias("status"), F.lit(value).cast("string").alias("value"),
        (source if isinstance(source, Column) else F.lit(source)).alias("source"),
    )


def policies(themes: DataFrame) -> DataFrame:
    """Recommendation policies of each theme: those its words call for, then the standing ones, six at most."""

    def low(name: str) -> Column:
        return F.lower(F.coalesce(name, F.lit("")))

    mechanism, area, opportunity = low("behavioral_mechanism"), low("primary_issue"), low("product_opportunity")
    trust = contains_any(mechanism, ("trust", "quality", "loss")) | contains_any(opportunity, ("confidence", "trust")) | area.contains("quality")
    delivery = area.contains("delivery") | contains_any(mechanism, ("delivery", "fulfil"))
    payment = area.contains("payment") | contains_any(mechanism, ("payment", "uncertainty"))
    counted = F.concat(
        F.coalesce(F.col("frequency"), F.lit(0)).cast("string"), F.lit(" quality reviews across "),
        F.coalesce(F.size("sources"), F.lit(0)).cast("string"), F.lit(" sources"),
    )
    wanted = [F.when(trust, _policy(n, s, v, src if src else counted)) for n, s, v, src in w.TRUST_POLICIES]
    wanted += [F.when(delivery, _policy(*w.DELIVERY_POLICY)), F.when(payment, _policy(*w.PAYMENT_POLICY))]
    wanted += [_policy(*p) for p in w.STANDING_POLICIES]
    kept = F.slice(F.array_compact(F.array(*wanted)), 1, w.MAX_POLICIES)
    return themes.select("theme", F.posexplode(kept).alias("place", "policy")).select(
        "theme", (F.col("place") + 1).cast("bigint").alias("place"), "policy.*"
    )


def last_messages(messages: DataFrame, k: int = 5) -> DataFrame:
    """The last k messages of every conversation; ``back`` is 1 for the newest. Cut to k per task before the shuffle."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= k)


def last_query(messages: DataFrame) -> DataFrame:
    """The newest message of every conversation."""
    return last_messages(messages, 1).drop("back")
