"""Theme rows: labels, critic rules, counter-evidence, scores, consolidation, ranking, insights.

All frames here hold at most one row per issue domain (or one per stored reply); nothing scales with the reviews.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from voc import rules, wording as w
from voc.functions import scores
from voc.functions.text import contains_any, cut, strip
from voc.schemas import REPLY, THEME_COLUMNS
from voc.settings import DEFAULT, Settings


# ---------------------------------------------------------------- counter-evidence
def evidence_rows(stats: DataFrame) -> DataFrame:
    """Keys of the first opposing review of each phrase group; as many rows as groups."""
    ords = F.array(*[F.col(f"e{i}_ord") for i in range(len(rules.EVIDENCE_GROUPS))])
    return stats.limit(1).select(F.explode(F.array_distinct(ords)).alias("ord")).where(F.col("ord").isNotNull())


def with_evidence_texts(stats: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds the first opposing review of each phrase group as ``e*_text``. ``texts`` holds the few rows looked up."""
    wanted = texts.join(evidence_rows(stats), "ord", "left_semi").select("ord", "cleaned_text").distinct()
    by_ord = wanted.agg(F.map_from_entries(F.collect_list(F.struct("ord", "cleaned_text"))).alias("texts")).scalar()
    with_texts = stats.withColumn("texts", by_ord)
    return with_texts.withColumns({
        f"e{i}_text": F.try_element_at("texts", F.col(f"e{i}_ord")) for i in range(len(rules.EVIDENCE_GROUPS))
    }).drop("texts")


def counter_evidence(issue: Column, theme: Column) -> tuple[Column, Column]:
    """Sentence and number of opposing reviews: the first phrase group the issue calls for that has any."""
    low = F.concat(F.lower(issue), F.lit(" "), F.lower(theme))
    text, count = F, F
    for i, (name, words, _) in enumerate(rules.EVIDENCE_GROUPS):
        n = F.coalesce(F.col(f"e{i}_n"), F.lit(0))
        hit = contains_any(low, words) & (n > 0)
        quote = cut(F.col(f"e{i}_text"), w.EVIDENCE_CHARS, "...")
        sentence = F.concat(
            F.lit(w.EVIDENCE_LEAD), n.cast("string"), F.lit(w.EVIDENCE_TEXT[name]), F.lit('"'), quote, F.lit('"'),
            F.lit(w.EVIDENCE_TAIL[name]),
        )
        text, count = text.when(hit, sentence), count.when(hit, n)
    none = F.concat(F.lit(w.NO_EVIDENCE[0]), F.format_number(F.col("total"), 0), F.lit(w.NO_EVIDENCE[1]))
    return text.otherwise(none), count.otherwise(F.lit(0).cast("bigint"))


# ---------------------------------------------------------------- critic rules
def normalized_theme(theme: Column) -> Column:
    """Product names and refund or quality wording replaced by standing theme names; both look at the given name."""
    low = F.lower(strip(theme))
    about_trust = contains_any(low, ("refund", "quality", "return")) & ~low.contains("trust")
    product = contains_any(low, ("constitution", "book", "monster", "iphone", "earphone", "white monster"))
    return (
        F.when(about_trust, w.TRUST_THEME)
        .when(product & contains_any(low, ("book", "constitution", "availability")), w.ASSORTMENT_THEME)
        .when(product, w.NICHE_THEME)
        .otherwise(theme)
    )


def theme_relevance(theme: Column) -> Column:
    low = F.lower(theme)
    return (
        F.when(contains_any(low, ("trust in high-value", "assortment gaps")), w.DIRECT)
        .when(contains_any(low, ("fee", "charge", "time", "delivery", "payment", "coupon", "support")), w.INDIRECT)
        .otherwise(w.OUT)
    )


def critic(df: DataFrame) -> DataFrame:
    """Applies name, relevance and wording rules to proposed themes, and drops proposals the rules overrule.

    Needs ``theme_name, primary_issue, behavioral_mechanism, out_of_scope_reason, observed_facts,
    research_questions, n, sources`` and the counter-evidence columns.
    """
    df = df.withColumn("theme_name", normalized_theme(F.coalesce("theme_name", F.lit(""))))
    df = df.withColumn("research_relevance", theme_relevance(F.col("theme_name")))
    rel, low = F.col("research_relevance"), F.lower("theme_name")
    out, indirect = rel == w.OUT, rel == w.INDIRECT
    mechanism = strip(F.coalesce("behavioral_mechanism", F.lit("")))
    hedged = mechanism.startswith(w.INDIRECT_MECHANISM_STARTS[0]) | mechanism.startswith(w.INDIRECT_MECHANISM_STARTS[1])
    trust, assortment = contains_any(low, ("high-value", "trust")), contains_any(low, ("assortment", "niche"))
    reason = F.coalesce("out_of_scope_reason", F.lit(""))
    reasons = F.create_map(*[F.lit(x) for kv in w.RELEVANCE_REASONS.items() for x in kv])
    evidence_text, opposing = counter_evidence(F.coalesce("primary_issue", F.lit("Other")), F.col("theme_name"))
    level = scores.confidence_level(F.col("n"), rel)
    return df.withColumns({
        "relevance_reason": F.element_at(reasons, rel),
        "behavioral_mechanism": F.when(out, w.OUT_MECHANISM)
        .when(indirect & ~hedged, F.concat(F.lit(w.INDIRECT_MECHANISM[0]), mechanism, F.lit(w.INDIRECT_MECHANISM[1])))
        .otherwise(F.col("behavioral_mechanism")),
        "product_opportunity": F.when(out, "")
        .when(indirect & contains_any(low, ("fee", "charge")), w.FEES_OPPORTUNITY)
        .when(indirect & contains_any(low, ("time", "delivery")), w.TIMELINESS_OPPORTUNITY)
        .when(indirect & low.contains("payment"), w.PAYMENT_OPPORTUNITY)
        .when(indirect, w.GENERAL_OPPORTUNITY)
        .when(trust, w.TRUST_OPPORTUNITY)
        .when(assortment, w.ASSORTMENT_OPPORTUNITY)
        .otherwise(w.OTHER_DIRECT_OPPORTUNITY),
        "research_hypothesis": F.when(out, w.OUT_HYPOTHESIS)
        .when(indirect, w.INDIRECT_HYPOTHESIS)
        .when(trust, w.TRUST_HYPOTHESIS)
        .when(assortment, w.ASSORTMENT_HYPOTHESIS)
        .otherwise(w.OTHER_DIRECT_HYPOTHESIS),
        "research_questions": F.when(out, F.array().cast("array<string>")).otherwise(F.col("research_questions")),
        "out_of_scope_reason": F.when(out & (reason == ""), w.OUT_REASON).otherwise(reason),
        "contradictory_evidence": evidence_text,
        "opposing": opposing,
        "reasoning_trace": scores.reasoning_trace(F.col("observed_facts"), F.col("theme_name"), rel),
        "confidence": level,
        "confidence_explanation": scores.confidence_text(level, F.col("n"), F.col("sources"), opposing),
    })


# ---------------------------------------------------------------- labels
def label_table(spark, settings: Settings = DEFAULT) -> DataFrame:
    """The three label templates with the product's name filled in."""

    def branded(value):
        return [w.branded(v, settings.brand) for v in value] if isinstance(value, list) else w.branded(value, settings.brand)

    fields = list(w.LABELS[w.DEFAULT_LABEL])
    ddl = ", ".join(f"{f} {'ARRAY<STRING>' if f in w.LABEL_ARRAYS else 'STRING'}" for f in ("label_key", *fields))
    return spark.createDataFrame([(k, *[branded(t[f]) for f in fields]) for k, t in w.LABELS.items()], ddl)


def label_key(sample: Column) -> Column:
    """Which template a cluster gets: by words in its joined sample quotes."""
    low = F.lower(F.concat_ws(" ", sample))
    key = F
    for name, words in w.LABEL_WORDS:
        key = key.when(contains_any(low, words), name)
    return key.otherwise(w.DEFAULT_LABEL)


def sample_lists(sample_texts: DataFrame) -> DataFrame:
    """``sub_domain, sample_quotes`` in sample order; at most eight texts per cluster."""
    return sample_texts.where(F.col("place").isNotNull()).groupBy("sub_domain").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "cleaned_text"))), lambda s: s["cleaned_text"])
        .alias("sample_quotes")
    )


def heuristic_labels(stats: DataFrame, samples: DataFrame, keywords: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """One metadata row per cluster: template by sample, critic rules, evidence quotes, defaults."""
    clusters = (
        stats.join(samples, "sub_domain", "left")
        .join(keywords, "sub_domain", "left")
        .withColumn("label_key", label_key(F.col("sample_quotes")))
        .join(F.broadcast(label_table(stats.sparkSession, settings)), "label_key")
    )
    # the quotes are chosen by the issue the template proposes
    quotes = scores.evidence_quotes(F.col("sample_quotes"), F.col("primary_issue"))
    labelled = critic(clusters.withColumn("example_quotes", quotes))
    return labelled.select(*scores.with_defaults(labelled.columns)).withColumn(
        "keywords", F.coalesce("keywords", F.array().cast("array<string>"))
    )


# ---------------------------------------------------------------- prompts and replies
def label_prompt(sample: Column, keywords: Column) -> Column:
    """The variable part of a labelling request: first keywords and first quotes."""
    lines = F.transform(F.slice(sample, 1, rules.PROMPT_QUOTES), lambda q: F.concat(F.lit("- "), q))
    return F.concat(
        F.lit("Keywords: "), F.concat_ws(", ", F.slice(keywords, 1, rules.PROMPT_KEYWORDS)),
        F.lit("\nQuotes:\n"), F.concat_ws("\n", lines),
    )


def question_prompt() -> Column:
    """The variable part of an insight request for one theme row."""
    lines = F.transform("example_quotes", lambda q: F.concat(F.lit("- "), q))
    return F.concat(
        F.lit("Theme: "), "theme", F.lit("\nPrimary Issue: "), "primary_issue", F.lit("\nRelevance: "),
        "research_relevance", F.lit("\nMechanism from Quotes: "), "behavioral_mechanism",
        F.lit("\nCustomer Quotes:\n"), F.concat_ws("\n", lines),
    )


def parse_reply(reply: Column) -> Column:
    """A stored JSON reply as a struct: an object, the first object of a list, otherwise all fields NULL."""
    text = F.ltrim(reply)
    first = F.try_element_at(F.from_json(reply, ArrayType(REPLY)), F.lit(1))
    return F.when(text.startswith("["), first).when(text.startswith("{"), F.from_json(reply, REPLY))


# ---------------------------------------------------------------- scores and consolidation
def scored_themes(labels: DataFrame) -> DataFrame:
    """Theme rows with frequency, scores, sources, sentiment and action, ordered by ``cluster_ord``."""
    return labels.withColumns({
        "theme": F.col("theme_name"),
        "frequency": F.col("n"),
        "action": scores.action(
            F.col("research_relevance"), F.col("prevalence_score"), F.col("signal_strength_score")
        ),
    }).select(*THEME_COLUMNS, "cluster_ord", "total")


def _merge(df: DataFrame, key: Column, best_signal: bool) -> DataFrame:
    """Rows of one key become the first row with summed counts, joined sources and quotes, and new scores.

    A row that is alone under its key stays as it is, including its action.
    """
    fields = [c for c in df.columns if c != "merge_key"]
    merged = (
        df.withColumn("merge_key", key)
        .groupBy("merge_key")
        .agg(
            F.min_by(F.struct(*fields), "cluster_ord").alias("first"),
            F.count("*").alias("members"),
            F.sum("frequency").alias("all_frequency"),
            F.max("signal_strength_score").alias("max_signal"),
            F.array_sort(F.collect_list(F.struct("cluster_ord", "sources", "example_quotes"))).alias("parts"),
        )
        .select("first.*", "members", "all_frequency", "max_signal", "parts")
    )
    many = F.col("members") > 1
    sources = F.array_distinct(F.flatten(F.transform("parts", lambda p: p["sources"])))
    quotes = F.array_distinct(F.flatten(F.transform("parts", lambda p: p["example_quotes"])))
    merged = merged.withColumns({
        "frequency": F.col("all_frequency"),
        "sources": F.when(many, sources).otherwise(F.col("sources")),
        "example_quotes": F.when(many, F.slice(quotes, 1, rules.KEPT_QUOTES)).otherwise(F.col("example_quotes")),
        "signal_strength_score": F.col("max_signal") if best_signal else F.col("signal_strength_score"),
    })
    merged = merged.withColumn(
        "prevalence_score",
        F.when(many, scores.prevalence(F.col("frequency"), F.col("total"), F.size("sources")))
        .otherwise(F.col("prevalence_score")),
    )
    rel, n = F.col("research_relevance"), F.col("frequency")
    level = scores.confidence_level(n, rel)
    new_action = scores.action(rel, F.col("prevalence_score"), F.col("signal_strength_score"))
    return merged.withColumns({
        "action": F.when(many, new_action).otherwise(F.col("action")),
        "confidence": F.when(many, level).otherwise(F.col("confidence")),
        "confidence_explanation": F.when(many, scores.confidence_text(level, n, F.col("sources"), F.lit(0)))
        .otherwise(F.col("confidence_explanation")),
    }).select(*fields)


def merge_same_names(themes: DataFrame) -> DataFrame:
    """First pass: themes whose names differ only in case or outer blanks; the best signal is kept."""
    return _merge(themes, F.lower(strip(F.col("theme"))), best_signal=True)


def standing_theme(theme: Column) -> Column:
    """Standing theme for a name by its words, as a struct with NULL where a field keeps its value."""
    low = F.lower(theme)

    def to(name, relevance, opportunity, hypothesis=None):
        return F.struct(
            F.lit(name).alias("theme"), F.lit(relevance).alias("relevance"), F.lit(opportunity).alias("opportunity"),
            F.lit(hypothesis).cast("string").alias("hypothesis"),
        )

    return (
        F.when(contains_any(low, ("refund", "return", "defective", "high-value", "quality")),
               to(w.TRUST_THEME, w.DIRECT, w.TRUST_OPPORTUNITY))
        .when(contains_any(low, ("assortment", "availability", "niche", "book", "choice", "selection", "variety",
                                 "product choices", "limited")),
              to(w.ASSORTMENT_THEME, w.DIRECT, w.ASSORTMENT_OPPORTUNITY, w.ASSORTMENT_HYPOTHESIS))
        .when(contains_any(low, ("fee", "charge", "surge")), to(w.FEES_THEME, w.INDIRECT, w.FEES_OPPORTUNITY))
        .when(contains_any(low, ("delivery", "time", "timeliness")),
              to(w.TIMELINESS_THEME, w.INDIRECT, w.TIMELINESS_OPPORTUNITY))
        .when(contains_any(low, ("payment", "cod")), to(w.PAYMENT_THEME, w.INDIRECT, w.PAYMENT_OPPORTUNITY))
    )


def rename_themes(themes: DataFrame) -> DataFrame:
    """Standing names, relevance, opportunity and hypothesis by theme words; the action is not touched."""
    to = F.col("standing")
    return themes.withColumn("standing", standing_theme(F.col("theme"))).withColumns({
        "theme": F.coalesce(to["theme"], F.col("theme")),
        "research_relevance": F.coalesce(to["relevance"], F.col("research_relevance")),
        "product_opportunity": F.coalesce(to["opportunity"], F.col("product_opportunity")),
        "research_hypothesis": F.coalesce(to["hypothesis"], F.col("research_hypothesis")),
    }).drop("standing")


def merge_standing_themes(themes: DataFrame) -> DataFrame:
    """Second pass: themes renamed to the same standing name; the first row's signal is kept."""
    return _merge(rename_themes(themes), F.col("theme"), best_signal=False)


def ranked(themes: DataFrame) -> DataFrame:
    """Position 1.. by action, then total score, then first appearance."""
    score = F.col("prevalence_score") + F.col("signal_strength_score")
    order = Window.orderBy(scores.action_rank(F.col("action")), score.desc(), "cluster_ord")
    return themes.withColumn("position", F.row_number().over(order))


def with_insights(themes: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Status, insight and research question; out-of-scope themes get a reason instead."""
    out = (F.col("research_relevance") == w.OUT) | (F.col("action") == w.OUT_ACTION)
    risk = contains_any(F.col("theme"), w.INSIGHT_WORDS)
    reason = F.concat(F.lit(w.OUT_REASON_FORMAT[0]), F.col("primary_issue"), F.lit(w.OUT_REASON_FORMAT[1]))
    return themes.withColumns({
        "status": F.when(out, "Out of Scope").otherwise("In Scope"),
        "suggested_insight": F.when(out, "").when(risk, w.RISK_INSIGHT).otherwise(w.GENERAL_INSIGHT),
        "suggested_research_question": F.when(out, "")
        .when(risk, w.branded(w.RISK_QUESTION, settings.brand))
        .otherwise(w.GENERAL_QUESTION),
        "out_of_scope_reason": F.when(out & (F.coalesce("out_of_scope_reason", F.lit("")) == ""), reason)
        .otherwise(F.col("out_of_scope_reason")),
        # only themes of this standing name come with a reason
        "relevance_reason": F.when(F.col("theme") == w.ASSORTMENT_THEME, w.RELEVANCE_REASONS[w.DIRECT]),
    })
