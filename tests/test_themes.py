import pytest
from pyspark.sql import functions as F

from voc import rules, wording as w
from voc.functions import scores
from voc.operators import dashboard, note, report, themes
from voc.schemas import THEME, THEME_COLUMNS
from voc.settings import Settings


def theme(**fields):
    row = dict(
        cluster_id=0, theme="A theme", primary_issue="Other", research_relevance=w.DIRECT, evidence_summary="e",
        observed_facts=["f1", "f2"], observed_behavior="b", behavioral_mechanism="m", underlying_need="u",
        barrier_or_driver="d", business_impact="High", confidence="Low", confidence_explanation="x",
        signal_strength="High", customer_journey_stage="Evaluation", alternative_explanations=["alt"],
        contradictory_evidence="c", product_opportunity="o", research_hypothesis="h", research_questions=["q1", "q2"],
        why_these_quotes_matter="y", assumptions=[], reasoning_trace="t", out_of_scope_reason="",
        example_quotes=["one", "two"], frequency=10, prevalence_score=3.0, signal_strength_score=3.5,
        sources=["play_store"], sentiment="neutral", action=w.PROMOTE,
    )
    return {**row, **fields}


def table(spark, *rows, total=1000):
    data = [(*(r[c] for c in THEME_COLUMNS), i, total) for i, r in enumerate(rows)]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in THEME.fields)
    return spark.createDataFrame(data, ddl + ", cluster_ord bigint, total bigint")


def test_prevalence_of_published_counts(spark):
    # reviews, all reviews, sources -> score
    cases = [(61, 1602, 3, 4.0), (14, 1602, 3, 2.0), (3, 1602, 2, 1.5), (58, 862, 3, 5.0), (82, 862, 3, 5.0), (10, 1000, 1, 2.0),
             (30, 1000, 1, 3.0), (60, 1000, 1, 4.0), (100, 1000, 1, 5.0), (9, 1000, 1, 1.0)]
    df = spark.createDataFrame(cases, "n bigint, total bigint, s bigint, want double")
    assert df.where(scores.prevalence(F.col("n"), F.col("total"), F.col("s")) != F.col("want")).count() == 0


def test_signal_limits(spark):
    cases = [(240, 2, 0.0, 0.0, 4.5), (140, 2, 0.0, 0.0, 3.5), (139, 2, 0.0, 0.0, 2.5), (240, 2, 30.0, 30.0, 4.5), (140, 2, 30.1, 30.1, 2.5)]
    df = spark.createDataFrame(cases, "chars bigint, n bigint, pos double, neg double, want double")
    got = scores.signal_strength(F.col("chars"), F.col("n"), F.col("pos"), F.col("neg"))
    assert df.where(got != F.col("want")).count() == 0


@pytest.mark.parametrize("rel, prev, sig, want", [
    ("DIRECT", 3.0, 3.0, w.PROMOTE), ("DIRECT", 2.0, 3.0, w.NICHE), ("DIRECT", 3.0, 2.5, w.MONITOR), ("DIRECT", 2.5, 2.5, w.DROP),
    ("INDIRECT", 1.0, 1.0, w.MONITOR), ("OUT_OF_SCOPE", 5.0, 5.0, w.OUT_ACTION), ("odd", 1.0, 4.0, w.NICHE), (" direct ", 5.0, 5.0, w.PROMOTE),
])
def test_actions(value, rel, prev, sig, want):
    assert value(scores.action, r=rel, p=prev, s=sig) == want


def test_confidence(value):
    assert value(scores.confidence_level, n=80, r="DIRECT") == "High"
    assert value(scores.confidence_level, n=80, r="INDIRECT") == "Medium"
    assert value(scores.confidence_level, n=29, r="DIRECT") == "Low"
    text = value(lambda n, s: scores.confidence_text(F.lit("Medium"), n, s, F.lit(0)), n=58, s=["reddit", "play_store"])
    assert text.splitlines()[1] == "- Observed across 2 sources (reddit, play_store) in 58 customer reviews."
    assert "2 sources (Play Store, App Store)" in value(lambda n, s: scores.confidence_text(F.lit("High"), n, s, F.lit(0)), n=90, s=[])


@pytest.mark.parametrize("name, want", [
    ("Constitution Book Availability", w.ASSORTMENT_THEME), ("White Monster shortage", w.NICHE_THEME), ("iPhone Availability", w.ASSORTMENT_THEME),
    ("Refund quality doubts", w.TRUST_THEME), ("Trust in refunds", "Trust in refunds"), ("Earphone refund", w.TRUST_THEME), ("Other", "Other"),
])
def test_theme_names(value, name, want):
    assert value(themes.normalized_theme, t=name) == want


def test_relevance_of_the_default_label(value):
    # "delivery" in the default label makes it indirect
    assert value(themes.theme_relevance, t=w.LABELS[w.DEFAULT_LABEL]["theme_name"]) == w.INDIRECT
    assert value(themes.theme_relevance, t=w.TRUST_THEME) == w.DIRECT
    assert value(themes.theme_relevance, t="Login trouble") == w.OUT


def test_standing_names_by_substring(spark):
    names = {"General Service Delivery Feedback": w.FEES_THEME, "Limited choice": w.ASSORTMENT_THEME, "Slow time": w.TIMELINESS_THEME,
             "COD trouble": w.PAYMENT_THEME, "Return of high-value goods": w.TRUST_THEME, "Login": "Login"}
    rows = table(spark, *[theme(theme=n) for n in names])
    got = [r.theme for r in themes.rename_themes(rows).orderBy("cluster_ord").collect()]
    assert got == list(names.values())


def test_evidence_quotes(value):
    pick = lambda q: scores.evidence_quotes(q, F.lit("Refunds / Returns"))
    assert value(pick, q=["no", "refund a", "kaggle refund", "return b", "replace c", "refund d"]) == ["refund a", "return b", "replace c"]
    assert value(pick, q=["no", "none", "nothing", "never"]) == ["no", "none", "nothing"]
    other = lambda q: scores.evidence_quotes(q, F.lit("Availability"))
    assert value(other, q=["Bring more healthy options", "x"]) == ["x"]


def test_merge_same_names(spark):
    rows = table(
        spark, theme(theme="Slow  App", frequency=70, signal_strength_score=2.5, sources=["reddit"], example_quotes=["a", "b"]),
        theme(theme="Other thing", action="kept action", confidence="kept"),
        theme(theme=" slow  app ", frequency=30, signal_strength_score=4.5, sources=["play_store", "reddit"], example_quotes=["b", "c", "d"]),
    )
    one, other = themes.merge_same_names(rows).orderBy("cluster_ord").collect()
    assert (one.theme, one.frequency, one.signal_strength_score) == ("Slow  App", 100, 4.5)
    assert one.sources == ["reddit", "play_store"] and one.example_quotes == ["a", "b", "c"]
    assert one.prevalence_score == 5.0 and one.action == w.PROMOTE and one.confidence == "High"
    assert (other.action, other.confidence) == ("kept action", "kept")


def test_merge_standing_keeps_first_signal_and_stale_action(spark):
    rows = table(
        spark, theme(theme="Handling fee", research_relevance=w.DIRECT, signal_strength_score=2.5, frequency=5),
        theme(theme="Surge", signal_strength_score=4.5, frequency=6), theme(theme="Charge", frequency=7),
        theme(theme="Refund trouble", research_relevance=w.OUT, action=w.OUT_ACTION),
    )
    fees, trust = themes.merge_standing_themes(rows).orderBy("cluster_ord").collect()
    assert (fees.theme, fees.frequency, fees.signal_strength_score, fees.action) == (w.FEES_THEME, 18, 2.5, w.MONITOR)
    assert (trust.theme, trust.research_relevance, trust.action) == (w.TRUST_THEME, w.DIRECT, w.OUT_ACTION)


def test_rank_is_stable(spark):
    rows = table(
        spark, theme(theme="m", action=w.MONITOR, prevalence_score=5.0), theme(theme="o", action=w.OUT_ACTION, prevalence_score=5.0),
        theme(theme="n", action=w.NICHE, prevalence_score=1.0), theme(theme="m2", action=w.MONITOR, prevalence_score=5.0),
        theme(theme="p", action=w.PROMOTE), theme(theme="?", action="unknown"),
    )
    assert [r.theme for r in themes.ranked(rows).orderBy("position").collect()] == ["p", "n", "m", "m2", "o", "?"]


def test_insights(spark):
    rows = table(spark, theme(theme="Refund Risk"), theme(theme="refund risk"), theme(research_relevance=w.OUT, primary_issue="App"),
                 theme(action=w.OUT_ACTION, out_of_scope_reason="given"))
    a, b, c, d = themes.with_insights(rows, Settings(brand="Acme")).orderBy("cluster_ord").collect()
    assert a.suggested_insight == w.RISK_INSIGHT and "on Acme—what" in a.suggested_research_question
    assert b.suggested_insight == w.GENERAL_INSIGHT and b.status == "In Scope"
    assert c.status == "Out of Scope" and c.out_of_scope_reason.startswith("This theme represents operational feedback in App ")
    assert d.out_of_scope_reason == "given" and d.suggested_insight == ""


def test_replies(spark):
    rows = [('{"theme_name": "A", "observed_facts": ["x"]}', "A"), ('[{"theme_name": "B"}, {"theme_name": "C"}]', "B"), ("[]", None),
            ("no json", None), ("12", None), (None, None)]
    df = spark.createDataFrame(rows, "reply string, want string").select("want", themes.parse_reply(F.col("reply"))["theme_name"].alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_prompts(value):
    prompt = value(lambda q, k: themes.label_prompt(q, k), q=["a", "b"], k=[str(i) for i in range(9)])
    assert prompt == "Keywords: 0, 1, 2, 3, 4, 5\nQuotes:\n- a\n- b"


# ---------------------------------------------------------------- note
def note_input(spark, *rows):
    return themes.ranked(table(spark, *rows)).withColumn("position", F.col("cluster_ord") + 1)


def test_published_note(spark):
    quote = ("I ordered charger with cable but after receiving the product the cable quality was very bad .. after complaing "
             "with customer support")
    rows = [
        theme(cluster_id=7, theme=w.TRUST_THEME, primary_issue="quality", frequency=224, prevalence_score=5.0, signal_strength_score=4.5,
              example_quotes=[quote]),
        theme(cluster_id=3, theme=w.TIMELINESS_THEME, primary_issue="Delivery", research_relevance=w.INDIRECT, frequency=275,
              prevalence_score=5.0, example_quotes=["Very bad 😞 delivery partner"]),
        theme(cluster_id=6, theme=w.FEES_THEME, primary_issue="Payment Issues", research_relevance=w.INDIRECT, frequency=129,
              prevalence_score=5.0, example_quotes=["Only keep away the surge costs!"]),
        theme(cluster_id=1, theme="Fourth"),
    ]
    built = note.weekly_note(note.note_rows(note_input(spark, *rows)), "2026-08-03", F.lit(1602), Settings(brand="Acme")).first()
    assert built.word_count == 108 and built.total == 1602
    assert built.markdown.splitlines() == [
        "# Acme — Weekly Customer Discovery Pulse (2026-08-03)", "", "## Top Customer Opportunities",
        "- **Low Trust in High-Value Purchases (Mentions: 224) — prevalence: 5.0/5.0 | signal: 4.5/5.0**",
        "- **Inconsistent Delivery Timeliness (Mentions: 275) — prevalence: 5.0/5.0 | signal: 3.5/5.0**",
        "- **Excessive Fees and Surge Charges (Mentions: 129) — prevalence: 5.0/5.0 | signal: 3.5/5.0**", "",
        "## Representative Customer Evidence",
        '- "Customer says: I ordered charger with cable but after receiving the product the cable quality was very bad"',
        '- "Customer says: Very bad 😞 delivery partner"', '- "Customer says: Only keep away the surge costs!"', "",
        "## Proposed Action Items", "- Audit feedback and optimize experience in quality category.",
        "- Audit feedback and optimize experience in delivery category.",
        "- Audit feedback and optimize experience in payment issues category.",
    ]
    assert [i.id for i in built["items"]] == ["theme_7", "theme_3", "theme_6"]


def test_note_takes_direct_themes_and_shortens(spark):
    long = " ".join(["word"] * 90)
    direct = [theme(theme=long, example_quotes=["x" * 95]) for _ in range(3)]
    rows = [theme(theme="first", research_relevance=w.INDIRECT), *direct]
    built = note.weekly_note(note.note_rows(note_input(spark, *rows)), "2024-01-07").first()
    assert all(i.headline.startswith("word") for i in built["items"])
    assert all(q.endswith('..."') and len(q) == 64 for q in built.quotes) and built.word_count > 250
    assert note.weekly_note(note.note_rows(note_input(spark, theme()).limit(0)), "2024-01-07").count() == 0


def test_note_documents(spark):
    import json

    built = note.weekly_note(note.note_rows(note_input(spark, theme(cluster_id=None))), "2024-01-07", F.lit(1602))
    doc = json.loads(note.note_document(built, F.lit("2024-01-07T00:00:00Z")).first().document)
    assert doc["themes"][0]["id"] == "theme_1" and doc["metadata"]["total_feedback_analyzed"] == 1602


# ---------------------------------------------------------------- reports
def ranked_rows(spark, *rows):
    return themes.with_insights(themes.ranked(table(spark, *rows)))


def test_results_table(spark):
    row = report.results_table(ranked_rows(spark, theme(sources=["play_store", "reddit"]))).first()
    assert len(row) == 30 and row["Observed Facts"] == "f1; f2" and row["Sources"] == "play_store, reddit"
    assert (row["Example Quote 1"], row["Example Quote 2"], row["Example Quote 3"]) == ("one", "two", "")


def test_metadata_and_warning(spark):
    meta = report.result_metadata(ranked_rows(spark, theme(), theme(sources=["play_store", "reddit"], action=w.OUT_ACTION), theme())).first()
    assert (meta.total_themes_discovered, meta.promoted_research_questions_count, meta.out_of_scope_themes_count) == (3, 2, 1)
    assert meta.play_store_pct == 75.0 and meta.coverage_warning.startswith("Coverage Warning: Dataset is dominated by Google Play Store (75.0%)")
    few = report.result_metadata(ranked_rows(spark, theme(sources=["play_store", "reddit"]))).first()
    assert few.coverage_warning == ""


def test_markdown(spark):
    md = report.markdown_report(ranked_rows(
        spark, theme(theme="P"), theme(theme="N", action=w.NICHE), theme(theme="M", action=w.MONITOR),
        theme(theme="O", action=w.OUT_ACTION, out_of_scope_reason="why"), theme(theme="D", action=w.DROP),
    )).first().markdown
    assert "### 1. P\n" in md and '  > "one"\n\n  > "two"\n' in md
    assert md.index("**M**") < md.index("**N**") and "### 📌 O\n" in md and "**D**" not in md
    assert "- **Out of Scope Rationale**: why\n" in md
    empty = report.markdown_report(ranked_rows(spark, theme(theme="D", action=w.DROP))).first().markdown
    assert "_No themes met" in empty and "_None_" in empty and "Secondary" not in empty


def test_chat_context(spark):
    text = report.chat_context(ranked_rows(spark, theme(theme="P"), theme(theme="O", research_relevance=w.OUT)), Settings(brand="Acme")).first().context
    assert text.startswith("=== ACME CUSTOMER FEEDBACK CORPUS CONTEXT ===\nTotal Feedback Analyzed: 1000 clean items\n")
    assert text.count("  Out of Scope Reason: ") == 1 and text.endswith('    - "two"')


def test_dashboard(spark):
    rows = ranked_rows(spark, theme(theme="P"), theme(theme="M", action=w.MONITOR, example_quotes=["Late RIDER"]), theme(theme="D", action=w.DROP))
    assert {r.bucket: r.n for r in dashboard.bucket_counts(rows).collect()} == {"promote": 1, "monitor": 1, "out_of_scope": 1}
    assert [r.theme for r in dashboard.explore(rows, query=" rider ").collect()] == ["M"]
    assert dashboard.explore(rows, "promote").count() == 1 and dashboard.explore(rows).count() == 3
    assert dashboard.theme_by_title(rows, "D").first().theme == "D"
    badge = dashboard.badges(rows.where("theme = 'P'")).first()
    assert (badge.prevalence_pct, badge.action_badge, badge.action_label) == (60.0, "badge-green", w.PROMOTE_LABEL)


def test_policies(spark):
    rows = table(spark, theme(theme="a", behavioral_mechanism="trust and delivery and payment"), theme(theme="b", product_opportunity=""))
    got = {}
    for r in dashboard.policies(rows).orderBy("theme", "place").collect():
        got.setdefault(r.theme, []).append(r.name)
    assert got["a"] == ["Brand Trust", "Minimum Rating", "Complaint Screening", "Delivery Reliability", "Price Transparency", "Explainability"]
    assert got["b"] == ["Explainability", "Social Proof", "Confidence Threshold"]


def test_last_messages(spark):
    rows = spark.createDataFrame([(c, t, "user", f"m{t}") for c in (1, 2) for t in range(7)], "conv_id int, turn int, role string, text string")
    assert dashboard.last_messages(rows).count() == 10
    assert {r.text for r in dashboard.last_query(rows).collect()} == {"m6"}


def test_counter_evidence_takes_first_group_with_hits(spark):
    row = {f"e{i}_n": n for i, n in enumerate((0, 3, 2, 1))} | {f"e{i}_text": f"text {i}" for i in range(4)} | {"total": 1602}
    df = spark.createDataFrame([row])
    text, n = themes.counter_evidence(F.lit("Payment and delivery"), F.lit("any"))
    got = df.select(text.alias("t"), n.alias("n")).first()
    assert got.n == 3 and "3 reviews report positive, fast delivery" in got.t and '"text 1..."' in got.t
    none, zero = themes.counter_evidence(F.lit("Other"), F.lit("any"))
    got = df.select(none.alias("t"), zero.alias("n")).first()
    assert (got.t, got.n) == ("No contradictory evidence was found after explicitly reviewing all 1,602 dataset reviews.", 0)
    assert len(rules.EVIDENCE_GROUPS) == 4
