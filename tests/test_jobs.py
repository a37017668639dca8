import datetime as dt
import json
from pathlib import Path

from voc import jobs
from voc.settings import Settings

ACME = Settings(brand="Acme", brand_terms=("acme",))


def text_of(path: Path) -> str:
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_both_jobs(spark, tmp_path):
    play = [{"reviewId": str(i), "content": f"refund number {i} was denied for my acme order of a charger", "score": 1} for i in range(40)]
    play += [{"reviewId": f"f{i}", "content": f"handling fee {i} is too high for a small item", "score": 2} for i in range(10)]
    play += [{"reviewId": "n", "content": "late delivery, the guy never came"}, {"reviewId": "s", "content": "use my code for free recharge"}]
    (tmp_path / "play.json").write_text(json.dumps(play))
    out = tmp_path / "out"
    assert jobs.analyse(spark, str(tmp_path / "play.json"), "none-a.json", "none-r.json", str(out), ACME)

    results = json.loads(text_of(out / "results.json"))
    assert results["metadata"]["total_feedback_analyzed"] == 50
    assert sum(t["frequency"] for t in results["themes"]) == 50
    assert results["metadata"]["coverage_warning"].startswith("Coverage Warning")
    top = results["themes"][0]
    assert top["theme"] == "Low Trust in High-Value Purchases" and top["research_questions"][0].endswith("on Acme.")
    rules = json.loads(text_of(out / "themes_by_rule.json"))
    assert rules["meta"]["source_coverage"]["play_store"] == 50 and rules["behavioral_themes"][0]["theme_id"] == "B3"
    assert text_of(out / "summary.md").startswith("# AI Product Discovery Engine")
    assert text_of(out / "results.csv").startswith("Theme,Primary Issue")

    week = tmp_path / "week"
    assert jobs.weekly(spark, str(out / "results.json"), str(week), dt.date(2024, 1, 7), ACME)
    assert text_of(week / "note.md").startswith("# Acme — Weekly Customer Discovery Pulse (2024-01-07)")
    assert json.loads(text_of(week / "gate.json")) == {"passed": True, "blockers_count": 0, "findings": []}


def test_nothing_loaded(spark, tmp_path):
    assert not jobs.analyse(spark, "none-p.json", "none-a.json", "none-r.json", str(tmp_path / "out"))


def test_gate_stops_a_note_with_a_handle(spark, tmp_path):
    theme = {"cluster_id": 1, "theme": "T", "primary_issue": "Other", "research_relevance": "DIRECT", "frequency": 3, "prevalence_score": 1.0,
             "signal_strength_score": 2.5, "example_quotes": ["ask @someone about it"]}
    path = tmp_path / "results.json"
    path.write_text(json.dumps({"metadata": {"total_feedback_analyzed": 3}, "themes": [theme]}, indent=2))
    assert not jobs.weekly(spark, str(path), str(tmp_path / "week"), dt.date(2024, 1, 7), ACME)
    gate = json.loads(text_of(tmp_path / "week" / "gate.json"))
    assert gate["findings"] == [{"type": "handle", "match": "@user", "line": 7}]


def test_stop_words_from_a_file(spark, tmp_path):
    from voc import rules
    from voc.functions.text import kept_tokens
    from voc.sources import files

    (tmp_path / "words.txt").write_text("Bill\ninterest\n\n refund \n")
    own = Settings(brand_terms=("acme",), english_stop_words=files.read_words(spark, str(tmp_path / "words.txt")))
    rows = spark.createDataFrame([("the bill and interest of a refund at acme whenever it was late",)], "t string")
    kept = {name: rows.select(kept_tokens("t", rules.stop_words(s))).first()[0] for name, s in (("own", own), ("default", ACME))}
    assert "bill" in kept["default"] and "the" not in kept["default"] and "whenever" in kept["default"]
    assert not {"bill", "interest", "refund", "acme"} & set(kept["own"]) and "whenever" in kept["own"]
