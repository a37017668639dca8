"""The two jobs a user starts: analyse loaded feedback, and write the weekly note from a result file.

``python -m voc.jobs analyse --play play.json --app app.json --reddit reddit.json --out results --brand Acme``
``python -m voc.jobs weekly --results results/results.json --out weekly --brand Acme``
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from voc import rules
from voc.operators import clusters, extraction, feedback, note, pii, report
from voc.operators.loads import Loads
from voc.plans import theme_report
from voc.schemas import CLEANED, FEEDBACK
from voc.settings import DEFAULT, Settings
from voc.sources import files
from voc.sources.raw import load_feedback
from voc.session import SETTINGS
from voc.storage import drop_scratch, materialize


def analyse(
    spark: SparkSession, play: str, app: str, reddit: str, out: str, settings: Settings = DEFAULT, array_files: bool = True,
    loads: str | None = None,
) -> bool:
    """Unified and filtered CSV, results as CSV, JSON and Markdown, rule themes as JSON. False if nothing was loaded.

    ``loads`` names a store of earlier loads: texts that one of them had are left out, and this load's are added at the end.
    """
    loaded = load_feedback(spark, play, app, reddit, settings, array_files)
    limits = {"play_store": settings.play_limit, "app_store": settings.app_store_limit}
    limits = {source: n for source, n in limits.items() if n is not None}
    rows = feedback.ingest(feedback.limit_per_source(loaded, limits)).select(*FEEDBACK.fieldNames())
    store = Loads(spark, loads) if loads else None
    unified = materialize(store.new_rows(rows) if store else rows, "unified")
    if unified.isEmpty():
        return False
    files.write_csv(unified, f"{out}/unified.csv")

    # cleaned and matched once, written once: everything below reads from there
    theme_rules = rules.theme_rules(settings)
    cleaned = clusters.classify(feedback.noise_flagged(feedback.clean(unified, theme_rules)))
    filtered = feedback.drop_noise(materialize(cleaned, "filtered"))
    files.write_csv(filtered.select(*CLEANED.fieldNames()), f"{out}/filtered.csv")

    themes = theme_report.theme_table(filtered, settings)
    files.write_csv(report.results_table(themes), f"{out}/results.csv")
    files.write_document(report.results_document(themes), f"{out}/results.json")
    files.write_document(report.markdown_report(themes, settings), f"{out}/summary.md")

    tagged = extraction.tagged(filtered, theme_rules)
    files.write_document(extraction.extraction_document(filtered, tagged, theme_rules), f"{out}/themes_by_rule.json")
    if store:
        store.commit()
    return True


def weekly(spark: SparkSession, results: str, out: str, day: dt.date, settings: Settings = DEFAULT) -> bool:
    """Note as Markdown and JSON, and the gate result; true if the gate lets the note pass."""
    metadata, themes = files.read_results(spark, results)
    total = metadata.select("total_feedback_analyzed").limit(1).scalar()
    built = materialize(note.weekly_note(note.note_rows(themes), day.isoformat(), total, settings), "note")
    if built.isEmpty():
        return False
    now = F.current_timestamp()
    stamp = F.date_format(F.to_utc_timestamp(now, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    files.write_document(built.select("markdown"), f"{out}/note.md")
    files.write_document(note.note_document(built, stamp), f"{out}/note.json")

    findings = materialize(pii.scan(built.select(F.col("markdown").alias("text"))), "findings")
    files.write_document(pii.gate_document(findings), f"{out}/gate.json")
    return findings.isEmpty()


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = parser.add_subparsers(dest="job", required=True)
    one, two = jobs.add_parser("analyse"), jobs.add_parser("weekly")
    for name in ("--play", "--app", "--reddit"):
        one.add_argument(name, default="missing.json")
    one.add_argument("--lines", action="store_true", help="inputs hold one JSON object per line")
    one.add_argument("--play-limit", type=int, default=DEFAULT.play_limit)
    one.add_argument("--app-limit", type=int, default=DEFAULT.app_store_limit)
    one.add_argument("--loads", help="folder of the store of earlier loads' texts")
    one.add_argument("--stop-words", help="file of common words that are no keywords, one a line, instead of the default list")
    one.add_argument("--sources", default=",".join(DEFAULT.sources))
    two.add_argument("--results", required=True)
    for job in (one, two):
        job.add_argument("--out", required=True)
        job.add_argument("--brand", default=DEFAULT.brand)
        job.add_argument("--brand-terms", default=",".join(DEFAULT.brand_terms))
    args = parser.parse_args()

    terms = tuple(t.strip().lower() for t in args.brand_terms.split(",") if t.strip())
    builder = SparkSession.builder.appName(f"voc-{args.job}")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if args.job == "analyse":
        settings = Settings(
            brand=args.brand, brand_terms=terms, play_limit=args.play_limit, app_store_limit=args.app_limit,
            sources=tuple(s.strip() for s in args.sources.split(",") if s.strip()),
            english_stop_words=files.read_words(spark, args.stop_words) if args.stop_words else None,
        )
        done = analyse(spark, args.play, args.app, args.reddit, args.out, settings, not args.lines, args.loads)
    else:
        done = weekly(spark, args.results, args.out, dt.date.today(), Settings(brand=args.brand, brand_terms=terms))
    drop_scratch(spark)
    spark.stop()
    raise SystemExit(0 if done else 1)


if __name__ == "__main__":
    main()
