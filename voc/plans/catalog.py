"""The registered queries: name -> function of (session, table folder)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voc import rules, wording as w
from voc.functions import scores
from voc.functions.classify import is_spam, noise_state
from voc.functions.text import clean_text, cut, event_time, kept_tokens, paraphrase, redact, split_list, word_count
from voc.operators import (
    clusters, dashboard, density, embedding, extraction, feedback, forest, frequent, history, keywords, near, neighbours, note, pii, report, search,
    stability, themes, vectors,
)
from voc.operators.loads import Loads
from voc.plans import theme_report
from voc.plans.feedback_view import feedback_view, table
from voc.plans.samples import proposals
from voc.schemas import CLEANED, RESULT_THEME, THEME_COLUMNS
from voc.settings import DEFAULT, Settings
from voc.sources import files, payloads, raw
from voc.sources.json_array import write_json_array
from voc.storage import materialize, scratch_path, spread

LIST_SEP = " | "
RULES = rules.theme_rules(DEFAULT)
STOP_WORDS = rules.stop_words(DEFAULT)


def flat(df: DataFrame) -> DataFrame:
    """Lists as text, so that both engines hash the same values."""
    return df.select(*[
        F.concat_ws(LIST_SEP, f.name).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name)
        for f in df.schema.fields
    ])


def big(*names: str):
    return [F.col(n).cast("bigint").alias(n) for n in names]


# ---------------------------------------------------------------- inputs
def cleaned(spark, sf):
    return feedback.clean(feedback.long_enough(feedback_view(spark, sf)))


def classified(spark, sf):
    return theme_report.classified_feedback(feedback_view(spark, sf))


def tables(spark, sf):
    return theme_report.cluster_tables(theme_report.classified_feedback(feedback_view(spark, sf)))


def theme_rows(spark, sf):
    return theme_report.theme_table(theme_report.classified_feedback(feedback_view(spark, sf)))


# ---------------------------------------------------------------- sources
def _play_reviews(spark, sf):
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(
        d.alias("pos"), d.cast("string").alias("reviewId"), F.when(d % 11 != 0, F.col("text")).alias("content"),
        F.when(d % 13 != 0, d % 6).cast("int").alias("score"),
        F.timestamp_seconds(F.lit(1704067200) + d * 60).alias("at"), (d % 50).cast("int").alias("thumbsUpCount"),
        F.when(d % 3 == 0, F.timestamp_seconds(F.lit(1704067200) + d * 90)).alias("repliedAt"),
    )


def _app_reviews(spark, sf):
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(
        d.alias("pos"), F.concat(F.lit("user"), d.cast("string")).alias("userName"), F.col("text").alias("review"),
        F.when(d % 7 != 0, d % 6).cast("int").alias("rating"), F.lit("").alias("date"),
        F.when(d % 5 != 0, F.concat(F.lit("r"), d.cast("string"))).alias("review_id"),
    )


def _reddit_items(spark, sf):
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(
        d.alias("pos"), F.concat(F.lit("sub_"), d.cast("string")).alias("id"), F.lit("india").alias("subreddit"),
        F.col("text"), (d % 9).cast("int").alias("score"), F.when(d % 4 != 0, F.concat(F.lit("https://x/"), d.cast("string"))).alias("url"),
        (F.lit(1704067200) + d).alias("created_utc"), F.lit("post").alias("type"),
    )


def _landed(spark, df, name):
    path = scratch_path(spark, name)
    files.write_json_lines(df, path)
    return path


def _from_sources(spark, sf, **paths):
    """Loads the landed files; sources without a path point to a folder that does not exist."""
    missing = scratch_path(spark, "missing")
    return raw.load_feedback(
        spark, paths.get("play", missing), paths.get("app", missing), paths.get("reddit", missing), array_files=False
    )


def play_source(spark, sf):
    return _from_sources(spark, sf, play=_landed(spark, payloads.play_records(_play_reviews(spark, sf)), "play"))


def app_source(spark, sf):
    return _from_sources(spark, sf, app=_landed(spark, _app_reviews(spark, sf), "app"))


def reddit_source(spark, sf):
    return _from_sources(spark, sf, reddit=_landed(spark, _reddit_items(spark, sf), "reddit"))


def play_array(spark, sf):
    """Reviews landed as JSON arrays, which many tasks read back; the place in the arrays is the position."""
    path = scratch_path(spark, "play_array")
    rows = payloads.play_records(_play_reviews(spark, sf)).repartitionByRange("pos").sortWithinPartitions("pos")
    write_json_array(rows.drop("pos"), path)
    missing = scratch_path(spark, "missing")
    return raw.load_feedback(spark, path, missing, missing)


def two_loads(spark, sf):
    """Every second document as a first load, the others as a second one against the first one's store."""
    path, kept = scratch_path(spark, "loads"), []
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), "text")
    for number in (1, 2):
        load = Loads(spark, path)
        new = load.new_rows(rows.filter(F.pmod("ord", F.lit(2)) == number - 1)).select("ord", F.lit(number).cast("bigint").alias("load"))
        kept.append(materialize(new, "load"))
        load.commit()
    return kept[0].unionByName(kept[1]).select(F.col("ord").alias("doc_id"), "load")


def chosen_sources(spark, sf):
    """All three landed, two chosen."""
    loaded = raw.load_feedback(
        spark, _landed(spark, payloads.play_records(_play_reviews(spark, sf)), "play"),
        _landed(spark, _app_reviews(spark, sf), "app"), _landed(spark, _reddit_items(spark, sf), "reddit"),
        Settings(sources=("play_store", "reddit")), array_files=False,
    )
    return feedback.source_counts(loaded)


def review_dates(spark, sf):
    return payloads.play_records(_play_reviews(spark, sf)).select("reviewId", "at", "repliedAt")


def _payload(spark, sf, *entries):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("page"), F.to_json(F.struct(*entries)).alias("payload"))


def _label(col):
    return F.struct(col.alias("label"))


def feed_payload(spark, sf):
    d = F.col("doc_id")
    app_entry = F.struct(
        _label(F.lit("app")).alias("id"), _label(F.lit("Some app")).alias("title"), _label(F.lit("text")).alias("content"),
        F.lit(None).cast("struct<label:string>").alias("im:rating"), _label(F.lit("name")).alias("im:name"),
        F.struct(_label(F.lit("maker")).alias("name")).alias("author"),
    )
    rating = F.when(d % 5 == 0, "n/a").otherwise((d % 6).cast("string"))
    review = F.struct(
        _label(F.concat(F.lit("e"), d.cast("string"))).alias("id"),
        _label(F.when(d % 3 != 0, F.concat(F.lit("Title "), d.cast("string"))).otherwise("")).alias("title"),
        _label(F.when(d % 4 != 0, F.col("text")).otherwise("")).alias("content"),
        F.when(d % 7 != 0, _label(rating)).alias("im:rating"),
        F.lit(None).cast("struct<label:string>").alias("im:name"),
        F.struct(_label(F.concat(F.lit("u"), d.cast("string"))).alias("name")).alias("author"),
    )
    body = F.struct(F.array(app_entry, review).alias("entry")).alias("feed")
    return payloads.feed_reviews(_payload(spark, sf, body))


def library_payload(spark, sf):
    d = F.col("doc_id")
    return payloads.library_reviews(_payload(
        spark, sf, F.concat(F.lit("u"), d.cast("string")).alias("userName"),
        F.when(d % 3 != 0, F.concat(F.lit("Title "), d.cast("string"))).otherwise("").alias("title"),
        F.when(d % 4 != 0, F.col("text")).otherwise("").alias("review"), (d % 6).cast("string").alias("rating"),
        F.lit("2024-01-01T00:00:00").alias("date"), d.cast("string").alias("id"),
    ))


def _submissions(spark, sf):
    """Every id arrives twice, as from two search terms. Each page also holds a post that is too short."""
    d = F.col("doc_id")

    def post(mark: str, body):
        return F.struct(
            F.concat(F.lit(mark), F.floor(d / 2).cast("string")).alias("id"),
            F.concat(F.lit("T"), (d % 10).cast("string")).alias("title"), body.alias("selftext"),
            F.lit("india").alias("subreddit"), (d % 9).cast("int").alias("score"),
            F.when(d % 2 == 0, F.concat(F.lit("https://x/"), d.cast("string"))).alias("full_link"), d.alias("created_utc"),
        )

    return _payload(spark, sf, F.array(post("", F.col("text")), post("s", F.lit("short"))).alias("data"))


def _comments(spark, sf):
    """Each page also holds a removed comment and one that is too short."""
    d = F.col("doc_id")

    def comment(mark: str, body):
        return F.struct(
            F.concat(F.lit(mark), F.floor(d / 2).cast("string")).alias("id"), body.alias("body"),
            F.lit("delhi").alias("subreddit"), (d % 4).cast("int").alias("score"),
            F.concat(F.lit("/r/delhi/"), d.cast("string")).alias("permalink"), d.alias("created_utc"),
        )

    bodies = (("", F.col("text")), ("r", F.lit("[removed]")), ("s", F.lit(" short ")))
    return _payload(spark, sf, F.array(*[comment(m, b) for m, b in bodies]).alias("data"))


def forum_payload(spark, sf):
    posts, comments = payloads.forum_posts(_submissions(spark, sf)), payloads.forum_comments(_comments(spark, sf))
    return payloads.forum_items(posts, comments)


def csv_files(spark, sf):
    """Clean feedback written as CSV and read back."""
    path = scratch_path(spark, "cleaned-csv")
    missing = {"date": F.lit(None).cast("string"), "url": F.lit(None).cast("string")}
    files.write_csv(cleaned(spark, sf).withColumns(missing).select(*CLEANED.fieldNames()), path)
    back = files.read_csv(spark, path, CLEANED)
    return feedback.noise_flagged(back).select("ord", "id", "source", "text", "rating", "upvotes", "cleaned_text", "is_noise")


def unnumbered_sources(spark, sf):
    """Files without positions: rows, different positions and order of the sources."""
    play = payloads.play_records(_play_reviews(spark, sf)).drop("pos")
    loaded = raw.load_feedback(
        spark, _landed(spark, play, "play"), _landed(spark, _app_reviews(spark, sf).drop("pos"), "app"),
        _landed(spark, _reddit_items(spark, sf).drop("pos"), "reddit"), array_files=False,
    )
    per_source = loaded.groupBy("source").agg(
        F.count("*").alias("n"), F.count_distinct("ord").alias("positions"), F.min("ord").alias("least"), F.max("ord").alias("most")
    )
    order = Window.orderBy("least")  # over three rows
    return per_source.select(
        "source", "n", "positions", F.row_number().over(order).cast("bigint").alias("place"),
        (F.coalesce(F.lag("most").over(order), F.lit(-1)) < F.col("least")).alias("after_the_last"),
    )


def english_rows(spark, sf):
    docs = table(spark, sf, "documents")
    share = F.round(feedback.english_share(F.col("text")), 6).alias("english_share")
    return feedback.english_rows(docs, "lang").select("doc_id", share)


def source_counts(spark, sf):
    return feedback.source_counts(feedback_view(spark, sf))


def source_limits(spark, sf):
    limited = feedback.limit_per_source(feedback_view(spark, sf), {"play_store": 200, "app_store": 100})
    return limited.select("ord", "source")


def search_terms(spark, sf):
    hits = feedback.search_terms(feedback_view(spark, sf), ("Delivery", "order", "app", "refund"))
    return hits.select("ord", F.col("term_no").cast("bigint").alias("term_no"), "term")


def search_terms_once(spark, sf):
    """Items found by several terms kept once, as first found: by term, then by position."""
    hits = feedback.search_terms(feedback_view(spark, sf), ("Delivery", "order", "app", "refund"))
    found = hits.withColumn("found", F.struct("term_no", "ord"))
    return feedback.first_per_id(found, order="found").select("id", "ord", "term")


# ---------------------------------------------------------------- text
def ingested(spark, sf):
    return feedback.ingest(feedback_view(spark, sf))


def cleaned_texts(spark, sf):
    text = clean_text(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", text.alias("cleaned_text"), F.length(text).cast("bigint").alias("chars"), F.lower(text).alias("low"),
    )


def clean_feedback(spark, sf):
    return cleaned(spark, sf).select("ord", "id", "source", "rating", "cleaned_text")


def spam_flags(spark, sf):
    view = feedback_view(spark, sf).withColumn("cleaned_text", clean_text(F.col("text")))
    return feedback.masked(view).select("ord", is_spam(F.col("mask")).alias("is_spam"))


def noise_flags(spark, sf):
    return feedback.noise_flagged(cleaned(spark, sf)).select("ord", "is_noise")


def noise_flags_raw(spark, sf):
    """Rows without a cleaned text: the text itself is looked at."""
    return feedback.noise_flagged(feedback_view(spark, sf).select("ord", "text")).select("ord", "is_noise")


def noise_states(spark, sf):
    return feedback.masked(cleaned(spark, sf)).select("ord", noise_state(F.col("mask")).alias("state"))


def fuzzy_duplicates(spark, sf):
    return near.similar_to_earlier(cleaned(spark, sf).select("ord", "cleaned_text"))


def noise_filtered(spark, sf):
    flagged = materialize(feedback.noise_flagged(cleaned(spark, sf)).select("ord", "cleaned_text", "is_noise"), "flagged")
    return feedback.drop_noise(flagged).select("ord", "cleaned_text")


def noise_fallback(spark, sf):
    """Only noise is left: everything is kept."""
    only_noise = feedback.noise_flagged(cleaned(spark, sf)).where("is_noise").select("ord", "cleaned_text", "is_noise")
    return feedback.drop_noise(materialize(only_noise, "only_noise")).select("ord", "cleaned_text")


def event_times(spark, sf):
    d = F.col("doc_id")
    seconds = F.lit(1704067200) + d * 60
    date = (
        F.when(d % 4 == 0, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"))
        .when(d % 4 == 1, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"))
        .when(d % 4 == 2, seconds.cast("string")).otherwise("")
    )
    return table(spark, sf, "documents").select(
        "doc_id", F.date_format(event_time(date), "yyyy-MM-dd HH:mm:ss").alias("event_ts")
    )


def redacted_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", redact(F.col("text")).alias("redacted"))


def paraphrases(spark, sf):
    return cleaned(spark, sf).select("ord", paraphrase(F.col("cleaned_text"), w.NOTE_QUOTE_CHARS).alias("paraphrased"))


def cut_quotes(spark, sf):
    return cleaned(spark, sf).select(
        "ord", cut(F.col("cleaned_text"), rules.RULE_QUOTE_CHARS).alias("long_quote"),
        cut(F.col("cleaned_text"), w.EVIDENCE_CHARS, "...").alias("short_quote"),
    )


def word_counts(spark, sf):
    text = F.concat(F.lit("## "), F.regexp_replace("text", "\n", "\n- "))
    return table(spark, sf, "documents").select("doc_id", word_count(text).alias("words"))


def list_items(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.posexplode(split_list(F.col("text"))).alias("i", "item")
    ).select("doc_id", (F.col("i") + 1).cast("bigint").alias("place"), "item")


# ---------------------------------------------------------------- clusters
def issue_domains(spark, sf):
    return clusters.classify(cleaned(spark, sf)).select("ord", "sub_domain")


def review_sentiment(spark, sf):
    return clusters.classify(cleaned(spark, sf)).select("ord", "rating", "sentiment")


def cluster_assignment(spark, sf):
    rows = theme_report.classified_feedback(feedback_view(spark, sf))
    return clusters.assign_clusters(rows).select("ord", "sub_domain", *big("cluster_id"))


def domain_prevalence(spark, sf):
    out = theme_report.domain_prevalence(feedback_view(spark, sf))
    return out.select(*big("cluster_id"), *[c for c in out.columns if c != "cluster_id"])


def cluster_sentiment(spark, sf):
    stats = clusters.with_scores(clusters.cluster_stats(classified(spark, sf)))
    return stats.select("sub_domain", "n", *[f"{m}_pct" for m in rules.SENTIMENT_ORDER], "dominant",
                        F.col("sentiment").alias("summary"), "mixed_moods")


def cluster_signal(spark, sf):
    stats = clusters.with_scores(clusters.cluster_stats(classified(spark, sf)))
    return stats.select("sub_domain", "n", "chars", "cluster_ord", F.concat_ws(",", "sources").alias("sources"),
                        "signal_strength_score")


def cluster_samples(spark, sf):
    rows = theme_report.classified_feedback(feedback_view(spark, sf))
    return clusters.texts_of(rows, clusters.sampled_rows(rows)).select("sub_domain", *big("place"), "ord", "cleaned_text")


def spot_check(spark, sf):
    rows = classified(spark, sf)
    picked = clusters.sampled_rows(rows, rules.SPOT_CHECK_ROWS)
    return clusters.texts_of(rows, picked).select("sub_domain", *big("place"), "ord", "cleaned_text")


def percentile_prevalence(spark, sf):
    stats = clusters.percentile_scores(clusters.cluster_stats(classified(spark, sf)))
    return stats.select("sub_domain", "n", F.round("percent_rank", 6).alias("percent_rank"), "percentile_score")


def rank_stability(spark, sf):
    out = clusters.rank_stability(clusters.cluster_stats(classified(spark, sf)))
    return out.select(*big("size"), "clusters", "reviews", F.round("rank_correlation", 6).alias("rank_correlation"))


def rank_intervals(spark, sf):
    out = stability.intervals(classified(spark, sf))
    return out.select(
        "sub_domain", *big("n"), "share", *big("rank"), "share_low", "share_high", "score_low", "score_high", *big("rank_low", "rank_high")
    )


def range_scores(spark, sf):
    """Twenty of sixty days from the merged daily states of two halves; a row's day is its ``ord`` modulo 60."""
    rows = classified(spark, sf)
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("ord", F.lit(60)).cast("int"))
    halves = [history.daily_state(rows.filter(F.pmod("ord", F.lit(7)) < 3), day), history.daily_state(rows.filter(F.pmod("ord", F.lit(7)) >= 3), day)]
    state = materialize(history.merged_states(*halves), "daily_state")
    out = history.scores_between(state, dt.date(2024, 1, 11), dt.date(2024, 1, 30))
    return out.select(
        *big("cluster_id"), "sub_domain", *big("n", "total"), F.concat_ws(LIST_SEP, "sources").alias("sources"), F.col("sentiment").alias("summary"),
        "prevalence_score", "signal_strength_score",
    )


def cluster_keywords(spark, sf):
    t = tables(spark, sf)
    return t.stats.select(*big("cluster_id"), "sub_domain").join(
        t.keywords.select("sub_domain", F.concat_ws(",", "keywords").alias("keywords")), "sub_domain"
    )


def frequent_keywords(spark, sf):
    """The eight most frequent words of each cluster by sketches and a second pass over their candidates."""
    rows = classified(spark, sf).select(F.col("sub_domain").alias("group"), kept_tokens("cleaned_text", STOP_WORDS).alias("terms"))
    return frequent.top_terms(rows, rules.TOP_KEYWORDS).select(F.col("group").alias("sub_domain"), *big("place"), "term", "n")


def fallback_keywords(spark, sf):
    found = keywords.fallback_keywords(clusters.cluster_ids(classified(spark, sf)))
    return found.select("sub_domain", F.concat_ws(",", "keywords").alias("keywords"))


def term_counts(spark, sf):
    return keywords.term_counts(classified(spark, sf), STOP_WORDS).select("term", *big("tf", "df"))


def topic_words(spark, sf):
    out = keywords.topic_words(classified(spark, sf), STOP_WORDS)
    return out.select("sub_domain", *big("place"), "term", *big("tf"), F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- extraction
def tagged(spark, sf):
    rows = theme_report.classified_feedback(feedback_view(spark, sf), RULES)
    return extraction.tagged(rows.select("ord", "source", "rating", "cleaned_text", "mask"), RULES)


def rule_matches(spark, sf):
    return extraction.labelled(tagged(spark, sf), RULES).select("ord", "theme_id", "label", "class")


def unclassified(spark, sf):
    return extraction.unclassified(tagged(spark, sf)).select("ord", "cleaned_text")


def rule_summary(spark, sf):
    counts = extraction.rule_counts(tagged(spark, sf), RULES)
    place = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("count"), "rule_no"))
    hist = F.array_join(F.transform(F.array_sort(F.map_entries("rating_dist")),
                                    lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return counts.select("theme_id", "label", "class", "count", "pct_of_substantive", hist.alias("rating_dist"),
                         place.cast("bigint").alias("place"))


def rule_quotes(spark, sf):
    return extraction.rule_quotes(tagged(spark, sf)).select("theme_id", *big("place"), "quote")


def unclassified_sample(spark, sf):
    return extraction.unclassified_sample(tagged(spark, sf)).select("ord", "cleaned_text")


def extraction_meta(spark, sf):
    return extraction.extraction_meta(classified(spark, sf))


def extraction_document(spark, sf):
    """The JSON document read back into one row per theme."""
    rows = theme_report.classified_feedback(feedback_view(spark, sf), RULES)
    tags = extraction.tagged(rows.select("ord", "source", "rating", "cleaned_text", "mask"), RULES)
    doc = extraction.extraction_document(rows, tags, RULES)
    entry = ("array<struct<theme_id:string,label:string,classification:string,count:bigint,pct_of_substantive:double,"
             "rating_dist:map<string,bigint>,sample_quotes:array<string>>>")
    body = F.from_json("document", f"meta struct<total_reviews:bigint,substantive_reviews:bigint>, "
                                   f"behavioral_themes {entry}, operational_themes {entry}, unclassified_count bigint")
    parsed = doc.select(body.alias("b"))
    return parsed.select(
        "b.meta.total_reviews", "b.meta.substantive_reviews", "b.unclassified_count",
        F.explode(F.concat("b.behavioral_themes", "b.operational_themes")).alias("t"),
    ).select("total_reviews", "substantive_reviews", "unclassified_count", "t.theme_id", "t.classification", "t.count",
             "t.pct_of_substantive", F.array_join("t.sample_quotes", LIST_SEP).alias("sample_quotes"))


# ---------------------------------------------------------------- labels
def counter_evidence(spark, sf):
    """Counter-evidence in all clean reviews for every proposed theme of a cluster's issue words."""
    t = tables(spark, sf)
    issues = t.stats.withColumn("primary_issue", F.explode(F.array(*map(F.lit, (
        "Payment Methods", "Delivery Experience", "Refunds / Returns", "Pricing / Fees", "Other")))))
    text, n = themes.counter_evidence(F.col("primary_issue"), F.col("sub_domain"))
    return issues.select("sub_domain", "primary_issue", text.alias("contradictory_evidence"), n.alias("opposing"))


def evidence_quotes(spark, sf):
    quotes = scores.evidence_quotes(F.col("sample_quotes"), F.col("primary_issue"))
    return proposals(spark, sf).select("doc_id", "primary_issue", F.concat_ws(LIST_SEP, quotes).alias("quotes"))


def confidence(spark, sf):
    p = proposals(spark, sf)
    level = scores.confidence_level(F.col("n"), F.col("relevance"))
    return p.select("doc_id", level.alias("confidence"),
                    scores.confidence_text(level, F.col("n"), F.col("sources"), F.col("e0_n")).alias("confidence_explanation"))


def reasoning_traces(spark, sf):
    trace = scores.reasoning_trace(F.col("observed_facts"), F.col("theme_name"), F.col("relevance"))
    return proposals(spark, sf).select("doc_id", "theme_name", trace.alias("reasoning_trace"))


CRITIC_COLUMNS = (
    "doc_id", "theme_name", "research_relevance", "relevance_reason", "behavioral_mechanism", "product_opportunity",
    "research_hypothesis", "research_questions", "out_of_scope_reason", "contradictory_evidence", "opposing",
    "reasoning_trace", "confidence", "confidence_explanation",
)


def critic_rules(spark, sf):
    return flat(themes.critic(proposals(spark, sf)).select(*CRITIC_COLUMNS))


LABEL_COLUMNS = (
    "sub_domain", "theme_name", "primary_issue", "research_relevance", "relevance_reason", "evidence_summary",
    "observed_facts", "observed_behavior", "behavioral_mechanism", "underlying_need", "barrier_or_driver",
    "business_impact", "confidence", "confidence_explanation", "signal_strength", "customer_journey_stage",
    "alternative_explanations", "contradictory_evidence", "product_opportunity", "research_hypothesis",
    "research_questions", "why_these_quotes_matter", "assumptions", "reasoning_trace", "out_of_scope_reason",
    "example_quotes", "keywords",
)


def labels(spark, sf):
    t = tables(spark, sf)
    return themes.heuristic_labels(t.stats, t.samples, t.keywords)


def heuristic_labels(spark, sf):
    return flat(labels(spark, sf).select(*big("cluster_id"), *LABEL_COLUMNS))


def label_prompts(spark, sf):
    t = tables(spark, sf)
    joined = t.stats.select("sub_domain").join(t.samples, "sub_domain").join(t.keywords, "sub_domain")
    return joined.select("sub_domain", themes.label_prompt(F.col("sample_quotes"), F.col("keywords")).alias("prompt"))


def question_prompts(spark, sf):
    return theme_rows(spark, sf).select(*big("position"), themes.question_prompt().alias("prompt"))


def reply_parsing(spark, sf):
    """Replies as objects, lists, empty lists and plain text; parsed fields with their defaults."""
    p = proposals(spark, sf)
    obj = F.to_json(F.struct("theme_name", "primary_issue", "observed_facts"))
    d = F.col("doc_id")
    reply = (
        F.when(d % 5 == 0, F.concat(F.lit("["), obj, F.lit("]"))).when(d % 5 == 1, "[]").when(d % 5 == 2, "no answer")
        .otherwise(obj)
    )
    parsed = p.select("doc_id", themes.parse_reply(reply).alias("r")).select("doc_id", "r.theme_name", "r.primary_issue", "r.observed_facts")
    return flat(parsed.select(*scores.with_defaults(parsed.columns)).withColumn(
        "observed_facts", F.coalesce("observed_facts", F.array().cast("array<string>"))))


# ---------------------------------------------------------------- scores
def actions(spark, sf):
    act = scores.action(F.col("relevance"), F.col("prev"), F.col("sig"))
    return proposals(spark, sf).select("doc_id", act.alias("action"), scores.action_rank(act).cast("bigint").alias("rank"))


def _themes_flat(df):
    return flat(df.select(*big("cluster_id"), *[c for c in THEME_COLUMNS if c != "cluster_id"]))


def scored_themes(spark, sf):
    return _themes_flat(themes.scored_themes(labels(spark, sf)))


def themes_same_name(spark, sf):
    return _themes_flat(themes.merge_same_names(themes.scored_themes(labels(spark, sf))))


def theme_renames(spark, sf):
    p = proposals(spark, sf).select(
        "doc_id", F.col("theme_name").alias("theme"), F.col("relevance").alias("research_relevance"),
        F.lit("given").alias("product_opportunity"), F.lit("given").alias("research_hypothesis"),
    )
    return themes.rename_themes(p)


def themes_standing(spark, sf):
    return _themes_flat(themes.merge_standing_themes(themes.merge_same_names(themes.scored_themes(labels(spark, sf)))))


def ranked_themes(spark, sf):
    return theme_rows(spark, sf).select(*big("position"), "theme", "action", "prevalence_score", "signal_strength_score")


def theme_insights(spark, sf):
    """Insight texts for proposed themes with an action and for the themes of the corpus."""
    p = proposals(spark, sf).select(
        "doc_id", F.col("theme_name").alias("theme"), "primary_issue", F.col("relevance").alias("research_relevance"),
        "out_of_scope_reason", scores.action(F.col("relevance"), F.col("prev"), F.col("sig")).alias("action"),
    )
    return themes.with_insights(p)


# ---------------------------------------------------------------- outputs
def results_table(spark, sf):
    return report.results_table(theme_rows(spark, sf))


def results_metadata(spark, sf):
    return report.result_metadata(theme_rows(spark, sf))


def results_document(spark, sf):
    """The result JSON written as a file and read back as theme rows."""
    path = scratch_path(spark, "results")
    files.write_document(report.results_document(theme_rows(spark, sf)), path)
    _, rows = files.read_results(spark, path)
    fields = [c for c in RESULT_THEME.fieldNames() if c != "cluster_id"]
    return flat(rows.select(*big("position", "cluster_id"), "total", *fields))


def markdown_report(spark, sf):
    return report.markdown_report(theme_rows(spark, sf))


def chat_context(spark, sf):
    return report.chat_context(theme_rows(spark, sf))


def last_messages(spark, sf):
    rows = dashboard.last_messages(table(spark, sf, "conversations"))
    return rows.select("conv_id", "turn", "role", "text", *big("back"))


def last_query(spark, sf):
    return dashboard.last_query(table(spark, sf, "conversations"))


def ranked_search(spark, sf):
    """The ten best documents for the last message of every conversation."""
    index = search.build(table(spark, sf, "documents"), "doc_id", "text")
    found = search.search(index, dashboard.last_query(table(spark, sf, "conversations")), "conv_id", "text")
    return found.select(F.col("query").alias("conv_id"), "rank", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


def _proposed_actions(spark, sf):
    act = scores.action(F.col("relevance"), F.col("prev"), F.col("sig"))
    return proposals(spark, sf).withColumns({
        "action": act, "theme": F.col("theme_name"), "example_quotes": F.col("sample_quotes"), "frequency": F.col("n"),
        "prevalence_score": F.col("prev"), "signal_strength_score": F.col("sig"), "research_relevance": F.col("relevance"),
        "product_opportunity": F.when(F.col("doc_id") % 3 == 0, w.TRUST_OPPORTUNITY).otherwise(""),
    })


def bucket_counts(spark, sf):
    return dashboard.bucket_counts(_proposed_actions(spark, sf))


def theme_search(spark, sf):
    return dashboard.explore(_proposed_actions(spark, sf), "monitor", " Refund ").select("doc_id", "theme", "action")


def theme_by_title(spark, sf):
    return dashboard.theme_by_title(theme_rows(spark, sf), w.ASSORTMENT_THEME).select("theme", *big("position"), "frequency")


def theme_badges(spark, sf):
    return dashboard.badges(_proposed_actions(spark, sf)).select(
        "doc_id", "prevalence_pct", "signal_pct", "action_badge", "action_label", "relevance_badge", "relevance_label"
    )


def theme_policies(spark, sf):
    p = _proposed_actions(spark, sf).withColumn("theme", F.col("doc_id").cast("string"))
    return dashboard.policies(p).withColumnRenamed("theme", "doc")


# ---------------------------------------------------------------- personal data
def _documents(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def pii_findings(spark, sf):
    return pii.scan(_documents(spark, sf)).select("doc_id", "line", "type", "match", "place")


def pii_feedback(spark, sf):
    return pii.scan(feedback_view(spark, sf).select("ord", "text")).select("ord", "line", "type", "match", "place")


def gate_documents(spark, sf):
    """The gate's JSON of every document with findings, read back."""
    doc = pii.gate_document(pii.scan(_documents(spark, sf)), "doc_id")
    finding = "array<struct<type:string,match:string,line:bigint>>"
    body = F.from_json("document", f"passed boolean, blockers_count bigint, findings {finding}")
    return doc.select("doc_id", body.alias("b")).select(
        "doc_id", "b.passed", "b.blockers_count", F.get("b.findings", F.lit(0))["type"].alias("first_type"),
        F.array_join(F.transform("b.findings", lambda f: f["match"]), LIST_SEP).alias("matches"),
    )


def pii_gate(spark, sf):
    return pii.gate(pii.scan(_documents(spark, sf)))


def redact_rescan(spark, sf):
    return pii.gate(pii.scan(pii.redacted(_documents(spark, sf))))


# ---------------------------------------------------------------- weekly note
def note_rows(spark, sf):
    return note.note_rows(theme_rows(spark, sf))


def _note(spark, sf):
    themes_ranked = theme_rows(spark, sf)
    total = themes_ranked.agg(F.max("total")).scalar()
    return note.weekly_note(note.note_rows(themes_ranked), "2024-01-07", total)


def weekly_note(spark, sf):
    return _note(spark, sf).select("title", "word_count", "total", "markdown")


def note_json(spark, sf):
    """The note's JSON read back: one row per theme."""
    doc = note.note_document(_note(spark, sf), F.lit("2024-01-07T08:00:00Z"))
    entry = "array<struct<id:string,headline:string>>"
    body = F.from_json("document", (
        f"title string, word_count bigint, max_words bigint, themes {entry}, quotes array<struct<theme_id:string,paraphrased:string>>, "
        "actions array<struct<theme_id:string,text:string>>, metadata struct<generated_at:string,total_feedback_analyzed:bigint>"
    ))
    rows = doc.select(body.alias("b")).select("b.*", F.posexplode("b.themes").alias("i", "t"))
    return rows.select(
        "title", "word_count", "max_words", (F.col("i") + 1).cast("bigint").alias("no"), "t.id", "t.headline",
        F.get("quotes", F.col("i"))["paraphrased"].alias("paraphrased"), F.get("actions", F.col("i"))["text"].alias("action"),
        "metadata.generated_at", F.col("metadata.total_feedback_analyzed").alias("total"),
    )


def long_note(spark, sf):
    """A note over 250 words: its quotes are shortened."""
    themes_ranked = theme_rows(spark, sf)
    rows = note.note_rows(themes_ranked).withColumn("paraphrased", F.concat(F.lit('"'), F.repeat(F.lit("word "), F.lit(100)), F.lit('"')))
    return note.weekly_note(rows, "2024-01-07", themes_ranked.agg(F.max("total")).scalar()).select("title", "word_count", "total", "markdown")


def note_gate(spark, sf):
    """The finished note through the personal-data gate."""
    return pii.gate(pii.scan(_note(spark, sf).select(F.col("markdown").alias("text"))))


# ---------------------------------------------------------------- vectors
def text_vectors(spark, sf):
    return flat(vectors.text_vectors(classified(spark, sf)))


def text_kmeans(spark, sf):
    return vectors.kmeans(table(spark, sf, "embeddings"), "vec_id", "embedding")


def kmeans_check(spark, sf):
    return vectors.kmeans_check(table(spark, sf, "embeddings"), "vec_id", "embedding")


def tfidf_weights(spark, sf):
    """Exact TF-IDF per review: terms, squared length, largest weight."""
    weights = vectors.tfidf(classified(spark, sf))
    return weights.groupBy("ord").agg(
        F.count("*").alias("terms"), F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("squares"),
        F.round(F.max("weight"), 6).alias("largest"),
    )


def word_pairs(spark, sf):
    """How often two of the 2,000 most frequent words stand at most four words apart, and their mutual information if positive."""
    words = materialize(classified(spark, sf).select(kept_tokens("cleaned_text", STOP_WORDS).alias("words")), "words")
    pairs = materialize(embedding.word_pairs(words, materialize(embedding.vocabulary(words, 2000), "vocabulary")), "pairs")
    found = embedding.information(pairs).filter("a <= b")
    return pairs.join(found, ["a", "b"], "left").select("a", "b", "n", F.round("w", 6).alias("information"))


def learnt_vectors(spark, sf):
    rows = classified(spark, sf)
    out = embedding.learnt_vectors(rows, STOP_WORDS, 16)
    return out.select("ord", F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)), 4).alias("length"), F.size("vector").cast("bigint").alias("numbers"))


def cluster_number(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(vectors.cluster_number(F.count("*")).alias("k"))


def centroid_distances(spark, sf):
    out = vectors.centroid_distances(table(spark, sf, "embeddings"), "vec_id", "label", "embedding")
    return out.select("vec_id", *big("label"), "own_cosine", "best_cosine", *big("nearest"))


def exact_neighbours(spark, sf):
    """The 15 nearest vectors of every hundredth one, from all cells of the index."""
    found = neighbours.neighbours(table(spark, sf, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0, probes=None)
    return found.select(F.col("key").alias("vec_id"), "rank", "neighbour", F.round("cosine", 6).alias("cosine"))


def near_neighbours(spark, sf):
    """As ``exact_neighbours``, from as many cells as the tuning finds enough."""
    found = neighbours.neighbours(table(spark, sf, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0)
    return found.select(F.col("key").alias("vec_id"), "rank", "neighbour", F.round("cosine", 6).alias("cosine"))


def neighbour_recall(spark, sf):
    row = neighbours.recall(table(spark, sf, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0)
    return row.select("queries", "neighbours", (F.col("found") >= 0.9 * F.col("neighbours")).alias("enough"))


def mutual_forest(spark, sf):
    """The spanning forest of the mutual reachability links of all vectors: links, forest links and its weight."""
    near = neighbours.neighbours(table(spark, sf, "embeddings"), "vec_id", "embedding", probes=None)
    links = density.mutual_links(near)
    kept, _ = forest.spanning_forest(links)
    kept = kept.agg(F.count("*").alias("kept"), F.round(F.sum("w"), 6).alias("weight"))
    return kept.withColumn("links", links.agg(F.count("*")).scalar())


def density_clusters(spark, sf):
    return density.density_clusters(table(spark, sf, "embeddings"), "vec_id", "embedding")


QUERIES = {
    f.__name__: f
    for f in (
        play_source, play_array, two_loads, app_source, reddit_source, chosen_sources, review_dates, feed_payload, library_payload,
        forum_payload, csv_files, unnumbered_sources, english_rows, source_counts, source_limits, search_terms, search_terms_once,
        ingested, cleaned_texts, clean_feedback, spam_flags, noise_flags, noise_flags_raw, noise_states, fuzzy_duplicates, noise_filtered, noise_fallback, event_times,
        redacted_texts, paraphrases, cut_quotes, word_counts, list_items,
        issue_domains, review_sentiment, cluster_assignment, domain_prevalence, cluster_sentiment, cluster_signal,
        cluster_samples, spot_check, percentile_prevalence, rank_stability, rank_intervals, range_scores, cluster_keywords, frequent_keywords, fallback_keywords, term_counts, topic_words,
        rule_matches, unclassified, rule_summary, rule_quotes, unclassified_sample, extraction_meta, extraction_document,
        counter_evidence, evidence_quotes, confidence, reasoning_traces, critic_rules, heuristic_labels, label_prompts,
        question_prompts, reply_parsing,
        actions, scored_themes, themes_same_name, theme_renames, themes_standing, ranked_themes, theme_insights,
        results_table, results_metadata, results_document, markdown_report, chat_context, last_messages, last_query, ranked_search,
        bucket_counts, theme_search, theme_by_title, theme_badges, theme_policies,
        pii_findings, pii_feedback, gate_documents, pii_gate, redact_rescan,
        note_rows, weekly_note, note_json, long_note, note_gate,
        text_vectors, tfidf_weights, text_kmeans, kmeans_check, cluster_number, centroid_distances,
        exact_neighbours, near_neighbours, neighbour_recall, mutual_forest, density_clusters, word_pairs, learnt_vectors,
    )
}
