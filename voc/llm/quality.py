"""Quality rules under weak supervision, in DataFrame functions only.

Every rule votes good (1), bad (-1) or abstains (0) on a document. Documents with equal votes are counted together (at most
3 to the number of rules rows); expectation-maximisation over these counts estimates how often each rule is right on good
and on bad documents, and how common good documents are. The posterior probability of "good" then decides, instead of asking that
all rules pass. Each step of the estimation is one small aggregate; the driver holds the estimates alone.

Rows: null and empty texts have no words: counts 0, every rule abstains, ``base_failed`` is true. Repeated rows are judged
alike. An empty table gives an empty result (the estimates stay at their start). Columns of the table other than the text
are carried along and may have any name but those returned here.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voc.llm.columns import shielded
from voc.storage import materialize

SPACE = " \t\n\x0b\x0c\r"          # fixed value: the characters that separate words
SYMBOLS = "#*$%&|<>"               # fixed value
WINDOW = 3
MIN_WORDS, MAX_REPEATED = 50, 0.5  # the base rules
ROUNDS, SETTLED = 40, 1e-5
KEEP_ABOVE = 0.5

#: name: (feature, good, bad) - the rule votes where the feature satisfies the condition and abstains in between
RULES = {
    "symbols": ("n_symbols / n_words", "x = 0", "x > 0.1"),
    "repeated_words": ("n_repeat_words / n_words", "x < 0.1", "x > 0.45"),
    "repeated_lines": ("n_dup_lines / n_lines", "x < 0.1", "x > 0.5"),
    "word_length": ("word_chars / n_words", "x between 4 and 6.5", "x < 3 or x > 9"),
    "upper_case": ("n_upper / word_chars", "x < 0.1", "x > 0.3"),
    "words_with_letters": ("n_alpha / n_words", "x > 0.95", "x < 0.75"),
    "line_ends": ("n_ended / n_lines", "x >= 0.6", "n_lines >= 4 and x < 0.2"),
    "vocabulary": ("n_distinct / sqrt(n_words)", "x > 5", "x < 3"),
    "exclamations": ("n_exclaim / n_words", "x < 0.1", "x > 0.3"),
    "letters": ("n_letters / word_chars", "x > 0.92", "x < 0.8"),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: Column, hashes: Column) -> Column:
    """Positions of windows that occur at least twice, ascending; null where no window repeats."""
    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.array_sort(pairs))


def features(docs: DataFrame) -> DataFrame:
    """The documents with the counts the rules look at; every intermediate array is built once."""
    text = F.coalesce("text", F.lit(""))
    blank = f"[{SPACE}]+"
    body = F.btrim(text, F.lit(SPACE))
    words = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, blank))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    w = F.col("_words")
    step = docs.withColumns({"_words": words, "_lines": lines})
    step = step.withColumn(
        "_hashes",
        F.when(F.size(w) < WINDOW, F.array().cast("array<bigint>")).otherwise(
            F.transform(
                F.slice(w, 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(1))),
                lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)]),
            )
        ),
    )
    step = step.withColumn("_sorted", repeated_words(w, F.col("_hashes")))
    s = F.col("_sorted")
    same = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
    at = F.array_sort(F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))
    step = step.withColumn("_at", at)
    p = F.col("_at")
    gaps = F.zip_with(F.slice(p, 2, F.size(p)), F.slice(p, 1, F.size(p) - 1), lambda b, a: F.least(F.lit(WINDOW), b - a))
    covered = F.aggregate(gaps, F.lit(WINDOW), lambda total, gap: total + gap)
    letters = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    return step.withColumns({
        "n_words": F.size(w).cast("bigint"),
        "word_chars": F.length(F.array_join(w, "")).cast("bigint"),
        "n_symbols": letters(f"[^{SYMBOLS}]+").cast("bigint"),
        "n_lines": F.size("_lines").cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_repeat_words": F.coalesce(F.when(F.size(p) > 0, covered), F.lit(0)).cast("bigint"),
        "n_upper": letters(r"[^\p{Lu}]+").cast("bigint"),
        "n_letters": letters(r"[^\p{L}\p{M}]+").cast("bigint"),
        "n_alpha": F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).cast("bigint"),
        "n_ended": F.size(F.filter("_lines", lambda x: F.substring(F.rtrim(x), -1, 1).isin(".", "!", "?", '"', ":"))).cast("bigint"),
        "n_distinct": F.size(F.array_distinct(w)).cast("bigint"),
        "n_exclaim": (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("bigint"),
    }).drop("_words", "_lines", "_hashes", "_sorted", "_at")


def votes() -> dict[str, Column]:
    out = {}
    for name, (feature, good, bad) in RULES.items():
        value = f"({feature.replace(' / ', ' / nullif(')}, 0))" if " / " in feature else feature
        test = lambda condition: condition.replace("x", value)
        out[f"v_{name}"] = F.expr(f"cast(case when {test(bad)} then -1 when {test(good)} then 1 else 0 end as tinyint)")
    return out


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEATED) * F.col("n_words"))


@dataclass(frozen=True)
class Estimates:
    """Share of good documents, and per rule how often its votes are right: on bad and on good documents.

    An abstention says nothing.
    """

    good: float
    right_on_bad: tuple[float, ...]
    right_on_good: tuple[float, ...]

    def posterior(self) -> Column:
        """Probability that a document with these votes is good."""
        odds = F.lit(math.log(self.good / (1 - self.good)))
        for name, bad, good in zip(RULES, self.right_on_bad, self.right_on_good):
            v = F.col(f"v_{name}")
            up, down = math.log(good / (1 - bad)), math.log((1 - good) / bad)
            odds = odds + F.when(v == 1, F.lit(up)).when(v == -1, F.lit(down)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-odds))


def start() -> Estimates:
    """One bad vote outweighs good votes of all other rules: a bad document often breaks one rule only."""
    n = len(RULES)
    return Estimates(0.8, (0.25,) * n, (0.997,) * n)


def estimate(patterns: DataFrame) -> Estimates:
    """Expectation-maximisation over ``v_*`` patterns with their ``count``.

    A rule's bad votes are held to be no rarer among bad documents than among good ones: without that the two classes could
    change places.
    """
    now = start()
    for _ in range(ROUNDS):
        p = now.posterior()
        weighed = patterns.withColumns({"_g": F.col("count") * p, "_b": F.col("count") * (1 - p)})
        sums = [F.sum(x).alias(x) for x in ("_g", "_b")] + [
            F.sum(F.when(F.col(f"v_{name}") == vote, F.col(x))).alias(f"{x}_{name}_{vote}")
            for name in RULES for vote in (1, -1) for x in ("_g", "_b")
        ]
        row = weighed.agg(*sums).first()
        if not row["_g"] and not row["_b"]:
            return now
        right: dict[str, list[float]] = {"_b": [], "_g": []}
        for name in RULES:
            votes_of = {(x, v): row[f"{x}_{name}_{v}"] or 0.0 for x in right for v in (1, -1)}
            bad, good = (
                (votes_of[x, v] + 0.5) / (votes_of[x, 1] + votes_of[x, -1] + 1.0) for x, v in (("_b", -1), ("_g", 1))
            )
            bad, good = (bad, good) if bad + good >= 1 else (1 - good, 1 - bad)
            right["_b"].append(min(max(bad, 1e-4), 1 - 1e-4))
            right["_g"].append(min(max(good, 1e-4), 1 - 1e-4))
        share = min(max(row["_g"] / (row["_g"] + row["_b"]), 0.5), 0.99)
        new = Estimates(share, tuple(right["_b"]), tuple(right["_g"]))
        flat = lambda e: [e.good, *e.right_on_bad, *e.right_on_good]
        moved = max(abs(a - b) for a, b in zip(flat(now), flat(new)))
        now = new
        if moved < SETTLED:
            break
    return now


def judged(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (default: all) with counts, votes, ``base_failed``, ``quality`` (posterior) and ``kept``.

    Counts and votes are written once; patterns and verdicts read them from there. The estimates come from the documents that
    the base rules leave open: what fails these is settled, and would teach the other rules its own few faults.
    """
    counted = features(docs)
    rest = counted.columns[len(docs.columns):]
    counted = counted.select(*(docs.columns if columns is None else columns), *rest)
    scored = materialize(counted.withColumns(votes()).withColumn("base_failed", base_failed()), "quality")
    names = [f"v_{name}" for name in RULES]
    open_ = scored.filter(~F.col("base_failed"))
    model = estimate(materialize(open_.groupBy(*names).count().coalesce(1), "vote_patterns"))
    return scored.withColumn("quality", model.posterior()).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_ABOVE)
    )


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows that pass, with the columns they came with."""
    rows, _, back = shielded(docs, "text")
    return back(judged(rows).filter("kept"))
