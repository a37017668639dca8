import random
import re

from pyspark.sql import functions as F

from voc import rules
from voc.functions import classify, scores, text
from voc.functions.patterns import match_mask
from voc.settings import DEFAULT


def test_clean_text(spark):
    cases = {
        "a\r\n\tb   c ": "a b c",
        "see https://x.example/a?b=1 and www.ex.example for": "see and for",
        " x y\x1cz ": "x y z",
        "plain": "plain",
        "http://only.link": "",
        None: "",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string")
    assert df.where(text.clean_text(F.col("t")) != F.col("want")).count() == 0


def test_round1_equals_python_round(spark):
    pairs = [(c, n) for n in range(1, 161) for c in range(n + 1)]
    df = spark.createDataFrame(pairs, "c bigint, n bigint").select(
        "c", "n", scores.round1(scores.share(F.col("c"), F.col("n"))).alias("a"),
        scores.round1(F.col("c") * 100 / F.col("n")).alias("b"),
    )
    for c, n, a, b in df.collect():
        assert a == round((c / n) * 100, 1), (c, n)
        assert b == round(100 * c / n, 1), (c, n)


def _random_texts(seed, count):
    rng = random.Random(seed)
    words = set()
    for p in (*rules.SPAM_PATTERNS, *rules.BEHAVIOUR_PATTERNS, *rules.NOISE_PATTERNS,
              *(p for r in rules.THEME_RULES for p in r.patterns)):
        words |= {re.sub(r"[^\w' /.-]", "", x) for x in re.split(r"[|()]", p)}
    vocabulary = sorted(x for x in words if x) + ["earn $12", "earn $12x", "t.me/abc", "t.me/ abc", "wa.me/", "é", "ação", "_", "x", "₹", "😀"]
    texts = []
    for _ in range(count):
        parts = [rng.choice(vocabulary) for _ in range(rng.randint(1, 9))]
        texts.append(rng.choice(["", "é", "_", " "]) + "".join(p + rng.choice([" ", " ", "", "é", ".", "-", " some filler words here "]) for p in parts))
    return texts


def test_masks_equal_python_re(spark):
    groups = [rules.SPAM_PATTERNS, rules.RESIDUAL_SPAM_PATTERNS, rules.BEHAVIOUR_PATTERNS, rules.NOISE_PATTERNS]
    groups += [r.patterns for r in rules.theme_rules(DEFAULT)]
    texts = _random_texts(7, 3000)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", match_mask(F.col("t"), groups).alias("m")).collect()
    for t, mask in rows:
        want = sum(1 << i for i, g in enumerate(groups) if any(re.search(p, t) for p in g))
        assert mask == want, (t, bin(mask ^ want))


def test_mask_of_null_and_whole_text(spark):
    long = "filler " * 20000 + "bitcoin"
    df = spark.createDataFrame([(None,), (long,)], "t string").select(match_mask(F.col("t"), [rules.SPAM_PATTERNS]).alias("m"))
    assert [r.m for r in df.collect()] == [0, 1]


def test_noise_decisions(spark):
    cases = {
        "late delivery, never came": True,
        "late delivery of my order": False,       # behaviour word keeps it
        "late delivery of my order, crypto": True,  # residual spam goes first
        "great app!!!!": True,
        "great app for me": False,
        "nothing special at all": False,
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want boolean")
    mask = classify.review_mask(F.col("t"))
    assert df.where(classify.is_noise(mask) != F.col("want")).count() == 0


def test_domain_uses_substrings_and_order(spark):
    cases = {
        "feedback about the service": "Pricing & Fees",       # "fee"
        "the code expired": "Product Quality",                 # "expired" before "cod"
        "code please": "Payment Methods",                      # "cod"
        "payment failed": "Payment Methods",
        "app slow today": "Delivery Speed & Delays",
        "hello world": "General Service Experience",
        "refund for rotten fruit": "Refunds & Returns",
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert df.where(classify.issue_domain(classify.review_mask(F.col("t"))) != F.col("want")).count() == 0


def test_sentiment(spark):
    rows = [
        ("bad", 4.0, "positive"), ("love", 2.0, "negative"), ("love it", 3.0, "positive"), ("love it", None, "positive"),
        ("love it", 0.0, "positive"), ("good!", None, "neutral"), ("good bad", None, "mixed"), ("good good bad bad poor", None, "negative"),
        ("Good GOOD bad", 3.0, "mixed"), ("", None, "neutral"),
    ]
    df = spark.createDataFrame(rows, "t string, r double, want string")
    assert df.where(classify.sentiment(F.col("t"), F.col("r")) != F.col("want")).collect() == []


def test_redaction(value):
    assert value(text.redact, t="mail a.b@x.example.com or +91 98765 43210, by @me") == (
        "mail [REDACTED_EMAIL] or [REDACTED_PHONE], by @user"
    )
    assert value(text.redact, t="order 123456789012 ok") == "order [REDACTED_PHONE] ok"
    once = value(text.redact, t="x@y.example 555-123-4567 @a")
    assert value(text.redact, t=once) == once


def test_paraphrase(value):
    assert value(lambda t: text.paraphrase(t, 100), t="Bad service. Never again") == '"Customer says: Bad service"'
    long = "x" * 150
    assert value(lambda t: text.paraphrase(t, 100), t=long) == '"Customer says: ' + "x" * 97 + '..."'


def test_word_count(value):
    # a mark at the end of a word goes with the blank after it, so two words join
    for md in ("# Head line\n\n- one two x\n* three\n", "- one **two** x\n* three", "", "  \n", "## a  b\n- c"):
        plain = re.sub(r"[-*]\s+", "", re.sub(r"#+\s+", "", md))
        assert value(text.word_count, t=md) == len(plain.split()), md


def test_ngrams_and_lists(value):
    assert value(text.ngrams, t=["a", "b", "c"]) == ["a", "b", "c", "a b", "b c"]
    assert value(text.ngrams, t=["a"]) == ["a"]
    assert value(text.ngrams, t=[]) == []
    assert value(text.split_list, t=" a, ,b ,") == ["a", "b"]


def test_title_and_body(value):
    assert value(text.title_and_body, t="T", b="B") == "T - B"
    assert value(text.title_and_body, t="", b="B") == "B"
    assert value(text.title_and_body, t="T", b=None) == "T"


def test_event_time(value):
    as_text = lambda c: F.date_format(text.event_time(c), "yyyy-MM-dd HH:mm:ss")
    assert value(as_text, d="1704067260") == "2024-01-01 00:01:00"
    assert value(as_text, d="2024-01-01T00:01:00") == "2024-01-01 00:01:00"
    assert value(as_text, d="") is None
