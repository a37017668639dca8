import hashlib
import random
import re
import time

import pytest

from voc.llm import personal_data as pd

PATTERNS = [
    re.compile(x) for x in (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    )
]


def luhn(digits):
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            good = (
                True, kind == 1 and all(int(p) <= 255 for p in m[0].split(".")), kind == 2 and 14 <= len(digits) <= 19 and luhn(digits),
                kind == 3 and 10 <= len(digits) <= 15,
            )[kind]
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


PARTS = ["a", "b.", "@", ".", "1", "22", "255.", "256", "-", " ", "+", "(", ")", "_", "%", "é", "4111 1111 1111 1111", "1.2.3.4", "x@y.z", "+1 (743) 555-3824", "0"]


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 25)))
        found = [(a, kind, b) for a, b, kind, base in pd.candidates(text) if base]
        assert found == brute(text), text


@pytest.mark.parametrize("text", ["1" * 10**6, "x@y " + "a" * 10**6, "1." * 500_000, "+1" * 500_000, "a@" * 500_000, "(1" * 500_000, "1 " * 500_000, "a.b@c." * 200_000])
def test_matching_is_linear(text):
    start = time.process_time()
    pd.candidates(text)
    assert time.process_time() - start < 10


def test_estimation_finds_the_reliable_labelers():
    rng = random.Random(3)
    counts, truth = {}, {}
    for _ in range(30_000):
        yes = rng.random() < 0.6
        vote = tuple(
            0 if rng.random() > 0.8 else (1 if (rng.random() < right) == yes else -1) for right in (0.95, 0.9, 0.85, 0.8, 0.75, 0.52)
        )
        code = pd._code(0, 1, vote)
        counts[code] = counts.get(code, 0) + 1
        truth.setdefault(code, []).append(yes)
    share, prior, soft = pd.reliabilities(counts)
    accuracy = [(share[1, j, 2] / share[1, j, [0, 2]].sum() + share[0, j, 0] / share[0, j, [0, 2]].sum()) / 2 for j in range(6)]
    assert all(abs(a - b) < 0.04 for a, b in zip(accuracy, (0.95, 0.9, 0.85, 0.8, 0.75, 0.52)))
    likely = pd.span_classifier(counts, soft)
    right = sum(sum(y == (likely[c] > 0.5) for y in ys) for c, ys in truth.items())
    assert right / 30_000 > 0.93 and abs(prior[1] - 0.6) < 0.03
    assert pd.span_classifier({}, {}) == {}


def test_added_spans(spark):
    rows = [(i, f"Call me at (74{i % 10}) 555-38{i % 90 + 10} today, mail user{i}@mail.example.com") for i in range(80)]
    rows += [(200 + i, f"order id 12-{i:03}-99.1 version 1.2.{300 + i}.4 token={i:032x}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r["doc_id"]: r for r in pd.personal_data(docs).collect()}
    assert all("phone:11:" in out[i]["spans"] and "email" in out[i]["spans"] and out[i]["n_phone"] == 0 for i in range(80))
    assert all(out[200 + i]["spans"] == "" for i in range(80))


def test_query_columns(odd_docs, odd_rows, no_docs):
    got = {}
    for r in pd.personal_data(odd_docs).collect():
        got.setdefault((r["doc_id"], r["base_sha256"]), tuple(r)[1:5])
    for row in odd_rows:
        base = brute(row[1] or "")
        text = ",".join(f"{pd.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert got[row[0], hashlib.sha256(text.encode()).hexdigest()] == tuple(sum(k == n for _, k, _ in base) for n in range(4))
    assert pd.personal_data(no_docs).collect() == []
