import random
from collections import Counter

import pytest

from voc.operators import frequent


def rows(n=600, seed=0, flat=False):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        group = rng.choice(["a", "a", "a", "b", None])
        words = [f"w{rng.randint(0, 3000) if flat else int(rng.paretovariate(0.7))}" for _ in range(rng.randint(0, 40))]
        out.append((group, words))
    return [*out, ("c", []), ("c", None), ("d", ["x", "y", "x"]), ("a", ["w1"] * 5000)]


def brute(data, k):
    counts = {}
    for g, words in data:
        counts.setdefault(g, Counter()).update(words or [])
    out = []
    for g, c in counts.items():
        out += [(g, t, n, i + 1) for i, (t, n) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("flat,width", [(False, 64), (False, 2048), (True, 32)])
def test_top_terms_equal_counting_all(spark, flat, width):
    data = rows(flat=flat)
    df = spark.createDataFrame(data, "group string, terms array<string>").repartition(5)
    got = sorted(map(tuple, frequent.top_terms(df, 8, width).collect()), key=repr)
    assert got == brute(data, 8)


def test_counters_are_bounds():
    rng = random.Random(1)
    words = [f"w{int(rng.paretovariate(0.8))}" for _ in range(60_000)]
    sketch, true = frequent.Sketch(100), Counter(words)
    for i in range(0, len(words), 50):
        sketch.add(words[i : i + 50])
    sketch.cut()
    assert len(sketch.counts) <= 100 and 0 < sketch.error <= len(words) / 101
    assert all(sketch.counts[t] <= n <= sketch.counts[t] + sketch.error for t, n in true.items())


def test_an_uncertain_sketch_is_widened(spark, monkeypatch):
    data = rows(flat=True)
    df = spark.createDataFrame(data, "group string, terms array<string>")
    assert not frequent.candidates(df, 8, 8)[1]
    tried = []
    real = frequent.candidates
    monkeypatch.setattr(frequent, "candidates", lambda r, k, w: tried.append(w) or real(r, k, w))
    monkeypatch.setattr(frequent, "WIDEST", 100)
    assert sorted(map(tuple, frequent.top_terms(df, 8, 8).collect()), key=repr) == brute(data, 8)
    assert tried == [8, 64]


def test_few_rows_are_shuffled(spark):
    rng = random.Random(3)
    data = [(g, (w or []) + [f"rare{rng.random()}" for _ in range(6)]) for g, w in rows(3000)]
    df = spark.createDataFrame(data, "group string, terms array<string>").coalesce(2)
    sent = frequent.sketches(df, 128).count()
    assert sent <= 2 * 6 * 129 and len({(g, t) for g, w in data for t in w or []}) > 10 * sent
    some, sure = frequent.candidates(df, 8, 128)
    assert sure and some.count() < 200
    assert frequent.top_terms(df.limit(0), 8).collect() == []
