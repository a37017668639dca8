import math
import random
from collections import Counter

import numpy as np

from voc.operators import embedding

TOPICS = [["bill", "charge", "fee", "price", "refund"], ["rider", "driver", "late", "door", "slow"], ["crash", "login", "screen", "update", "bug"]]


def texts(n=240, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = rng.choices(TOPICS[i % 3], k=rng.randint(3, 14)) + rng.choices(["one", "two"], k=2)
        rng.shuffle(words)
        out.append((i, words))
    return [*out, (n, []), (n + 1, ["rare"])]


def brute_pairs(rows, known, near=4):
    pairs = Counter()
    for _, words in rows:
        for i, a in enumerate(words):
            for b in words[i + 1 : i + 1 + near]:
                if a in known and b in known:
                    pairs[min(a, b), max(a, b)] += 1
    return pairs


def table(spark, rows=None):
    return spark.createDataFrame(texts() if rows is None else rows, "ord bigint, words array<string>")


def test_pairs_and_information_equal_counting(spark):
    words = table(spark)
    known = embedding.vocabulary(words, 12)
    counts = Counter(w for _, some in texts() for w in some)
    top = {t for t, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:12]}
    assert {r.term for r in known.collect()} == top
    pairs = embedding.word_pairs(words, known)
    want = brute_pairs(texts(), top)
    assert {(r.a, r.b): r.n for r in pairs.collect()} == dict(want)
    full = Counter()
    for (a, b), n in want.items():
        full[a, b] += n
        if a != b:
            full[b, a] += n
    of, total = Counter(), sum(full.values())
    for (a, _), n in full.items():
        of[a] += n
    expected = {k: math.log(n * total / (of[k[0]] * of[k[1]])) for k, n in full.items()}
    got = {(r.a, r.b): r.w for r in embedding.information(pairs).collect()}
    assert got.keys() == {k for k, w in expected.items() if w > 0} and all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_the_space_equals_numpy(spark):
    words = table(spark)
    matrix = embedding.information(embedding.word_pairs(words, embedding.vocabulary(words)))
    rows = [tuple(r) for r in matrix.collect()]
    terms = sorted({a for a, _, _ in rows})
    dense = np.zeros((len(terms), len(terms)))
    for a, b, w in rows:
        dense[terms.index(a), terms.index(b)] = w
    values, vectors = np.linalg.eigh(dense)
    order = np.argsort(-np.abs(values))[:3]
    found, got = embedding.eigenvectors(matrix, 3, 25)
    ours = np.array([r.v for r in sorted(found.collect(), key=lambda r: r.term)])
    assert np.allclose(got, values[order], rtol=1e-4)
    cosines = np.linalg.svd(ours.T @ vectors[:, order], compute_uv=False)
    assert ours.shape == (len(terms), 3) and cosines.min() > 0.999 and np.allclose(ours.T @ ours, np.eye(3), atol=1e-8)


def test_texts_of_one_topic_are_near(spark):
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts()], "ord bigint, cleaned_text string")
    got = {r.ord: np.array(r.vector) for r in embedding.learnt_vectors(df, ["one", "two"], 4).collect()}
    assert len(got) == 242 and not got[240].any() and got[0].shape == (4,)
    units = np.array([got[i] for i in range(240)])
    assert np.allclose((units * units).sum(1), 1, atol=1e-5)
    cos = units @ units.T
    same = np.equal.outer(np.arange(240) % 3, np.arange(240) % 3)
    assert cos[same].mean() > 0.8 > 0.3 > cos[~same].mean()
    assert embedding.learnt_vectors(df.limit(0), ["one"], 4).collect() == []


def test_words_that_are_not_known_make_no_pairs(spark, monkeypatch):
    """Counts given away in parts add up, and only pairs of known words are shuffled."""
    monkeypatch.setattr(embedding, "HELD", 5)
    monkeypatch.setattr(embedding, "ROWS", 3)
    rows = [*texts(), (900, [f"once{i}" for i in range(50)]), (901, None)]
    words = table(spark, rows)
    pairs = embedding.word_pairs(words, embedding.vocabulary(words, 12))
    top = {t for t, _ in sorted(Counter(w for _, some in rows for w in some or []).items(), key=lambda x: (-x[1], x[0]))[:12]}
    assert {(r.a, r.b): r.n for r in pairs.collect()} == dict(brute_pairs([(i, w or []) for i, w in rows], top))
    assert "Generate" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_of_words_give_the_same_space(spark, monkeypatch):
    words = table(spark)
    matrix = embedding.information(embedding.word_pairs(words, embedding.vocabulary(words)))
    one = embedding.eigenvectors(matrix, 3, 25)[1]
    monkeypatch.setattr(embedding, "BLOCK", 4)
    found, several = embedding.eigenvectors(matrix, 3, 25)
    assert np.allclose(one, several, rtol=1e-6)
    v = np.array([r.v for r in found.collect()])
    assert np.allclose(v.T @ v, np.eye(3), atol=1e-8)
