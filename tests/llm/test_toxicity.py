import random
import zlib

import numpy as np
import pytest

from voc.llm import toxicity as tx

from .conftest import PROSE

INSULTS = ["idiot", "moron", "worthless", "disgusting"]


def planted(n=700, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(PROSE) + rng.choice(["", "", rng.choice(PROSE)]) for _ in range(rng.choice([20, 60, 300]))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        rows.append((i, " ".join(words), toxic))
    return rows


def is_held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def model():
    rows = [r for r in planted() if not is_held(r[0])]
    return tx.train([r[1] for r in rows], [r[2] for r in rows])


def test_held_out_texts(model):
    held = [r for r in planted() if is_held(r[0])]
    got = np.array([model.score(t) >= 0.5 for _, t, _ in held])
    want = np.array([y == 1 for *_, y in held])
    assert (got & want).sum() >= 0.9 * want.sum() and (got & ~want).sum() <= 0.03 * (~want).sum()


def test_misspellings_share_ngrams(model):
    base = model.odds("the old harbour lies quiet")
    for word in ("idiots", "idioot", "moronn", "wortthless", "disgustingly"):
        assert model.odds(f"the old {word} harbour") > base + 1, word


def test_one_insult_counts_in_a_long_text(model):
    rng = random.Random(2)
    text = " ".join(rng.choice(PROSE) for _ in range(40_000))
    assert model.score(text) < 0.5 <= model.score(text + " you worthless idiot")


def test_the_table_of_words_is_bounded(model, monkeypatch):
    texts = [" ".join(f"w{i}x{j}" for j in range(50)) + (" idiot" if i % 2 else "") for i in range(40)]
    free = [model.score(t) for t in texts]
    monkeypatch.setattr(tx, "KNOWN_WORDS", 64)
    model.known = None
    bounded = []
    for t in texts:
        bounded.append(model.score(t))
        assert len(model.known) <= 64 + 51
    assert bounded == free


def test_passages_count_words_once(model):
    share = {w: model.odds(f"{w}") - model.bias for w in ("idiot", "harbour", "the")}
    for text in ("idiot idiot", "the harbour idiot idiot the", "Harbour THE idiot"):
        want = max(sum(share[w] for w in p) for p in tx.passages(tx.words(text))) + model.bias
        assert model.odds(text) == pytest.approx(want)


def test_training_does_not_depend_on_the_order():
    rows = planted(120)
    a = tx.train([r[1] for r in rows], [r[2] for r in rows])
    rows.reverse()
    b = tx.train([r[1] for r in rows], [r[2] for r in rows])
    assert a.odds("an idiot on the pier") == b.odds("an idiot on the pier") and (a.slope, a.base) == (b.slope, b.base)


@pytest.mark.parametrize("at_once", [1, 3, 100])
def test_gradient_sums_agree_with_loops(at_once, monkeypatch):
    monkeypatch.setattr(tx, "AT_ONCE", at_once)
    rng = np.random.default_rng(0)
    groups = [np.array(g, np.int64) for g in ([0, 2, 2], [], [1], [3, 0])]
    sizes = np.array([len(g) for g in groups])
    bags, vectors = tx._Bags(np.concatenate(groups), sizes, 5), rng.normal(size=(5, 3))
    assert np.allclose(bags.sums(vectors), [vectors[g].sum(0) if len(g) else np.zeros(3) for g in groups])
    slopes = rng.normal(size=(4, 3))
    want = np.zeros((5, 3))
    for slope, g in zip(slopes, groups):
        for i in g:
            want[i] += slope
    assert np.allclose(bags.back(slopes), want)


def test_table(spark, monkeypatch):
    monkeypatch.setattr(tx, "STEPS", 30)
    rows = planted(300)
    docs = spark.createDataFrame([(i, t, "own", 1, 0.5) for i, t, _ in rows], "doc_id bigint, text string, toxic string, held_out int, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    got = tx.toxicity(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    got = {r["doc_id"]: r for r in got.collect()}
    assert len(got) == 300 and all(r["held_out"] == is_held(i) and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    # labels of held-out documents play no part
    turned = spark.createDataFrame([(i, 1 - y if is_held(i) else y) for i, _, y in rows], "doc_id bigint, toxic int")
    assert {r["doc_id"]: r["score"] for r in tx.toxicity(docs, turned).collect()} == {i: r["score"] for i, r in got.items()}


def test_odd_rows_and_labels(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(None, 1), (7, None), (5, 0), (5, 1)], "doc_id bigint, toxic int")
    none = labels.limit(0)
    rows = tx.toxicity(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in rows)
    by_id = {r["doc_id"]: r["score"] for r in rows}
    assert by_id[100] == by_id[101] == by_id[102]
    assert {r["score"] < 1e-9 for r in tx.toxicity(odd_docs, none).collect()} == {True}
    only = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id bigint, toxic int")
    assert {r["predicted"] for r in tx.toxicity(odd_docs, only).collect()} == {1}
    assert tx.toxicity(no_docs, labels).collect() == []
    texts, marks = tx.labelled_sample(odd_docs, labels, sample=4)
    assert 0 < len(texts) <= 8 and marks.count(1) <= 4 and marks.count(0) <= 4
