import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from voc import storage
from voc.llm import kneser_ney as kn
from voc.llm import shared_files

from .conftest import PROSE, prose


def brute(rows, order):
    """The textbook recursion over dictionaries."""
    held_out = [zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in rows]
    tokens = [[*(t or "").encode().lower().split(), "end"] for _, t in rows]
    count, raw = {order: Counter()}, Counter()
    for out, x in zip(held_out, tokens):
        if not out:
            raw.update(x)
            y = ["begin"] * (order - 1) + x
            count[order].update(zip(*[y[i:] for i in range(order)]))
    for n in range(order - 1, 0, -1):
        count[n] = Counter(g[1:] for g in count[n + 1])
    discount, total, seen = {}, {}, {}
    for n in range(1, order + 1):
        many = Counter(count[n].values())
        discount[n] = kn.discounts_of([many[k] for k in (1, 2, 3, 4)])
        total[n], seen[n] = defaultdict(int), defaultdict(lambda: [0, 0, 0])
        for g, c in count[n].items():
            total[n][g[:-1]] += c
            seen[n][g[:-1]][min(c, 3) - 1] += 1
    size, every = len(raw), sum(raw.values())

    def p(g):
        if not g:
            return 1 / (size + 1)
        n, c = len(g), count[len(g)].get(g, 0)
        if not total[n].get(g[:-1]):
            return p(g[1:])
        off = discount[n][min(c, 3) - 1] if c else 0
        rest = sum(a * b for a, b in zip(discount[n], seen[n][g[:-1]]))
        return (max(c - off, 0) + rest * p(g[1:])) / total[n][g[:-1]]

    out = []
    for (d, _), held, x in zip(rows, held_out, tokens):
        y = ["begin"] * (order - 1) + x
        base = sum(math.log10((raw[w] + 0.5) / (every + 0.5 * (size + 1))) for w in x)
        score = sum(math.log10(p(tuple(y[i : i + order]))) for i in range(len(x)))
        out.append((d, held, len(x), sum(raw[w] > 0 for w in x), every, base, score))
    return out


@pytest.mark.parametrize("order", [2, 3, 4])
def test_equals_brute_force(spark, odd_docs, odd_rows, order):
    got = sorted(map(tuple, kn.held_out_scores(odd_docs, order).collect()), key=repr)
    expected = sorted(brute([(r[0], r[1]) for r in odd_rows], order), key=repr)
    for a, b in zip(got, expected, strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-9)


def test_the_registered_query_sees_two_words_before(spark, odd_docs, odd_rows):
    assert kn.ORDER >= 3
    got = sorted(map(tuple, kn.held_out_scores(odd_docs).collect()), key=repr)
    expected = sorted(brute([(r[0], r[1]) for r in odd_rows], kn.ORDER), key=repr)
    assert all(a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-9) for a, b in zip(got, expected, strict=True))


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(i, prose(i, 200)) for i in range(40)], "doc_id bigint, text string")
    model = kn.train(docs.select("text"))
    words = sorted({w for i in range(40) for w in prose(i, 200).encode().lower().split()})
    hashes = np.array([kn.xxhash.xxh64_intdigest(w) for w in words] + [kn.END], np.uint64)
    before, _ = model.words.find(kn.key_of([hashes]), 2)
    p = np.maximum(before - model._discount(1, before), 0) / model.before_total + model.back_off / (model.vocabulary + 1)
    unknown = model.back_off / (model.vocabulary + 1)
    assert math.isclose(p.sum() + unknown, 1.0, rel_tol=1e-9)
    for context in (b"the", b"harbour", words[-1]):
        prior = np.full(len(hashes), np.uint64(kn.xxhash.xxh64_intdigest(context)))
        total, back = model.contexts[2].find(kn.key_of([prior]), 2)
        (count,) = model.grams[2].find(kn.key_of([prior, hashes]), 1)
        assert total[0]
        q = np.maximum(count - model._discount(2, count), 0) / total + back * p
        assert math.isclose(q.sum() + back[0] * unknown, 1.0, rel_tol=1e-9)


def test_held_out_text_is_better_than_the_base(spark):
    texts = [(i, " ".join((PROSE * 8)[i % 37 : i % 37 + 200])) for i in range(100)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    rows = [r for r in kn.held_out_scores(docs).collect() if r["held_out"]]
    assert rows and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_without_training_texts(spark, no_docs):
    assert kn.held_out_scores(no_docs).collect() == []
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = kn.held_out_scores(spark.createDataFrame([(alone, "a b")], "doc_id bigint, text string")).first()
    assert tuple(row) == (alone, True, 3, 0, 0, 0.0, 0.0)


def test_the_arrays_are_small_and_nothing_else_stays(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}" for x in 3000 * rng.random(400) ** 3) for _ in range(100)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    root = os.path.dirname(shared_files.locate(storage.scratch_path(spark, "unused"))[1])
    there = set(os.listdir(root)) if os.path.isdir(root) else set()
    model = kn.train(docs, 3)
    (folder,) = set(os.listdir(root)) - there  # neither rows between the orders nor word numbers
    size = sum(f.stat().st_size for f in os.scandir(os.path.join(root, folder)) if not f.name.startswith("."))
    indexes = sum(4 << max(0, 16 - model.words.bits) for a in (*model.grams.values(), *model.contexts.values(), model.words) for _ in a.files)
    padded = [["begin", "begin", *t.split(), "end"] for t in texts]
    grams = [len({tuple(t[i : i + n]) for t in padded for i in range(3 - n, len(t) - n + 1)}) for n in (1, 2, 3)]
    assert size - indexes < 13 * sum(grams)  # 36 bytes a bigram with its context, and 12 a trigram, before


@pytest.mark.parametrize("order", [2, 3, 4])
def test_large_counts_and_contexts_seen_once(spark, order):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{int(x)}" for x in 400 * rng.random(60) ** 4)) for i in range(60)]
    rows += [(i, "the same three words " * 30) for i in range(60, 80)]
    got = sorted(map(tuple, kn.held_out_scores(spark.createDataFrame(rows, "doc_id bigint, text string"), order).collect()))
    for a, b in zip(got, sorted(brute(rows, order)), strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-9)


@pytest.mark.parametrize("bits", [0, 3, 18])
def test_packed_keys_that_agree_in_their_upper_bits(tmp_path, bits):
    rng = np.random.default_rng(5)
    top = np.uint64(5 << (64 - bits) if bits else 0)
    keys = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) >> np.uint64(bits) | top
    keys = np.unique(np.concatenate([keys, *((keys[:200] & ~np.uint64(0xFFFF)) + np.uint64(7 * k) for k in range(5))]))
    stored, counts = keys[::2], rng.integers(1, 260, len(keys[::2]), dtype=np.uint64)
    counts[::50] = 1 << 33
    file = kn._packed_file(str(tmp_path), "some", 0, bits, stored, [counts, counts % np.uint64(9)])
    arrays = kn.Packed(bits, {5 if bits else 0: tuple(file.decode().split("\n"))})
    expected = dict(zip(stored.tolist(), counts.tolist()))
    asked = rng.permutation(np.concatenate([keys, keys[:50], keys ^ np.uint64(1)]))
    large, small = arrays.find(asked, 2)
    assert large.tolist() == [expected.get(k, 0) for k in asked.tolist()]
    assert small.tolist() == [expected.get(k, 0) % 9 for k in asked.tolist()]
