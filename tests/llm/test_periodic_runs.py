import hashlib
import random
import zlib

import numpy as np
import pytest

from voc.llm import periodic_runs as pr


def brute_runs(words):
    """Every stretch of every period, by comparing all words one period apart."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(6, 4 * q):
                found.setdefault((start, i + q - start), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def numbers(words):
    seen = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.uint64)


def texts():
    rng = random.Random(5)
    out = ["", "a", "a a a a a", "a a a a a a", "a b " * 4, "a b a b a b a", "x " + "a b c " * 4 + "a b", "a " * 300 + "b " + "a " * 300]
    out += [("a a a a a a a b " * 30), ("a b a c " * 9 + "a b a b a b a b a b"), " ".join(f"w{i % 97}" for i in range(97 * 5 + 3))]
    for k in (2, 3, 5):
        out += [" ".join(rng.choice("abcdefgh"[:k]) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    for _ in range(60):   # planted periods among random words
        parts = []
        for _ in range(rng.randint(1, 5)):
            parts += [f"r{rng.randint(0, 30)}" for _ in range(rng.randint(0, 40))]
            unit = [f"u{rng.randint(0, 6)}" for _ in range(rng.randint(1, 40))]
            size = rng.randint(1, 7 * len(unit))
            parts += (unit * 8)[:size]
        out.append(" ".join(parts))
    a, b = "a", "a b"      # a Fibonacci word has as many repetitions as a word can
    while len(b) < 3000:
        a, b = b, b + " " + a
    return [*out, b]


def test_runs_equal_brute_force():
    split = [t.split() for t in texts()]
    got = pr.find_runs(numbers([w for words in split for w in words]), np.array([len(w) for w in split]))
    assert got == [brute_runs(words) for words in split]
    for words in split[:40]:
        assert pr.find_runs(numbers(words), np.array([len(words)])) == [brute_runs(words)]


@pytest.mark.parametrize("size", [1, 2, 8, 64])
def test_transform_gives_exact_squared_differences(size):
    rng = np.random.default_rng(size)
    blocks = rng.integers(0, 50_000, (5, size)).astype(np.uint64)
    windows = rng.integers(0, 50_000, (5, 2 * size)).astype(np.uint64)
    for prime, root in pr.PRIMES:
        got = pr.squared_differences(blocks, windows, prime, root)
        for r in range(5):
            for e in range(size):
                want = sum((int(x) - int(y)) ** 2 for x, y in zip(blocks[r], windows[r, e : e + size]))
                assert int(got[r, e]) == want % prime


def test_blocks_are_convolved_and_long_texts_take_linear_time(monkeypatch):
    calls = []
    real = pr.squared_differences
    monkeypatch.setattr(pr, "squared_differences", lambda b, w, p, r: calls.append(b.shape) or real(b, w, p, r))
    words = numbers([f"w{i % 1500}" for i in range(60_000)])
    assert pr.find_runs(words, np.array([60_000])) == [[(0, 60_000, 1500)]]
    assert 1024 in {size for _, size in calls}
    assert pr.find_runs(np.zeros(200_000, np.uint64), np.array([200_000])) == [[(0, 200_000, 1)]]


def brute_row(doc_id, text):
    words = (text or "").replace("\x0b", " ").encode().split()
    if doc_id is not None and words and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g, n = zlib.crc32(str(doc_id).encode()) // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    best = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[0] if runs else (None, None, None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    milli = None if not runs else 1000 * best[1] // best[2]
    return doc_id, len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def test_digests_equal_brute_force(odd_docs, odd_rows):
    rows = [(r[0], r[1]) for r in odd_rows]
    short = [r for r in rows if len(r[1] or "") < 60_000]
    got = pr.digests(odd_docs)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(rows)
    for row in short:
        assert brute_row(*row) in got


def test_digests_of_looped_documents(spark):
    rows = [(i, " ".join(f"w{(i * j) % 50}" for j in range(i % 130))) for i in range(400)] + [(i, t) for i, t in enumerate(texts())]
    rows += [(None, "a b " * 5), (-30, "a b c d e f g h")]
    got = sorted(map(tuple, pr.digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=repr)
    assert got == sorted((brute_row(*r) for r in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 40


def test_empty_table_and_clashing_names(spark, no_docs, odd_docs):
    assert pr.digests(no_docs).collect() == [] and pr.runs(no_docs).collect() == [] and pr.collapsed(no_docs).collect() == []
    rows = [(1, "x y z " * 5 + "end", "s", 3), (2, None, "s", 4), (3, "plain\ntext  here", "s", 5), (3, "plain\ntext  here", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, own_1 string, period bigint")
    assert [tuple(r) for r in pr.collapsed(docs).collect()] == [(1, "x y z end", "s", 3), *rows[1:]]
    assert [tuple(r) for r in pr.runs(docs).collect()] == [(1, 0, 15, 3)]
    assert pr.collapsed(odd_docs).columns == odd_docs.columns and pr.collapsed(odd_docs).count() == odd_docs.count()
