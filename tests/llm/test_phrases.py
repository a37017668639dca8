import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from voc.llm import phrases as ph


def brute(rows, longest=4, least=30, within=80, top=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    longer = {}
    for (lang, w), a in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(a, longer.get((lang, w[i : i + k]), 0))
    out = {}
    for (lang, w), a in found.items():
        cuts = []
        for k in range(1, len(w)):
            l, r = counts[lang, w[:k]], counts[lang, w[k:]]
            cuts.append((2_000_000 * a // (l + r), k, l, r))
        score, _, l, r = min(cuts)
        if 100 * longer.get((lang, w), 0) < within * a:
            out.setdefault(lang, []).append((" ".join(w), a, l, r, totals[lang], score))
    rows = []
    for lang, some in out.items():
        some.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        rows += [(lang, i + 1, *x) for i, x in enumerate(some[:top])]
    return sorted(rows)


def small(seed=3, n=300):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        words = [rng.choice(["New", "york", "City", "the", "of", "a", "Éa", "b\x0bc", "x\ty"]) + rng.choice(["", "", " ", ",", ". ", "?\n", "\x0c"]) for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice(["en", "en", "de", None, "und", ""]), " ".join(words)))
    return [*rows, ("en", None), ("de", ""), (None, " . , "), ("en", "New York City " * 3000), *rows[:5]]


def spark_rows(spark, rows, **kw):
    docs = spark.createDataFrame([(lang, t, "own", 1, 2) for lang, t in rows], "lang string, text string, key string, n int, w0 int")
    return sorted(map(tuple, ph.phrases(docs, **kw).collect()))


@pytest.mark.parametrize("kw", [{}, {"least": 4, "top": 25}, {"least": 2, "within": 50, "longest": 3}, {"least": 5, "bits": 1 << 10, "cells": 1 << 12}, {"least": 300, "cells": 1 << 12}])
def test_phrases_equal_brute_force(spark, kw, monkeypatch):
    # filters that let rare words and pairs through change nothing
    real, sizes = ph.counts, {k: v for k, v in kw.items() if k in ("bits", "cells")}
    kw = {k: v for k, v in kw.items() if k not in sizes}
    monkeypatch.setattr(ph, "counts", lambda d, longest, least: real(d, longest, least, **sizes))
    want = brute(small(), **kw)
    assert want and spark_rows(spark, small(), **kw) == want


def test_blocks_of_words_do_not_matter(spark):
    rows = ["New York, new york city of the new York"] * 40 + [None, "a b c d e"]
    batch = __import__("pyarrow").record_batch([["en"] * len(rows), rows], names=["lang", "text"])
    whole = Counter()
    for b in ph._word_counts(iter([batch])):
        whole.update(dict(zip(b["key"].to_pylist(), b["n"].to_pylist())))
    assert whole == Counter(" ".join(r.lower().replace(",", " ") for r in rows if r).split())


def test_counters_saturate_and_add_up(spark):
    docs = spark.createDataFrame([("en", "a b " * 400)] * 3 + [("en", "c d e")] * 7, "lang string, text string").repartition(4)
    known, size = spark.sparkContext.broadcast(np.full(128, 255, np.uint8)), 1 << 13

    def has(bits, words):
        mixed = ph._hashes("en", [words[0].encode()])
        for w in words[1:]:
            mixed = ph._mixed(mixed, ph._hashes("en", [w.encode()]))
        return bool(ph._has(bits, ph._cells(mixed, size))[0])

    for least, want in ((7, {"ab", "ba", "cd"}), (8, {"ab", "ba"}), (1000, {"ab", "ba"})):
        bits = ph.prefix_filter(docs, known, [], range(2, 3), 4, 4 * size, least, size)
        assert len(bits) * 8 == size and {p for p in ("ab", "ba", "cd", "bc", "da") if has(bits, p)} == want
        long = ph.prefix_filter(docs, known, [bits], range(3, 5), 4, 4 * size, least, size)
        assert {p for p in ("aba", "abab", "cde", "abc", "bcd") if has(long, p)} == ({"aba", "abab"} | ({"cde"} if least == 7 else set()))
    assert ph.prefix_filter(docs, known, [], range(2, 3), 4, 10 * size, 5, size) is None


def test_sql_gives_the_same_rows(spark):
    rows = small(9, 200)
    con = duckdb.connect()
    con.execute("create table documents(lang varchar, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert sorted(con.execute(ph.PHRASES_SQL).fetchall()) == brute(rows) == spark_rows(spark, rows)


def test_products_beyond_64_bits(spark):
    big = 2**61
    rows = [([], 2 * big), (["a"], big), (["b"], big), (["c"], big), (["a", "b"], big - 1), (["b", "c"], big // 2), (["a", "b", "c"], big // 2)]
    counted = spark.createDataFrame([("en", w, f) for w, f in rows], "lang string, words array<string>, f bigint")
    got = {r["phrase"]: (r["a"], r["score"]) for r in ph.scored(counted).collect()}
    want_ab, want_abc = 2_000_000 * (big - 1) // (2 * big), 2_000_000 * (big // 2) // (big + big // 2)
    assert got == {"a b": (big - 1, want_ab), "a b c": (big // 2, min(want_abc, 2_000_000 * (big // 2) // (big - 1 + big)))}


def test_odd_rows_and_empty_tables(spark, odd_docs, odd_rows, no_docs):
    assert ph.phrases(no_docs).collect() == []
    assert ph.phrases(no_docs).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = sorted(map(tuple, ph.phrases(odd_docs).collect()))
    assert got == brute([(r[2], r[1]) for r in odd_rows])
