import math
import random
import re

import numpy as np
import pytest

from voc.operators import search


def texts(n=500, seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 120)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "w1 " * 3000), (n + 3, rows[5][1]), (n + 4, rows[5][1]), (7, "w7 again w7"), (n + 5, "Größe ÉTÉ x w1")]
    return rows


def brute(rows, queries, k=10):
    words = [(d, re.findall(r"[^\W]{2,}", (t or "").lower())) for d, t in rows]
    n, average = len(rows), sum(len(w) for _, w in words) / len(rows)
    df = {}
    for _, w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for q, text in queries:
        terms = {t for t in re.findall(r"[^\W]{2,}", (text or "").lower()) if t in df}
        scored = []
        for d, w in words:
            s = 0.0
            for t in sorted(terms):
                tf = w.count(t)
                if tf:
                    s += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / average))
            if s > 0:
                scored.append((-round(s, 9), d))
        out += [(q, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def asked(seed=1, n=40):
    rng = random.Random(seed)
    return [(i, " ".join(f"w{int(rng.expovariate(0.03))}" for _ in range(rng.randint(0, 12)))) for i in range(n)] + [(90, None), (91, "größe été"), (92, "w1 w2 w3 w0 w299"), (93, "w1 W1 w1")]


@pytest.mark.parametrize("shard_docs", [37, 4096])
def test_search_equals_scoring_every_text(spark, monkeypatch, shard_docs):
    monkeypatch.setattr(search, "QUERIES", 16)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts()], "doc_id bigint, text string, shard int, words string")
    queries = spark.createDataFrame(asked(), "q bigint, text string")
    index = search.build(docs, "doc_id", "text", shard_docs)
    got = sorted((r.query, r.rank, r.key, r.score) for r in search.search(index, queries, "q", "text").collect())
    want = brute(texts(), asked())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-8)


def test_numbers_are_packed_and_unpacked():
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.integers(0, 1 << b, 50) for b in (1, 7, 8, 14, 15, 21, 28, 32)])
    data, starts = search.packed(values)
    assert (search.unpacked(data) == values).all() and starts[0] == 0
    assert (search.unpacked(data[starts[100] :]) == values[100:]).all() and len(search.unpacked(b"")) == 0


def test_blocks_out_of_reach_stay_packed():
    rng = random.Random(2)
    words = [["common"] * rng.randint(1, 3) + ["filler"] * rng.randint(5, 50) for _ in range(4000)]
    for i in (3, 1000, 2500):
        words[i] += ["rare"] * 4
    row = search._pack_shard(0, list(range(4000)), words)
    shard = search.Shard(row, 30.0)
    blocks = shard.firsts[shard.number["common"] + 1] - shard.firsts[shard.number["common"]]
    got = shard.best([("rare", 7.0), ("common", 0.01)], 3)
    assert blocks > 30 and shard.decoded <= 1 + 3 and {d for _, d in got} == {3, 1000, 2500}
    shard = search.Shard(row, 30.0)
    full = shard.best([("rare", 7.0), ("common", 0.01)], 4000)
    assert shard.decoded == 1 + blocks and full[:3] == got
    assert shard.best([("rare", 7.0), ("common", 0.01)], 3) == got and shard.decoded == 1 + blocks


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    one = spark.createDataFrame([(1, "some text")], "doc_id bigint, text string")
    assert search.search(search.build(none, "doc_id", "text"), one, "doc_id", "text").collect() == []
    assert search.search(search.build(one, "doc_id", "text"), none, "doc_id", "text").collect() == []


def test_a_shard_is_sent_once(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERIES", 4)
    docs = spark.createDataFrame([(i, t) for i, t in texts()], "doc_id bigint, text string")
    queries = spark.createDataFrame(asked(), "q bigint, text string")
    index = search.build(docs, "doc_id", "text", 100)
    sent, mapped = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema, *a, **b: (sent.append(self), mapped(self, f, schema, *a, **b))[1])
    search.search(index, queries, "q", "text")
    assert sent[-1].filter("data is not null").count() == index.count > 3
    assert sent[-1].filter("asked is not null").count() > 3 * index.count


def test_a_shard_decoded_whole_gives_the_same(monkeypatch):
    words = [(t or "").lower().split() for _, t in texts()]
    row = search._pack_shard(0, list(range(len(words))), words)
    whole, lazy, small = (search.Shard(row, 50.0) for _ in range(3))
    whole.open()
    blocks = whole.decoded
    small.room = 10
    small.open()
    assert blocks == len(row["last"]) and small.opened is None
    for _, text in asked():
        terms = [(t, 1.0 + i / 7) for i, t in enumerate(dict.fromkeys((text or "").lower().split()))]
        best = lazy.best(terms, 10)
        assert [d for _, d in whole.best(terms, 10)] == [d for _, d in best] and small.best(terms, 10) == best
    assert whole.decoded == blocks


def test_an_opened_shard_scores_a_pack_at_once(monkeypatch):
    words = [(t or "").lower().split() for _, t in texts()]
    row = search._pack_shard(0, list(range(len(words))), words)
    queries = [(q, list(dict.fromkeys((t or "").lower().split()))) for q, t in asked()]
    queries = [(q, [{"term": t, "idf": 1.0 + i / 7} for i, t in enumerate(terms)]) for q, terms in queries if terms]
    pack = search.pa.array([[{"query": q, "terms": terms} for q, terms in queries]])
    sent = next(search._packs([search.pa.record_batch([pack], names=["asked"])])).column("asked")[0].as_py()
    pack = search.Pack.read(sent)
    assert len(pack.terms) == len(set(pack.terms)) and len(sent["codes"]) < 2 * len(pack.code) and len(sent["ranks"]) == len(pack.terms)
    shard = search.Shard(row, 50.0)
    want = [(q, s, d) for i, (q, _) in enumerate(queries) for s, d in shard.best(pack.asked(i), 10)]
    # all words in the matrix, some, none; tiles and pieces smaller than the pack's
    for dense, tile, piece in ((10**9, 256, 1 << 18), (20, 7, 100), (0, 16, 1)):
        monkeypatch.setattr(search, "DENSE", dense)
        monkeypatch.setattr(search, "TILE", tile)
        monkeypatch.setattr(search, "PIECE", max(piece, search.BLOCK))
        opened = search.Shard(row, 50.0)
        opened.open()
        monkeypatch.setattr(search, "PIECE", piece)
        monkeypatch.setattr(opened, "best", None)
        got = [x for some in opened.best_of(pack, 10) for x in zip(*(c.tolist() for c in some))]
        assert [(q, d) for q, _, d in got] == [(q, d) for q, _, d in want]
        assert np.allclose([s for _, s, _ in got], [s for _, s, _ in want], atol=1e-8)
