import random
import re

import numpy as np
import pytest
import xxhash

from voc.llm import simhash
from voc.llm.components import components

from .conftest import prose


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for k in range(i):
            if (prints[i] ^ prints[k]).bit_count() <= 4:
                root[find(i)] = find(k)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_fingerprints_and_components_equal_brute_force(spark, odd_docs, odd_rows):
    near = [(500 + i, prose(1, 300).replace("word7", f"word{i}", 1) + f" end{i}") for i in range(12)]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id bigint, text string"))
    every = [(r[0], r[1]) for r in odd_rows] + near
    prints = [brute_fingerprint(t) for _, t in every]
    expected = [(d, f"{p:016x}", c) for (d, _), p, c in zip(every, prints, brute_components([d for d, _ in every], prints))]
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def _pairs(fp, radius):
    return {(i, k) for i in range(len(fp)) for k in range(i) if (int(fp[i]) ^ int(fp[k])).bit_count() <= radius}


def _labels(n, pairs):
    label = list(range(n))
    for _ in range(n):
        for i, k in pairs:
            label[i] = label[k] = min(label[i], label[k])
    return label


@pytest.mark.parametrize("seed", range(6))
def test_forest_of_trees_links_what_is_near(seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(8)]
    fp = list({b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(30)})
    fp = np.array(fp, np.uint64)
    group = np.array([rng.randint(0, 1) for _ in fp])
    a, b = simhash.linked(group, fp, np.ones(len(fp), bool), np.ones(len(fp), bool))
    place = {int(f): i for i, f in enumerate(fp)}
    got = _labels(len(fp), {(place[int(x)], place[int(y)]) for x, y in zip(a, b)})
    near = {(i, k) for i, k in _pairs(fp, 4) if group[i] == group[k]}
    assert got == _labels(len(fp), near)


def test_trees_cut_into_blocks_link_the_same(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fp = list({base ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 6))) for _ in range(300)})
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fp]
    frame = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    expected = _labels(len(fp), _pairs(fp, 4))
    for rows in (20_000, 37):
        of = {r["node"]: r["root"] for r in components(simhash.links(frame, shard_rows=rows)).collect()}
        got = [of.get(s, s) for s in signed]
        assert len({(a, b) for a, b in zip(got, expected)}) == len(set(got)) == len(set(expected))


def test_components_of_a_long_chain(spark):
    links = spark.range(300).selectExpr("id as u", "id + 1 as v")
    assert {r["root"] for r in components(links).collect()} == {0}
    assert components(links.filter("u < 0")).count() == 0


def test_one_row_of_each_component_stays(odd_docs, no_docs):
    out = simhash.without_near_duplicates(odd_docs)
    assert out.columns == odd_docs.columns
    rows = out.collect()
    prints = [brute_fingerprint(r["text"]) for r in rows]
    assert not _pairs(prints, 4)
    assert len(rows) == len(set(brute_components([i for i, _ in enumerate(odd_docs.collect())], [brute_fingerprint(r["text"]) for r in odd_docs.collect()])))
    assert simhash.without_near_duplicates(no_docs).count() == 0
    assert simhash.near_duplicates(no_docs).count() == 0
