import math
import random
import re
from collections import defaultdict

from voc.llm import mixing


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    """Sources in order with weights 5, 2, 1; what is above twice the size is shared again until nothing is."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, out, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        level = (total - sum(out.values())) / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in free}
        out |= {s: 2.0 * sizes[s] for s in full}
        free -= full
    return out


def mix(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    return mixing.mixed(docs).collect()


def check(spark, rows, near=0.02):
    got = mix(spark, rows)
    assert sorted((r["doc_id"], r["source"], r["size"]) for r in got if r["doc_id"] is not None and r["source"] is not None) == sorted(
        (d, s, words(t)) for d, t, s in rows if d is not None and s is not None
    )
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 2
    wanted = brute_targets(dict(sizes))
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], wanted[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
    for s in sizes:
        # one copy more or less of the largest document is at most half its size off
        most = max((r["size"] for r in got if r["source"] == s), default=0)
        assert abs(taken[s] - wanted[s]) <= (near * wanted[s] if most < near * wanted[s] else most / 2), (s, taken[s], wanted[s])
    return got


def test_targets_are_met(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(1.1) * 20)), f"src{int(rng.random() ** 3 * 12)}") for i in range(3_000)]
    got = check(spark, rows, 0.002)
    # expected tokens of the tilted rates meet the targets exactly
    expected, target = defaultdict(float), {}
    for r in got:
        expected[r["source"]] += r["size"] * r["rate"]
        target[r["source"]] = r["target"]
    assert all(math.isclose(expected[s], target[s], rel_tol=1e-6) for s in target)


def test_rates_are_exponentially_tilted(spark):
    got = check(spark, [(i, "w " * (5 + i % 40), "abc"[i % 3]) for i in range(900)])
    by = defaultdict(dict)
    for r in got:
        by[r["source"]][r["size"]] = r["rate"]
    for rates in by.values():
        slopes = {round(math.log(v / (2 - v)) / z, 6) for z, v in rates.items() if 0 < v < 2}
        assert len(slopes) <= 1


def test_odd_rows(spark, odd_docs, no_docs, odd_rows):
    check(spark, [(r[0], r[1], r[3]) for r in odd_rows], 0.2)
    check(spark, [(1, None, "a"), (2, "", "a"), (3, " \n", None)])
    check(spark, [(1, "one", "a")])
    check(spark, [(7, "same text", "a")] * 5)
    assert mixing.mixed(no_docs).collect() == []
    out = mixing.mixture(odd_docs)
    assert out.columns == odd_docs.columns
    assert sum(words(r["text"]) for r in out.collect()) == sum(r["size"] * r["copies"] for r in mixing.mixed(odd_docs.select("doc_id", "text", "source")).collect())


def test_reruns_agree(spark):
    rows = [(i, "w " * (i % 50), f"s{i % 5}") for i in range(500)]
    first, again = ({r["doc_id"]: (r["copies"], r["target"]) for r in mix(spark, x)} for x in (rows, rows[::-1]))
    assert first == again
