import random

import pytest

from voc import jobs
from voc.operators import loads
from voc.operators.loads import Loads

SCHEMA = "ord bigint, text string, first string, bits int, digest int"


def load(spark, rows):
    return spark.createDataFrame([(o, t, "x", 1, 2) for o, t in rows], SCHEMA).repartition(3)


def texts(seed, n=300, kinds=120):
    rng = random.Random(seed)
    return [(i, rng.choice([None, "", "Äpfel", *[f"text {k}" for k in range(kinds)]])) for i in range(seed * 10_000, seed * 10_000 + n)]


def first_ones(rows):
    seen, out = set(), []
    for o, t in sorted(rows):
        if t is None or t not in seen:
            out.append((o, t))
            seen.add(t)
    return sorted(out)


def run(spark, path, rows, buckets=7):
    store = Loads(spark, path, buckets)
    kept = sorted((r.ord, r.text) for r in store.new_rows(load(spark, rows)).collect())
    store.commit()
    return kept


def test_loads_one_by_one_give_the_same_rows_as_one(spark, tmp_path):
    parts = [texts(1), texts(2, kinds=400), [], texts(3, kinds=900)]
    got = []
    for i, part in enumerate(parts):
        got += run(spark, str(tmp_path / "a"), part)
        if i == 1:
            Loads(spark, str(tmp_path / "a")).compact()
    assert sorted(got) == first_ones([r for p in parts for r in p])
    assert run(spark, str(tmp_path / "b"), [r for p in parts for r in p]) == sorted(got)
    store = Loads(spark, str(tmp_path / "a"))
    assert (store.number, store.buckets, len(store.runs)) == (6, 7, 3)


def test_a_failed_load_leaves_no_trace(spark, tmp_path):
    path = str(tmp_path / "s")
    run(spark, path, texts(1))
    broken = Loads(spark, path)
    broken.new_rows(load(spark, texts(2, kinds=500))).collect()      # never committed
    again = run(spark, path, texts(2, kinds=500))
    assert again == [r for r in first_ones(texts(1) + texts(2, kinds=500)) if r[0] >= 20_000]
    with pytest.raises(RuntimeError, match="repeat"):
        broken.commit()
    assert len(Loads(spark, path).runs) == 2


def test_filters_hold_what_they_were_made_of():
    rng = random.Random(0)
    held, others = ([rng.randbytes(16) for _ in range(2000)] for _ in range(2))
    bits = loads.bloom(held)
    assert loads.may_hold(bits, held).all() and loads.may_hold(bits, others).mean() < 0.03
    assert not loads.may_hold(loads.bloom([]), others).any()


def test_only_hits_are_looked_up(spark, tmp_path):
    path = str(tmp_path / "s")
    run(spark, path, texts(1))
    store = Loads(spark, path)
    store.new_rows(load(spark, [(i, f"other {i}") for i in range(500)] + [(1000, "text 1")]))
    assert spark.read.parquet(f"{path}/runs/{store.run}/digests").count() == 500


def test_job_with_a_store(spark, tmp_path):
    import json

    play = [{"reviewId": str(i), "content": f"refund number {i} was denied for my acme order of a charger", "score": 1} for i in range(30)]
    (tmp_path / "one.json").write_text(json.dumps(play[:20]))
    (tmp_path / "two.json").write_text(json.dumps(play[10:]))
    store = str(tmp_path / "store")
    sizes = []
    for name in ("one", "two"):
        assert jobs.analyse(spark, str(tmp_path / f"{name}.json"), "none-a.json", "none-r.json", str(tmp_path / name), loads=store)
        sizes.append(spark.read.option("header", True).csv(str(tmp_path / name / "unified.csv")).count())
    assert sizes == [20, 10]
    assert not jobs.analyse(spark, str(tmp_path / "two.json"), "none-a.json", "none-r.json", str(tmp_path / "three"), loads=store)
