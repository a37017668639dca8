import numpy as np
import pytest
from pyspark.sql import functions as F

from voc.operators import neighbours as nb

SCHEMA = "id bigint, v array<float>, entry string, vector int, cell int"


def table(spark, n=400, size=8, seed=0, copies=30):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=size).astype(np.float32).tolist()) for i in range(n)]
    same = rng.normal(size=size).astype(np.float32).tolist()
    rows += [(n + i, same) for i in range(copies)]
    rows += [(5000, None), (5001, []), (5002, [0.0] * size), (None, same), (5003, [float("nan")] * size), (7, rows[9][1])]
    return rows, spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def brute(rows, k, which=lambda i: True):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and any(v) and not np.isnan(v).any()]
    units = np.array([v / np.sqrt(v @ v) for _, v in good])
    out = []
    for (i, _), row in zip(good, np.round(units @ units.T, 9)):
        if which(i):
            near = sorted((-c, j) for (j, _), c in zip(good, row) if j != i)[:k]
            out += [(i, r + 1, j, round(-c, 9)) for r, (c, j) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("cells,rows", [(None, 2048), (1, 50), (40, 7)])
def test_all_cells_give_the_exact_neighbours(spark, monkeypatch, cells, rows):
    monkeypatch.setattr(nb, "BLOCK_ROWS", rows)
    monkeypatch.setattr(nb, "QUERY_ROWS", rows)
    data, df = table(spark)
    got = nb.neighbours(df, "id", "v", k=5, probes=None, cells=cells)
    assert got.columns == ["key", "rank", "neighbour", "cosine"]
    got = sorted((*r[:3], round(r[3], 9)) for r in got.collect())
    assert [g[:3] for g in got] == [w[:3] for w in brute(data, 5)]
    assert np.allclose([g[3] for g in got], [w[3] for w in brute(data, 5)], atol=1e-8)


def test_tuned_probes_reach_the_recall(spark):
    _, df = table(spark, n=1500, seed=3)
    row = nb.recall(df, "id", "v", F.col("id") % 10 == 0, k=15).first()
    assert row.queries > 100 and row.found >= 0.9 * row.neighbours
    few = nb.recall(df, "id", "v", F.col("id") % 10 == 0, k=15, probes=1).first()
    assert few.found < row.found


def test_a_hot_cell_gets_finer_centres(spark, monkeypatch):
    rng = np.random.default_rng(1)
    dense = rng.normal(size=(900, 6)) * 0.05 + np.array([5.0, 0, 0, 0, 0, 0])
    wide = rng.normal(size=(300, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([dense, wide]))], "id bigint, v array<double>")
    monkeypatch.setattr(nb, "HOT", 2)
    index = nb.build(df, "id", "v", 5)
    sizes = [r["count"] for r in index.blocks.select(F.inline("rows")).groupBy("cell").count().collect()]
    assert sum(sizes) == 1200 and max(sizes) < 900
    exact = sorted(map(tuple, nb.search(index, df, "id", "v", None).select("key", "rank", "neighbour").collect()))
    assert exact == [w[:3] for w in brute([(i, v.tolist()) for i, v in enumerate(np.concatenate([dense, wide]))], 5)]


def test_small_and_odd_tables(spark):
    none = spark.createDataFrame([], "id bigint, v array<float>")
    assert nb.neighbours(none, "id", "v").collect() == []
    one = spark.createDataFrame([(1, [1.0, 2.0])], "id bigint, v array<float>")
    assert nb.neighbours(one, "id", "v").collect() == []
    two = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "id bigint, v array<float>")
    assert sorted(r[:3] for r in nb.neighbours(two, "id", "v").collect()) == [(1, 1, 2), (2, 1, 1)]
    with pytest.raises(ValueError, match="vectors of"):
        nb.neighbours(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id bigint, v array<float>"), "id", "v")


def test_units_hold_one_block_and_stream_queries(spark, monkeypatch):
    """Many queries of a block are dealt to units; no row that is sent holds a whole block."""
    monkeypatch.setattr(nb, "BLOCK_ROWS", 50)
    monkeypatch.setattr(nb, "QUERY_ROWS", 7)
    monkeypatch.setattr(nb, "UNIT_QUERIES", 60)
    monkeypatch.setattr(nb, "EQUAL_ROWS", 10)
    sent = []
    mapped = type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, schema, *a, **b: (sent.append(self.schema), mapped(self, f, schema, *a, **b))[1])
    data, df = table(spark)
    got = nb.neighbours(df, "id", "v", k=5, probes=None)
    kinds = {f.name: f.dataType.simpleString() for f in sent[-1].fields}
    assert kinds["vector"] == "array<float>" and not [k for k in kinds.values() if "struct" in k]
    assert sorted(r[:3] for r in got.collect()) == [w[:3] for w in brute(data, 5)]


@pytest.mark.parametrize("pairs", [1 << 16, 5])
def test_a_unit_returns_one_short_list_a_query_however_many_rows_come_by(monkeypatch, pairs):
    monkeypatch.setattr(nb, "QUERY_ROWS", 8)
    monkeypatch.setattr(nb, "PAIRS", pairs)
    rng = np.random.default_rng(4)
    near = rng.normal(size=(4, 3)) + 1e-5 * rng.normal(size=(60, 4, 3))   # closer than 4-byte numbers tell
    vectors = np.concatenate([rng.normal(size=(90, 3)), near.reshape(-1, 3), np.outer(np.arange(1, 31), [1.0, 2.0, 2.0])])
    n, k = len(vectors), 4
    keys = [sorted(rng.choice(10_000, rng.integers(1, k + 2), replace=False).tolist()) for _ in range(n)]
    rows = nb.pa.record_batch(
        [nb.pa.array(vectors.tolist()), nb.pa.array(np.arange(n)), nb.pa.array(np.arange(n, dtype=np.int32)), nb.pa.array(keys)],
        names=["vector", "entry", "cell", "keys"],
    )
    unit = nb._Unit([rows.slice(0, 50), rows.slice(50)], k)
    for at in range(0, n, 37):
        unit.meet(rows.slice(at, 37))
    unit_vectors = vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    cosines = np.round(unit_vectors @ unit_vectors.T, 9)
    got = [x for batch in unit.nearest() for x in batch.to_pylist()]
    assert [g["entry"] for g in got] == list(range(n))
    for g in got:
        want = sorted((-c, key, i) for i, c in enumerate(cosines[g["entry"]].tolist()) for key in keys[i])[: k + 1]
        assert [(x["less"], x["key"], x["cell"]) for x in g["near"]] == want
