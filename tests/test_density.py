import random

import numpy as np
import pytest

from voc.operators import density, forest


def kruskal(links):
    top, kept = {}, []

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for w, u, v in sorted((w, min(u, v), max(u, v)) for u, v, w in links if u != v):
        a, b = root(u), root(v)
        if a != b:
            top[a] = b
            kept.append((w, u, v))
    return kept, {x: root(x) for x in list(top)}


def parts_without(nodes, edges):
    _, root = kruskal([(u, v, w) for w, u, v in edges])
    groups = {}
    for x in nodes:
        groups.setdefault(root.get(x, x), set()).add(x)
    return list(groups.values())


def brute_clusters(links, least):
    """The condensed tree from the top: cut the largest link, lose parts below the size, split where both are large."""
    kept, _ = kruskal(links)
    nodes = {x for u, v, _ in links for x in (u, v)}
    tree = []   # (stability, children, members)

    def grow(members, edges, begin):
        stability, children, all_of_it = 0.0, [], set(members)
        edges = sorted(edges)
        while edges:
            w, u, v = edges.pop()
            sides = parts_without(members, edges)
            large = [s for s in sides if len(s) >= least]
            near = 1 / max(w, density.NEAREST)
            if len(large) == 2:
                stability += (near - begin) * len(members)
                children = [grow(side, [e for e in edges if e[1] in side], near) for side in large]
                break
            stay = large[0] if large else set()
            stability += (near - begin) * len(members - stay)
            members, edges = stay, [e for e in edges if e[1] in stay]
        tree.append((stability, children, all_of_it))
        return len(tree) - 1

    roots = [grow(t, [e for e in kept if e[1] in t], 0.0) for t in parts_without(nodes, kept) if len(t) >= least]

    def best(i):
        stability, children, _ = tree[i]
        below = [best(c) for c in children]
        total = sum(b[0] for b in below)
        if stability >= total and not (len(roots) == 1 and i == roots[0]):
            return stability, [i]
        return max(stability, total), [x for b in below for x in b[1]]

    picked = [x for r in roots for x in best(r)[1]]
    label = {x: -1 for x in nodes}
    for n, i in enumerate(sorted(picked, key=lambda i: min(tree[i][2]))):
        for x in tree[i][2]:
            label[x] = n
    return label


def blobs(seed, n, size=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, size)) * 3
    rows = [centres[i % 5] + rng.normal(size=size) * (0.1 + 0.25 * (i % 5)) for i in range(n - n // 6)]
    return np.array([*rows, *rng.normal(size=(n // 6, size)) * 3])


def near_rows(points, k):
    units = points / np.linalg.norm(points, axis=1, keepdims=True)
    cos = np.round(units @ units.T, 9)
    out = []
    for i in range(len(points)):
        out += [(i, j, float(cos[i, j])) for j in sorted((j for j in range(len(points)) if j != i), key=lambda j: (-cos[i, j], j))[:k]]
    return out


def brute_links(near):
    core = {}
    for i, _, c in near:
        core[i] = max(core.get(i, 0), round(1 - c, 9))
    found = {}
    for i, j, c in near:
        w = max(round(1 - c, 9), core[i], core[j])
        key = (min(i, j), max(i, j))
        found[key] = min(w, found.get(key, w))
    return [(u, v, w) for (u, v), w in found.items()]


@pytest.mark.parametrize("seed", [1, 2])
def test_forest_equals_kruskal(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randint(0, 120), rng.randint(0, 120), rng.choice([0.5, 1.0, rng.random()])) for _ in range(260)]
    links += [(200, i, 0.25) for i in range(201, 260)] + [(300, 300, 0.1)]     # a hub, and a link to itself
    got, labels = forest.spanning_forest(spark.createDataFrame(links, "u bigint, v bigint, w double"))
    kept, root = kruskal(links)
    assert sorted((r.w, r.u, r.v) for r in got.collect()) == sorted(kept)
    groups = {}
    for r in labels.collect():
        groups.setdefault(r.component, set()).add(r.node)
    want = {}
    for x, r in root.items():
        want.setdefault(r, set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_births_equal_growing_parts(spark):
    rng = random.Random(4)
    links = [(i, rng.randint(0, i - 1), rng.random()) for i in range(1, 160)] + [(1000 + i, 1001 + i, 1 + i / 100) for i in range(40)]
    links += [(2000, 2000 + i, i / 7) for i in range(1, 60)] + [(3000 + i, 3001 + i, 0.5) for i in range(6)]
    kept, _ = kruskal(links)
    got = {r.node: tuple(r.born) if r.born else None for r in density.births(spark.createDataFrame([(u, v, w) for w, u, v in kept], "u bigint, v bigint, w double"), 7).collect()}
    want, group = {}, {}
    for w, u, v in sorted(kept):
        a, b = group.get(u, {u}), group.get(v, {v})
        both = a | b
        for x in both:
            group[x] = both
            want.setdefault(x, None)
            if len(both) >= 7 and want[x] is None:
                want[x] = (w, u, v)
    assert got == want


@pytest.mark.parametrize("seed,n,least", [(0, 500, 15), (5, 220, 6)])
def test_clusters_equal_brute_force(spark, seed, n, least):
    points = blobs(seed, n)
    df = spark.createDataFrame([(i, p.tolist(), "x", 3) for i, p in enumerate(points)], "id bigint, v array<double>, node string, w int")
    got = {r.id: r.cluster_id for r in density.density_clusters(df, "id", "v", k=15, least=least, probes=None).collect()}
    want = brute_clusters(brute_links(near_rows(points, 15)), least)
    assert got == want
    assert len(set(want.values()) - {-1}) > 2 and -1 in want.values()


def test_odd_tables(spark):
    none = spark.createDataFrame([], "id bigint, v array<double>")
    assert density.density_clusters(none, "id", "v").collect() == []
    rows = [(i, [1.0, 0.0]) for i in range(20)] + [(i, [0.0, 1.0]) for i in range(20, 40)] + [(50, None), (51, [0.0, 0.0]), (None, [1.0, 1.0])]
    got = {r.id: r.cluster_id for r in density.density_clusters(spark.createDataFrame(rows, "id bigint, v array<double>"), "id", "v", probes=None).collect()}
    assert got == {**{i: 0 for i in range(20)}, **{i: 1 for i in range(20, 40)}, 50: -1, 51: -1}


def test_too_many_parts(spark, monkeypatch):
    monkeypatch.setattr(density, "MAX_PARTS", 1)
    links = [(10 * g + i, 10 * g + i + 1, 0.1) for g in range(3) for i in range(4)]
    with pytest.raises(ValueError, match="least number"):
        density.clusters_of_links(spark.createDataFrame(links, "u bigint, v bigint, w double"), 3)
