"""Nearest sites and links of clusters against all pairs, on clouds with copies, tight balls, far places and gaps."""

import math
import random

from tesserae.operators import graph, spatial

R = 0.05


def cloud(seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(3), *(rng.uniform(0, 0.5) for _ in range(3))) for _ in range(150)]
    rows += [(k % 4, 0.2, 0.2, 0.2) for k in range(30)] + [(1, -0.4, 0.0, k * 0.02) for k in range(9)] + [(2, -0.4, 0.01, k * 0.025) for k in range(9)]
    rows += [(k % 2, 0.9 + rng.uniform(0, 1e-5), 0.9, -0.9) for k in range(40)] + [(0, 1e20, 0.0, 0.0), (1, 1e20, 0.0, 0.0), (1, 3.0, 3.0, 3.0), (2, 3.0, 3.0, 3.05)]
    rows += [(None, 0.2, 0.2, 0.2), (1, None, 0.2, 0.2), (1, float("nan"), 0.2, 0.2), (2, float("inf"), 0.0, 0.0), (1, -0.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0)]
    rng.shuffle(rows)
    return [(7 * k + 1, *r) for k, r in enumerate(rows)]


def near(rows):
    out = {}
    fine = [r for r in rows if None not in r and all(map(math.isfinite, r[2:]))]
    for p in fine:
        found = [(d, q[0]) for q in fine if q[1] != p[1] and (d := round(math.sqrt(sum((x - y) ** 2 for x, y in zip(p[2:], q[2:]))), 9)) <= R]
        if found:
            out[p[0]] = sorted(found)
    return out


def test_nearest_and_links_match_all_pairs(spark):
    rows = cloud(1)
    all_ = near(rows)
    points = spark.createDataFrame(rows, "id long, grp int, x double, y double, z double")
    at = spatial.sites(points)
    ids = {r.id for r in at.collect()}
    found = spatial.nearest(at, R)
    best = {r.a: (r.distance, r.b) for r in found.collect()}
    assert best == {k: v[0] for k, v in all_.items() if k in ids}
    mutual = [(r.a, r.b) for r in spatial.mutual(found).collect()]
    assert sorted(mutual) == sorted((a, v[0][1]) for a, v in all_.items() if a < v[0][1] and all_[v[0][1]][0][1] == a)
    root = {k: k for k in all_}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, v in all_.items():
        for _, b in v:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in graph.clusters(spatial.linked(at, R)).collect()}
    assert got == {k: find(k) for k in all_ if k in ids}


def test_a_site_meets_few_others_in_a_dense_cloud(spark, monkeypatch):
    rng = random.Random(3)
    points = spark.createDataFrame([(k, k % 5, *(rng.uniform(0, 0.05) for _ in range(3))) for k in range(2000)], "id long, grp int, x double, y double, z double")
    met = []
    f = spatial.materialise
    monkeypatch.setattr(spatial, "materialise", lambda df, name: met.append((name, out := f(df, name))) or out)
    assert spatial.nearest(spatial.sites(points), R).count() == 2000
    settled = [df.count() for name, df in met if name == "nearest"]
    assert sum(settled[:-1]) > 1900  # at finer cells than the radius


def test_clusters_of_long_chains_take_few_rounds(spark, monkeypatch):
    n, rounds = 1500, []
    f = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: rounds.append(name) or f(df, name))
    rng = random.Random(5)
    names = rng.sample(range(10 * n), n)
    links = list(zip(names, names[1:]))
    got = graph.clusters(spark.createDataFrame([*links, (3, 3)], "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted((k, min(names)) for k in names)
    assert rounds.count("links") <= 12
