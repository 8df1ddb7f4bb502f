"""Splitting at vertices inside edges: nothing is left inside an edge, no area is lost, turns stay."""

import random
from collections import Counter

from tesserae.operators import conform


def area(p, t):
    (xa, ya), (xb, yb), (xc, yc) = (p[i] for i in t)
    return ((xb - xa) * (yc - ya) - (xc - xa) * (yb - ya)) / 2


def inside(p, edge, w):
    (x0, y0), (x1, y1), (x, y) = p[edge[0]], p[edge[1]], p[w]
    return (x1 - x0) * (y - y0) == (x - x0) * (y1 - y0) and 0 < (x - x0) * (x1 - x0) + (y - y0) * (y1 - y0) < (x1 - x0) ** 2 + (y1 - y0) ** 2


def brute(p, triangles):
    """Vertices inside each edge."""
    edges = {tuple(sorted((t[i], t[(i + 1) % 3]))) for t in triangles.values() for i in range(3)}
    return {(e, w) for e in edges for w in p if w not in e and inside(p, e, w)}


def test_conform_against_brute_force(spark):
    r = random.Random(5)
    places = {100 * x + y: (float(x), float(y)) for x in range(14) for y in range(9)}
    triangles = {}
    for x in range(0, 12, 4):
        for y in range(0, 8, 4):  # coarse cells, and some fine ones between them
            a, b, c, d = 100 * x + y, 100 * (x + 4) + y, 100 * x + y + 4, 100 * (x + 4) + y + 4
            triangles |= {len(triangles): (a, b, c), len(triangles) + 1: (b, d, c)}
    for x in (12,):
        for y in range(8):
            triangles[len(triangles)] = (100 * x + y, 100 * x + 100 + y, 100 * x + y + 1)
    while len(triangles) < 60:
        t = tuple(r.sample(sorted(places), 3))
        if area(places, t):
            triangles[len(triangles)] = t
    found = brute(places, triangles)
    assert len(found) > 40
    points = spark.createDataFrame([(i, x, y, 0.0) for i, (x, y) in places.items()], "id long, x double, y double, z double")
    mesh = spark.createDataFrame([(k, *t) for k, t in triangles.items()], "tid long, a long, b long, c long")
    for cell in (0.7, 3.0):
        got = conform.on_edges(mesh, points, 1e-6, cell)
        rows = got.collect()
        assert len(rows) == len(found) and {((x.u, x.v), x.w) for x in rows} == found
    out = [(x.tid, (x.a, x.b, x.c)) for x in conform.conform(mesh, got).collect()]
    lies = {}
    for e, w in found:
        lies.setdefault(e, set(e)).add(w)
    for k, t in out:
        old = triangles[k]
        for i in range(3):
            on = lies.get(tuple(sorted((old[i], old[(i + 1) % 3]))), set())
            for j in range(3):
                part = t[j], t[(j + 1) % 3]
                assert not (set(part) <= on and any(inside(places, part, w) for w in on - set(part)))
    pieces, total = Counter(k for k, _ in out), Counter()
    for k, t in out:
        assert area(places, t) * area(places, triangles[k]) > 0
        total[k] += area(places, t)
    for k, t in triangles.items():
        assert abs(total[k] - area(places, t)) < 1e-9
        edges = {tuple(sorted((t[i], t[(i + 1) % 3]))) for i in range(3)}
        assert pieces[k] == 1 + sum(e in edges for e, _ in found)


def test_nothing_to_split(spark):
    mesh = spark.createDataFrame([(1, 1, 2, 3), (2, 2, 2, 3)], "tid long, a long, b long, c long")
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0), (3, 0.0, 1.0, 0.0), (4, 0.0, 0.0, 0.0)], "id long, x double, y double, z double")
    got = conform.on_edges(mesh, points, 1e-6, 1.0)
    assert got.count() == 0 and conform.conform(mesh, got).count() == 2
