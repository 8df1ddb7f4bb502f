"""Coverage in space of many triangles at once against one after the other, and clusters of links that meet in a task."""

import random

import numpy as np
import pytest

from tesserae.operators import graph, polygons


def alone(corners, others, tolerance, aligned, most):
    """How far others cover one triangle: pieces of it are cut by one other after the other."""
    origin, normal = corners[0], np.cross(corners[1] - corners[0], corners[2] - corners[0])
    normal = normal / np.linalg.norm(normal)
    sides = [np.linalg.norm(corners[(i + 1) % 3] - corners[i]) for i in range(3)]
    u = (corners[1] - origin) / sides[0]
    frame = np.stack([u, np.cross(normal, u)])
    least = max(sides) ** 2 * 1e-10
    flat = lambda p: (p - origin) @ frame.T
    size = lambda p: polygons.area(p[None], np.array([len(p)]))[0]
    left, some = [flat(corners)], False
    for other in others:
        facing = np.cross(other[1] - other[0], other[2] - other[0])
        facing = facing / np.linalg.norm(facing)
        seen = flat(other)
        turn = polygons.cross(seen[1] - seen[0], seen[2] - seen[0])
        if abs(normal @ facing) < aligned or abs(turn) <= least:
            continue
        after = []
        for inside in left:
            for e in range(3):
                side = seen[e][None], seen[(e + 1) % 3][None]
                count = np.array([len(inside)])
                kept, n = polygons.half_plane(inside[None], count, *side, np.sign([turn]))
                lost, m = polygons.half_plane(inside[None], count, *side, -np.sign([turn]))
                if size(lost[0, : m[0]]) > least:
                    after.append(lost[0, : m[0]])
                inside = kept[0, : n[0]]
                if not len(inside):
                    break
            if len(inside) and size(inside) > least:
                if (np.abs((origin + inside @ frame - other[0]) @ facing) <= tolerance).all():
                    some = True
                else:
                    after.append(inside)
            if len(after) > most:
                return "budget"
        left = after
        if not left:
            return "full"
    return "partial" if some else "none"


def triangles(r, n, grid, low, high):
    out = []
    while len(out) < n:
        t = r.uniform(low, high, (3, 3))
        t[:, 2] *= 0.05
        if grid:
            t[:, :2] = r.integers(low, high + 1, (3, 2))
        if np.linalg.norm(np.cross(t[1] - t[0], t[2] - t[0])) > 1e-3:
            out.append(t)
    return np.array(out).reshape(-1, 3, 3)


@pytest.mark.parametrize("grid, most, high", [(False, 128, 2), (False, 6, 2), (True, 128, 4)])
def test_triangles_are_covered_at_once(monkeypatch, grid, most, high):
    r = np.random.default_rng(5)
    corners = triangles(r, 40, grid, 0, high)
    number = r.integers(0, 12, len(corners))
    ends = np.concatenate([[0], np.cumsum(number)])
    others = triangles(r, ends[-1], grid, -1, high + 1)
    expected = [alone(c, others[ends[k] : ends[k + 1]], 0.04, 0.94, most) for k, c in enumerate(corners)]
    assert {"full", "partial", "none"} - set(expected) in (set(), {"full"}) and ("budget" in expected or most > 6)
    monkeypatch.setattr(polygons, "AT_ONCE", 16)
    assert polygons.covered(corners, others, ends, 0.04, 0.94, most).tolist() == expected


def test_nothing_to_cover():
    assert polygons.covered(np.zeros((0, 3, 3)), np.zeros((0, 3, 3)), np.array([0]), 1.0, 0.9, 8).tolist() == []
    one = np.array([[[0.0, 0, 0], [1, 0, 0], [0, 1, 0]]])
    assert polygons.covered(one, np.zeros((0, 3, 3)), np.array([0, 0]), 1.0, 0.9, 8).tolist() == ["none"]


def test_links_of_a_task_need_no_rounds(spark, monkeypatch):
    ids = list(range(3000))
    random.Random(2).shuffle(ids)
    links = [(a, b) for k, (a, b) in enumerate(zip(ids, ids[1:])) if k != 1000] + [(7, 7), (None, 5)]
    write, names = graph.materialise, []
    monkeypatch.setattr(graph, "materialise", lambda df, name: names.append(name) or write(df, name))
    got = {x.node: x.root for x in graph.clusters(spark.createDataFrame(links, "a long, b long").coalesce(1)).collect()}
    assert got == {x: min(part) for part in (ids[:1001], ids[1001:]) for x in part}
    assert len(names) <= 5  # a path of 3,000 took some 30 before
    monkeypatch.setattr(graph, "AT_ONCE", 64)
    monkeypatch.setattr(graph, "stars", lambda batches: (s for b in batches for k in range(0, b.num_rows, 64) for s in [graph.star([b.slice(k, 64)])]))
    assert {x.node: x.root for x in graph.clusters(spark.createDataFrame(links, "a long, b long")).collect()} == got
