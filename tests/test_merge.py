"""Merging of patches against a direct version of its rule on random scenes."""

import math
import random

import pytest

from tesserae.functions import stats
from tesserae.operators import merge as merging

EPS = 1e-9


def sub(p, q):
    return [a - b for a, b in zip(p, q)]


def dot(p, q):
    return sum(a * b for a, b in zip(p, q))


def cross3(p, q):
    return [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]


def norm(p):
    return math.sqrt(dot(p, p))


def cross2(p, q):
    return p[0] * q[1] - p[1] * q[0]


def size(poly):
    return abs(sum(cross2(poly[i], poly[(i + 1) % len(poly)]) for i in range(len(poly)))) / 2 if len(poly) > 2 else 0.0


def cut(poly, a, b, sign):
    inside, outside = [], []
    for i, now in enumerate(poly):
        last = poly[i - 1]
        s, e = (sign * cross2(sub(b, a), sub(p, a)) for p in (last, now))
        if s * e < 0:
            at = [x + (y - x) * s / (s - e) for x, y in zip(last, now)]
            inside.append(at)
            outside.append(at)
        if e >= 0:
            inside.append(now)
        if e <= 0:
            outside.append(now)
    return inside, outside


def inverse(tri, p):
    (a, za), (b, zb), (c, zc) = tri
    whole = cross2(sub(b, a), sub(c, a))
    wb, wc = cross2(sub(p, a), sub(c, a)) / whole, cross2(sub(b, a), sub(p, a)) / whole
    out = (1 - wb - wc) / za + wb / zb + wc / zc
    return out if out > 0 else None


def project(cam, tri):
    out = []
    for p in tri:
        x, y, z = (dot(cam[0][3 * i : 3 * i + 3], p) + cam[1][i] for i in range(3))
        if z <= EPS:
            return None
        out.append(((x / z, y / z), z))
    return out if abs(cross2(sub(out[1][0], out[0][0]), sub(out[2][0], out[0][0]))) / 2 > EPS**2 else None


def shared_part(mine, his):
    sign = math.copysign(1, cross2(sub(his[1][0], his[0][0]), sub(his[2][0], his[0][0])))
    poly = [p for p, _ in mine]
    for e in range(3):
        poly = cut(poly, his[e][0], his[(e + 1) % 3][0], sign)[0]
    return poly


def covered(tri, others, tolerance):
    n = cross3(sub(tri[1], tri[0]), sub(tri[2], tri[0]))
    n = [x / norm(n) for x in n]
    edges = [norm(sub(tri[(i + 1) % 3], tri[i])) for i in range(3)]
    u = [x / edges[0] for x in sub(tri[1], tri[0])]
    v = cross3(n, u)
    flat = lambda p: [dot(sub(p, tri[0]), u), dot(sub(p, tri[0]), v)]
    least = max(edges) ** 2 * 1e-10
    left, some = [[flat(p) for p in tri]], False
    for o in others:
        m = cross3(sub(o[1], o[0]), sub(o[2], o[0]))
        m = [x / norm(m) for x in m]
        f = [flat(p) for p in o]
        turn = cross2(sub(f[1], f[0]), sub(f[2], f[0]))
        if abs(dot(n, m)) < 0.94 or abs(turn) <= least:
            continue
        after = []
        for inside in left:
            for e in range(3):
                inside, outside = cut(inside, f[e], f[(e + 1) % 3], math.copysign(1, turn))
                if size(outside) > least:
                    after.append(outside)
                if not inside:
                    break
            if size(inside) > least:
                at = [[t + a * p[0] + b * p[1] for t, a, b in zip(tri[0], u, v)] for p in inside]
                if all(abs(dot(sub(p, o[0]), m)) <= tolerance for p in at):
                    some = True
                else:
                    after.append(inside)
        left = after
        if not left:
            return "full"
    return "partial" if some else "none"


def find(parent, k):
    while parent[k] != k:
        k = parent[k]
    return k


def brute(vertices, triangles, pairs, cameras):
    patch, at, origin = ({v[0]: v[i] for v in vertices} for i in (1, 2, 3))
    parent = {v: v for v in patch}
    for _, a, b, c in triangles:
        if patch[a] is not None and patch[a] == patch[b] == patch[c]:
            for x in (b, c):
                parent[find(parent, x)] = find(parent, a)
    component = {v: find(parent, v) for v in patch}
    count = {}
    for _, a, _, _ in triangles:
        if patch[a] is not None:
            count[patch[a]] = count.get(patch[a], 0) + 1
    order = sorted(count, key=lambda p: (-count[p], p))
    rank = {p: k for k, p in enumerate(order)}
    used, accepted, canon = set(), [], {}
    for _, u, v in sorted(pairs):
        if patch[u] is None or patch[u] == patch[v] or u in used or v in used:
            continue
        used |= {u, v}
        accepted.append((u, v))
        if origin[u] == origin[v]:
            keep, drop = sorted((u, v), key=lambda x: (rank.get(patch[x], 10**9), x))
            canon[drop] = keep
    islands, linked, anchors = {}, set(), {}
    for u, v in accepted:
        if patch[u] is not None and patch[v] is not None:
            cu, cv = component[u], component[v]
            for x in (cu, cv):
                islands.setdefault(x, x)
            islands[find(islands, cu)] = find(islands, cv)
            key = tuple(sorted((patch[u], patch[v])))
            linked.add(key)
            anchors.setdefault(key, set()).update((u, v))
    joined = lambda a, b: a != b and a in islands and b in islands and find(islands, a) == find(islands, b)
    corner, geo, comp, owner_of = {}, {}, {}, {}
    for t, *abc in triangles:
        new = [canon.get(x, x) for x in abc]
        corner[t] = new if len(set(new)) == 3 else abc
        comp[t], owner_of[t] = component[abc[0]], patch[abc[0]]
        g = [at[x] for x in corner[t]]
        if norm(cross3(sub(g[1], g[0]), sub(g[2], g[0]))) > EPS:
            geo[t] = g
    edges = sorted(norm(sub(g[(i + 1) % 3], g[i])) for g in geo.values() for i in range(3))
    tolerance = 0.9 * edges[len(edges) // 2]
    verdict, settled, prints = {t: "kept" if t in geo else "flat" for t, *_ in triangles}, [], []
    for k, p in enumerate(order):
        members = [t for t, *_ in triangles if owner_of[t] == p and t in geo]
        owners = []
        for q, pr, hidden in prints:
            key = tuple(sorted((p, q)))
            if key in linked:
                touch = lambda t: any(x in anchors[key] for x in corner[t])  # noqa: E731, B023
                ratios = []
                for t in members:
                    mine = project(cameras[q], geo[t])
                    if mine and touch(t):
                        for o, his in pr.items():
                            if joined(comp[t], comp[o]) and touch(o):
                                poly = shared_part(mine, his)
                                if size(poly) > 0:
                                    mid = [sum(x) / len(poly) for x in zip(*poly)]
                                    x, y = inverse(his, mid), inverse(mine, mid)
                                    if x and y and abs(x / y - 1) <= 0.1:
                                        ratios.append(x / y)
                ratios.sort()
                owners.append((q, pr, hidden, ratios[len(ratios) // 2] if len(ratios) >= 5 else 1.0))
        imageless = any(tuple(sorted((p, q))) in linked and q not in [x[0] for x in prints] for q in order[:k])
        for t in members:
            clear, hiding, best = set(), {}, (0.0, None)
            for q, pr, hidden, scale in owners:
                mine = project(cameras[q], geo[t])
                if not mine:
                    continue
                total = size([x for x, _ in mine])
                held = 0.0
                for o, his in pr.items():
                    if joined(comp[t], comp[o]):
                        poly = shared_part(mine, his)
                        if size(poly) > 0:
                            depths = [(inverse(mine, x), inverse(his, x)) for x in poly]
                            if all(a and b and abs(1 / a - scale / b) <= 0.035 * scale / b for a, b in depths):
                                held += size(poly)
                share = min(held / total, 1.0)
                left = {o for o in hidden if joined(comp[t], comp[o])} if share < 0.8 else set()
                if left:
                    hiding[q] = left
                else:
                    clear.add(q)
                if share > best[0]:
                    best = (share, q)
            if best[0] >= 0.8:
                verdict[t] = "owned"
            elif len(clear) == len(owners) and not imageless:
                if best[0] > EPS:
                    verdict[t] = "overlap"
            else:
                others = [o for o in settled if joined(comp[t], comp[o]) and owner_of[o] not in clear and (owner_of[o] not in hiding or o in hiding[owner_of[o]])]
                got = covered(geo[t], [geo[o] for o in sorted(others)], tolerance)
                verdict[t] = "covered" if got == "full" else "overlap" if got == "partial" or best[0] > EPS else "kept"
        kept = [t for t in members if verdict[t] not in ("owned", "covered")]
        if p in cameras:
            pr = {t: x for t in kept if (x := project(cameras[p], geo[t]))}
            if pr:
                prints.append((p, pr, [t for t in kept if t not in pr]))
        settled += kept
    return verdict, corner


def scene(r, first, n=4):
    """Some sheets of n x n vertices over each other, each seen from above by its own camera, or by none."""
    vertices, triangles, cameras, places = [], [], {}, {}
    depth = 5.0
    for p in range(first, first + r.randint(3, 5)):
        ox, oy = r.randint(0, 4) * 0.5, r.randint(0, 3) * 0.5
        shift = r.choice([0, 0, 0, 0.02, 0.6])
        base = p * 100
        for i in range(n):
            for j in range(n):
                place = (ox + i + r.uniform(-0.1, 0.1), oy + j + r.uniform(-0.1, 0.1), depth + shift + r.uniform(-0.03, 0.03))
                vertices.append((base + i * n + j, p, place, "seen" if r.random() < 0.9 else "made"))
                places[base + i * n + j] = place
        for i in range(n - 1):
            for j in range(n - 1):
                a, b, c, d = (base + (i + x) * n + j + y for x, y in ((0, 0), (1, 0), (0, 1), (1, 1)))
                for t in ((a, b, c), (b, d, c)):
                    if r.random() < 0.92:
                        triangles.append((base * 10 + len(triangles), *t))
        if r.random() < 0.7:
            angle = r.uniform(-0.1, 0.1)
            turn = [math.cos(angle), 0.0, math.sin(angle), 0.0, 1.0, 0.0, -math.sin(angle), 0.0, math.cos(angle)]
            back = -5.0 if r.random() < 0.25 else 0.0  # such a camera has part of its own sheet behind it
            cameras[p] = (turn, [-2.0, -1.0, back])
    pairs = []
    ids = list(places)
    for u in ids:
        for v in ids:
            if u < v and u // 100 != v // 100 and math.dist(places[u], places[v]) < 0.35 and r.random() < 0.7:
                pairs.append((r.randint(0, 10**9), u, v) if r.random() < 0.5 else (r.randint(0, 10**9), v, u))
    return vertices, triangles, pairs, cameras


def tables(spark, vertices, triangles, pairs, cameras):
    return (
        spark.createDataFrame([(i, p, *map(float, at), o) for i, p, at, o in vertices], "id long, patch long, x double, y double, z double, origin string"),
        spark.createDataFrame(triangles, "tid long, a long, b long, c long"),
        spark.createDataFrame(pairs, "ord long, u long, v long"),
        spark.createDataFrame([(p, *c) for p, c in cameras.items()], "patch long, r array<double>, t array<double>"),
    )


@pytest.fixture(scope="module")
def scenes():
    r = random.Random(8)
    v, t, p, c = [], [], [], {}
    for k in range(24):
        a, b, d, e = scene(r, 1 + 10 * k)
        v, t, p, c = v + a, t + b, p + d, c | e
    v.append((10**6, None, (0.0, 0.0, 5.0), "seen"))
    return v, t, p, c


def test_merge_against_the_rule(spark, scenes):
    verdict, corner = brute(*scenes)
    got = merging.merge(*tables(spark, *scenes))[0].collect()
    assert {r.tid: (r.a, r.b, r.c) for r in got} == {t: tuple(c) for t, c in corner.items()}
    wrong = [(r.tid, r.verdict, verdict[r.tid], r.share) for r in got if r.verdict != verdict[r.tid]]
    assert not wrong
    from collections import Counter

    assert min(Counter(verdict.values())[x] for x in ("kept", "owned", "covered", "overlap")) > 5


def test_no_triangles(spark):
    v, t, p, c = tables(spark, [(1, 1, (0, 0, 1), "seen")], [], [], {})
    assert merging.merge(v, t, p, c)[0].count() == 0


def test_at_rank(spark):
    r = random.Random(2)
    values = [r.choice([r.random(), float(r.randint(0, 5)), 3.0]) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (0, 3, 999, 1000, 1999):
        assert stats.at_rank(df, "v", k, held=40) == sorted(values)[k]
    assert stats.at_rank(df, "v", 2000) is None
