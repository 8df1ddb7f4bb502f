import random

import numpy as np
import xxhash

from tesserae.llm import near_dedup
from tests.llm import util


def fp_brute(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components_brute(fps):
    left, out = set(range(len(fps))), {}
    while left:
        stack, seen = [left.pop()], []
        while stack:
            k = stack.pop()
            seen.append(k)
            near = [j for j in left if (fps[k] ^ fps[j]).bit_count() <= 4]
            left -= set(near)
            stack += near
        out |= {k: min(seen) for k in seen}
    return out


def test_covering_has_every_choice():
    from itertools import combinations

    family = near_dedup.covering()
    assert all(any(set(s) <= set(c) for s in family) for c in combinations(range(8), 4))


def test_op6_against_brute_force(spark, tmp_path):
    r = random.Random(3)
    texts = util.odd_texts()
    for k in range(60):
        w = util.prose(120, k).split()
        texts.append(" ".join(w))
        for _ in range(3):
            v = list(w)
            v[r.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    sf = util.write(spark, tmp_path, documents=util.clash(util.docs(spark, texts)))
    got = {x.doc_id: x for x in near_dedup.op6_near_dedup(spark, sf).collect()}
    fps = [fp_brute(t) for t in texts]
    assert [got[k].fingerprint for k in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert {k: x.component_id for k, x in got.items()} == components_brute(fps)


def test_links_connect_what_all_links_connect(spark, monkeypatch):
    """Chains and dense clusters of fingerprints, with lists cut into blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    r = random.Random(7)
    fps = set()
    for _ in range(12):
        base = r.getrandbits(64)
        for _ in range(40):
            x = base
            for _ in range(r.randint(0, 3)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    at = r.getrandbits(64)
    for _ in range(30):  # a chain
        for _ in range(4):
            at ^= 1 << r.randrange(64)
        fps.add(at)
    fps = sorted(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    found = near_dedup.links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    root = {s: s for s in signed}
    for x in near_dedup.components(found).collect():
        root[x.node] = x.root
    groups = {}
    for s, f in zip(signed, fps):
        groups.setdefault(root[s], set()).add(f)
    expected = {}
    for k, m in components_brute(fps).items():
        expected.setdefault(m, set()).add(fps[k])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_forest_of_a_dense_group_is_no_larger_than_the_group():
    base, r = np.uint64(0x0123456789ABCDEF), random.Random(1)
    fps = np.array(sorted({int(base) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(500)}), np.uint64)
    assert len(near_dedup.forest(fps)) == len(fps) - 1


def test_components_of_paths_and_stars(spark):
    path = [(k, k + 1) for k in range(40)]
    star = [(100, k) for k in range(101, 160)]
    got = {r.node: r.root for r in near_dedup.components(spark.createDataFrame(path + star + [(7, 7)], "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(1, 41)) and all(got[k] == 100 for k in range(101, 160))


def test_keep_one(spark):
    a, b = util.prose(100, 1), util.prose(100, 2)
    df = util.clash(util.docs(spark, [a, a, b, b, b, None, ""], ids=[5, 3, 9, 9, 8, 1, None]))
    out = near_dedup.keep_one(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(3, a), (8, b), (None, "")], key=str)
    again = near_dedup.keep_one(util.docs(spark, [a, a, a], ids=[2, 2, 2]))
    assert again.count() == 1
    assert near_dedup.keep_one(df.where("doc_id > 99")).count() == 0
