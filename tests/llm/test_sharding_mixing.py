import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tesserae.llm import mixing, sharding
from tests.llm import util


def test_lpt_is_greedy_over_sorted_sizes():
    items = [(s, k) for k, s in enumerate([9, 8, 7, 6, 5, 4, 3, 2, 1])]
    placed = sharding.lpt(items, 3)
    loads = [0, 0, 0]
    for size, key in sorted(items, key=lambda x: -x[0]):
        least = loads.index(min(loads))
        assert placed[key] == least
        loads[least] += size


def check_shards(rows, texts):
    slots, where, loads = defaultdict(list), {}, Counter()
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(t) + 1 and r.text_crc32 == zlib.crc32(t)
        slots[r.shard].append(r.slot)
        assert where.setdefault(t, r.shard) == r.shard
        loads[r.shard] += r["size"]
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return loads


def test_op10(spark, tmp_path):
    texts = util.odd_texts() + [util.prose(20 + k % 50, k % 300) for k in range(600)]
    sf = util.write(spark, tmp_path, documents=util.clash(util.docs(spark, texts)))
    rows = sharding.op10_sharding(spark, sf).collect()
    assert len(rows) == len(texts)
    loads = check_shards(rows, texts)
    heaviest = max(len((t or "").encode()) + 1 for t in texts)
    rest = [v for v in loads.values() if v < heaviest]
    assert max(rest) - min(rest) < 0.05 * max(rest)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sharding.op10_sharding(spark, sf).collect()))


def test_shards_of_nothing_and_of_one_group(spark, tmp_path):
    none = util.docs(spark, [])
    assert sharding.assign_shards(none, F.lit(1), F.col("text"), [F.col("doc_id")]).count() == 0
    same = util.docs(spark, ["same"] * 50, ids=[3] * 50)
    got = sharding.assign_shards(same, F.lit(1), F.col("text"), [F.col("doc_id")]).collect()
    assert len({r.shard for r in got}) == 1 and sorted(r.slot for r in got) == list(range(50))


def water(sizes, weights, cap=3.0):
    total, out = sum(sizes), {}
    while True:
        free = [k for k in range(len(sizes)) if k not in out]
        left = total - sum(out.values())
        share = {k: left * weights[k] / sum(weights[j] for j in free) for k in free}
        full = [k for k in free if share[k] > cap * sizes[k]]
        if not full:
            return [out.get(k, share.get(k)) for k in range(len(sizes))]
        out |= {k: cap * sizes[k] for k in full}


def test_targets_against_brute_force(spark):
    r = random.Random(5)
    for trial in range(4):
        names = sorted(f"s{k}" for k in range(r.randint(1, 9)))
        sizes = [r.choice([1, 5, 100, 2000]) for _ in names]
        rows = spark.createDataFrame([(n, s) for n, s in zip(names, sizes)] + [(None, 10)], "source string, size long")
        got = {x.source: x.target for x in mixing.targets(rows).collect()}
        expected = water([*sizes, 10], [(5.0, 2.0, 1.0)[k % 3] for k in range(len(names) + 1)])
        for n, e in zip([*names, None], expected):
            assert abs(got[n] - e) < 1e-6 * max(1, e)


def test_op9(spark, tmp_path):
    texts = [util.prose(5 + (k * 37) % 200, k) for k in range(900)] + util.odd_texts()
    sources = [("hot" if k % 3 == 0 else f"s{k % 4}") for k in range(900)] + [None, "a", "b"] + ["hot"] * 7
    sf = util.write(spark, tmp_path, documents=util.clash(util.docs(spark, texts, sources)))
    rows = mixing.op9_mixing(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    taken, largest, source = Counter(), Counter(), dict(enumerate(sources))
    for r in rows:
        size = len((texts[r.doc_id] or "").encode().split())
        assert r["size"] == size and r.taken <= 3 * size and (size == 0 or r.taken % size == 0)
        s = source[r.doc_id]
        taken[s] += r.taken
        largest[s] = max(largest[s], size)
    for r in rows:
        assert abs(taken[source[r.doc_id]] - r.target) <= max(0.02 * r.target, largest[source[r.doc_id]])
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.op9_mixing(spark, sf).collect()))


def test_mix_keeps_columns_and_counts_repeats(spark):
    df = util.clash(util.docs(spark, ["a b c"] * 6 + ["d e"] * 3, ["x"] * 6 + ["y"] * 3, ids=[1] * 6 + [2, 2, 3]))
    out = mixing.mix_documents(df)
    assert out.columns == df.columns
    got = Counter(r.doc_id for r in out.collect())
    sized = df.select("source", F.lit(1).cast("long").alias("size")).groupBy("source").count().collect()
    assert {r.source for r in sized} == {"x", "y"} and got[1] <= 18 and got[2] <= 6
    assert mixing.mix_documents(df.where("doc_id > 9")).count() == 0


def test_rounding_keeps_expectations(spark):
    """Over many seeds a unit's bit is 1 about as often as its probability says."""
    rows = spark.createDataFrame([("s", 0.3, 10 + k % 5, (k,)) for k in range(40)], "source string, p double, size long, row struct<k:long>")
    hits = Counter()
    for seed in range(12):
        for r in mixing.round_tree(rows, seed).collect():
            hits[r.row.k] += r.bit
    assert 0.24 < sum(hits.values()) / (40 * 12) < 0.36 and len(hits) > 30


MASK = (1 << 64) - 1
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def rotl(x, n):
    return ((x << n) | (x >> (64 - n))) & MASK


def hashed(*values):
    """xxhash64 of ints (value, 4) and longs (value, 8), chained as Spark does."""
    seed = 42
    for v, width in values:
        if width == 4:
            h = (seed + P5 + 4) & MASK
            h ^= ((v & 0xFFFFFFFF) * P1) & MASK
            h = (rotl(h, 23) * P2 + P3) & MASK
        else:
            h = (seed + P5 + 8) & MASK
            h ^= (rotl(((v & MASK) * P2) & MASK, 31) * P1) & MASK
            h = (rotl(h, 27) * P1 + P4) & MASK
        h ^= h >> 33
        h = (h * P2) & MASK
        h ^= h >> 29
        h = (h * P3) & MASK
        seed = h ^ (h >> 32)
    return seed


def fold_brute(units, seed, level):
    """units of (p, size, key, row): (row, bit) of the settled ones, and the one that is left."""
    done, left = [], units[0]
    for x in units[1:]:
        if left[0] <= 1e-12 or left[0] >= 1 - 1e-12:
            done.append((left[3], left[0] > 0.5))
            left = x
            continue
        u = (hashed((seed, 4), (level, 4), (left[2], 8), (x[2], 8)) >> 11) * 2.0**-53
        up, down = min((1 - left[0]) * left[1], x[0] * x[1]), min(left[0] * left[1], (1 - x[0]) * x[1])
        m = up if u * (up + down) < down else -down
        a, b = left[0] + m / left[1], x[0] - m / x[1]
        if a <= 1e-12 or a >= 1 - 1e-12:
            done.append((left[3], a > 0.5))
            left = (b, *x[1:])
        else:
            done.append((x[3], b > 0.5))
            left = (a, *left[1:])
    return done, left


def test_fold_against_brute_force(spark):
    r = random.Random(9)
    for seed in (0, 5):
        units = [(r.choice([0.0, r.random(), r.random()]), float(r.randint(1, 50)), r.randrange(-(1 << 63), 1 << 63), k) for k in range(80)]
        df = spark.createDataFrame([(units,)], "units array<struct<p:double,size:double,key:long,row:long>>")
        got = df.select(F.expr(mixing.fold(seed, 2)).alias("got")).first().got
        done, left = fold_brute(units, seed, 2)
        assert [(d.row, d.bit) for d in got.done] == done and got.left.row == left[3] and abs(got.left.p - left[0]) < 1e-9


def test_shards_are_those_of_lpt_over_the_groups(spark):
    """Groups too large for a bundle are scheduled by themselves: all of them here."""
    r = random.Random(3)
    texts = ["x" * n for n in r.sample(range(500, 4000), 150)]
    df = util.docs(spark, texts * 2)
    got = sharding.assign_shards(df, F.octet_length("text") + 1, F.col("text"), [F.col("doc_id")], prefix="to_").collect()
    expected = sharding.lpt([(2 * (len(t) + 1), t) for t in texts], 16)
    assert {x.text: x.to_shard for x in got} == expected


def test_sources_are_numbered_across_ranges(spark):
    rows = [(f"host{k:04d}", 1 + k % 7) for k in range(500)] + [(None, 3)]
    got = {x.source: x.target for x in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    names = sorted(x for x, _ in rows if x) + [None]
    expected = water([dict(rows)[n] for n in names], [(5, 2, 1)[k % 3] for k in range(len(names))])
    assert all(abs(got[n] - expected[k]) < 1e-6 for k, n in enumerate(names))
