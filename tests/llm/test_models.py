"""The language model and the quality classifier."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tesserae.llm import lm_scoring, quality_classifier
from tests.llm import util


def held(i, m, r):
    return zlib.crc32(str(i).encode()) % m == r


def test_op3(spark, tmp_path):
    r = random.Random(2)
    pools = {"en": util.prose(300, 1, 300).split(), "de": util.prose(300, 2, 300).split()}
    langs = [("en", "de")[k % 2] for k in range(300)]
    texts = [" ".join(r.choices(pools[g], k=r.randint(20, 90))) for g in langs] + util.odd_texts()
    df = util.docs(spark, texts, langs=langs + [None] * len(util.odd_texts()))
    sf = util.write(spark, tmp_path, documents=util.clash(df))
    rows = {x.doc_id: x for x in lm_scoring.op3_lm_scoring(spark, sf).collect()}
    tokens = [[*(t or "").encode().lower().split(), b""] for t in texts]
    count = Counter()
    for i, ts in enumerate(tokens):
        if not held(i, 10, 0):
            count.update(ts)
    total, distinct = sum(count.values()), len(count)
    for i, ts in enumerate(tokens):
        x = rows[i]
        base = sum(math.log10((count[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in ts)
        assert abs(base - x.base_score) < 1e-6 * max(1, abs(base))
        assert (x.n_tokens, x.n_known, x.train_tokens, x.held_out) == (len(ts), sum(count[t] > 0 for t in ts), total, held(i, 10, 0))
        assert x.score < 0
    out = [rows[i] for i in range(300) if rows[i].held_out]
    assert sum(x.score for x in out) > sum(x.base_score for x in out)


def test_scores_do_not_depend_on_partitions(spark):
    r = random.Random(4)
    pool = util.prose(2000, 1, 1500).split()
    texts = [" ".join(r.choices(pool, k=r.randint(5, 120))) for _ in range(400)]
    df = util.docs(spark, texts, langs=["en", "de"] * 200)
    got = []
    for n in (4, 8, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows = lm_scoring.score_documents(df.repartition(n), df.doc_id % 10 != 0).collect()
        got.append({x.id: (x.base_score, x.score) for x in rows})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for other in got[1:]:
        assert all(abs(x - y) < 1e-9 * abs(x) for i in got[0] for x, y in zip(got[0][i], other[i]))


def test_the_token_before_is_a_context(spark):
    """After one of the commonest tokens the next one is sure; the model finds out, the base can't."""
    r = random.Random(6)
    follow = {w: f"{w}{k}zz" for k, w in enumerate(["aa", "bb", "cc", "dd"])}
    texts = [" ".join(x for w in r.choices(list(follow), k=40) for x in (w, follow[w])) for _ in range(200)]
    rows = lm_scoring.score_documents(util.docs(spark, texts), F.col("doc_id") % 10 != 0).where("not train").collect()
    score, base = sum(x.score for x in rows), sum(x.base_score for x in rows)
    assert score > 0.72 * base  # knowing the follower would save half of the base's cost
    for x in rows:
        assert x.n_bytes == len(texts[x.id].encode()) + 2 and abs(x.bits_per_byte + x.score * math.log2(10) / x.n_bytes) < 1e-9


def slot_brute(token, place, state, order, node, bits):
    """Slot of a node, from the bytes one by one."""
    mask = (1 << 64) - 1
    mix = lambda x: int(lm_scoring.sh.mix(np.array([x & mask], np.uint64))[0])
    cls = state & ((1 << lm_scoring.CLASS_BITS) - 1)
    if order < lm_scoring.WHOLE:
        total = sum(token[place - 1 - k] << (8 * k) for k in range(order + 2) if place - 1 - k >= 0)
        context = mix((total | (cls << 56 if order in lm_scoring.STATED else 0)) + int(lm_scoring.SALT[order]))
    else:
        base = int(lm_scoring.sh.BASE)
        whole = mix(sum(int(lm_scoring.sh.BYTE[b]) * pow(base, k, 1 << 64) for k, b in enumerate(token[:place])) + place * int(lm_scoring.NODE))
        context = mix((whole ^ ((cls if order == lm_scoring.WHOLE else state) << 56)) + int(lm_scoring.SALT[order]))
    return ((context + node * int(lm_scoring.NODE)) * 0xBF58476D1CE4E5B9 & mask) >> (64 - bits)


def test_counts_against_brute_force():
    """The count tables hold what going through the bits one by one gives."""
    bits, r = 16, random.Random(1)
    rows = [(bytes(r.choices(b"abcde", k=r.randint(0, 7))), r.randrange(64), r.randint(1, 9)) for _ in range(60)]
    tags = np.zeros(1 << bits, np.uint16)
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.binary(), pa.int32(), pa.int64()))], ["tok", "z", "c"])
    got = {b.column(0)[0].as_py(): lm_scoring.unpacked(b.column(1)[0].as_py()) for b in lm_scoring.count_tables(iter([batch]), tags, bits)}
    flat = np.zeros(lm_scoring.ORDERS * (2 << bits))
    for row, (places, values) in got.items():
        flat[row * lm_scoring.ROW + places.astype(np.int64)] += values
    expected = np.zeros_like(flat)
    for token, state, c in rows:
        coded = token + b" " if token else b"\n"
        for place, byte in enumerate(coded):
            for j in range(8):
                node, bit = (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1
                for order in range(lm_scoring.ORDERS):
                    if order != lm_scoring.WHOLE:  # whose nodes need a tag
                        expected[order * (2 << bits) + (bit << bits) + slot_brute(coded, place, state, order, node, bits)] += c
    assert (flat == expected).all()


def test_mixing_against_brute_force():
    """Mixed and refined probabilities of tokens, one bit at a time."""
    rng, bits = np.random.default_rng(3), 16
    tables = [rng.integers(0, 1 << 16, 1 << bits).astype(np.uint16) for _ in range(lm_scoring.ORDERS)]
    model = lm_scoring.Model(bits, np.zeros(1 << bits, np.uint16), tables, rng.normal(0.2, 0.1, (lm_scoring.PLACES * 8, lm_scoring.ORDERS, lm_scoring.LEVELS)), rng.uniform(0.01, 0.99, 256 * lm_scoring.STEPS))
    tokens, states = [b"ab", b"", b"c" * 9], [3, 17, 100]
    got = lm_scoring.token_scores(tokens, np.array(states), model)
    for token, state, score in zip(tokens, states, got):
        coded, total = (token + b" " if token else b"\n"), 0.0
        for place, byte in enumerate(coded):
            for j in range(8):
                node, bit, x = (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1, 0.0
                for order in range(lm_scoring.ORDERS):
                    n = 0 if order == lm_scoring.WHOLE else int(tables[order][slot_brute(coded, place, state, order, node, bits)])
                    n0, n1 = 2 ** ((n & 255) / lm_scoring.GRAIN) - 1, 2 ** ((n >> 8) / lm_scoring.GRAIN) - 1
                    level = min(math.frexp(n0 + n1 + 0.5)[1] // 2, lm_scoring.LEVELS // 2 - 1) + (lm_scoring.LEVELS // 2 if n0 == 0 or n1 == 0 else 0)
                    x += model.weights[min(place, lm_scoring.PLACES - 1) * 8 + j, order, level] * math.log((n1 + lm_scoring.PRIOR) / (n0 + lm_scoring.PRIOR))
                x = max(-16.0, min(16.0, x))
                at = (max(-8.0, min(8.0, x)) + 8) * (lm_scoring.STEPS - 1) / 16
                low = min(int(at), lm_scoring.STEPS - 2) + (coded[place - 1] if place else 0) * lm_scoring.STEPS
                far = at - min(int(at), lm_scoring.STEPS - 2)
                p = (1 / (1 + math.exp(-x)) + model.last[low] * (1 - far) + model.last[low + 1] * far) / 2
                p = min(max(p, 2**-16), 1 - 2**-16)
                total += math.log10(p if bit else 1 - p)
        assert abs(total - score) < 1e-3 * abs(total)


def test_a_very_long_token_is_scored(spark):
    rows = lm_scoring.score_documents(util.docs(spark, ["x" * 300_000, "a b c"]), F.lit(True)).collect()
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_bits_are_a_probability():
    """Over all next bytes of a token the model's probabilities add up to 1."""
    rng = np.random.default_rng(0)
    tables = [rng.integers(0, 1 << 16, 1 << 16).astype(np.uint16) for _ in range(lm_scoring.ORDERS)]
    tags = lm_scoring.tags_of([(b"abc", 0), (b"abd", 1)], 16)
    model = lm_scoring.Model(16, tags, tables, lm_scoring.start_weights(), rng.uniform(0.01, 0.99, 256 * lm_scoring.STEPS))
    total = 0.0
    for byte in range(256):
        data = np.array([97, byte], np.uint8)
        t = lm_scoring.trace([b"a"], np.array([1]))
        t = t._replace(byte=data)
        p = 1.0
        for j, node, bit in lm_scoring.bits_of(t):
            x = lm_scoring.mixed(model.weights, np.minimum(t.place, lm_scoring.PLACES - 1) * 8 + j, *lm_scoring.inputs(model, t, node, bit, False))
            low, far = lm_scoring.cells(t, x)
            q = (0.5 * (1 + np.tanh(x / 2)) + model.last[low] * (1 - far) + model.last[low + 1] * far) / 2
            p *= q[1] if bit[1] else 1 - q[1]
        total += p
    assert abs(total - 1) < 1e-9


def test_lm_of_nothing(spark):
    from pyspark.sql import functions as F

    assert lm_scoring.score_documents(util.docs(spark, []), F.lit(True)).count() == 0
    rows = lm_scoring.score_documents(util.docs(spark, ["a b", None], ids=[None, None]), F.lit(False)).collect()
    assert sorted(x.n_tokens for x in rows) == [1, 3] and all(x.n_known == 0 and x.train_tokens == 0 for x in rows)


def test_segments_are_causal():
    teller = lm_scoring.Teller({b"x": 0, b"y": 1}, np.array([[0.0, -3.0], [-3.0, 0.0], [0.0, 0.0]]), {})
    runs = lm_scoring.segments([b"y"] * 4 + [b"x"] * 20, teller)
    assert runs[0] == (0, [b"y"] * 4) and runs[1] == (2, [b"x"] * 12) and runs[2][0] == 1 and [t for _, p in runs for t in p] == [b"y"] * 4 + [b"x"] * 20


def junk(k):
    w = util.prose(80, k).split()
    return " ".join([f"{x}$$$" for x in w] if k % 2 else [x.upper() + "!!" for x in w])


def test_op8_held_out(spark, tmp_path):
    texts = [junk(k) if k % 4 == 0 else util.prose(60 + k % 90, k).capitalize() + "." for k in range(900)] + util.odd_texts()
    df = util.docs(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(900) if k % 3] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    sf = util.write(spark, tmp_path, documents=util.clash(df), labels=labels)
    rows = quality_classifier.op8_quality_classifier(spark, sf).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == held(r.doc_id, 3, 1) for r in rows)
    tested = [r for r in rows if r.held_out and r.doc_id < 900]
    assert sum(r.predicted == int(r.doc_id % 4 != 0) for r in tested) >= 0.95 * len(tested)


def test_classifier_never_sees_held_out_labels(spark):
    """Turning the labels of held-out rows around changes no score."""
    from pyspark.sql import functions as F

    texts = [junk(k) if k % 3 == 0 else util.prose(70, k) for k in range(120)]
    df = util.docs(spark, texts)
    may = quality_classifier.remainder(F.col("id"), 3) != 1
    labels = [(k, int(k % 3 != 0)) for k in range(120)]
    turned = [(k, 1 - v if held(k, 3, 1) else v) for k, v in labels]
    got = [{r.id: r.score for r in quality_classifier.classify(df, spark.createDataFrame(x, "doc_id long, quality int"), may).collect()} for x in (labels, turned)]
    assert all(abs(got[0][k] - got[1][k]) < 1e-9 for k in got[0])


def test_classifier_without_labels_or_texts(spark):
    from pyspark.sql import functions as F

    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_classifier.classify(util.docs(spark, []), none, F.lit(True)).count() == 0
    rows = quality_classifier.classify(util.docs(spark, util.odd_texts()), none, F.lit(True)).collect()
    assert len(rows) == len(util.odd_texts()) and all(0 <= r.score <= 1 for r in rows)


def test_risk_and_gradient_against_brute_force(spark, monkeypatch):
    """One step's sums, and the direction of the non-negative risk, against losses row by row and finite differences."""
    rng = np.random.default_rng(5)
    x, kind = rng.normal(0, 1, (60, quality_classifier.FEATURES)), rng.integers(0, 3, 60)
    table = spark.createDataFrame([(list(map(float, r)), int(k)) for r, k in zip(x, kind)], "x array<float>, kind int").repartition(7)
    net, seen = quality_classifier.Net(np.zeros(quality_classifier.FEATURES), np.ones(quality_classifier.FEATURES)), []
    quality_classifier.descend(net, table, lambda total: seen.append(total) or np.zeros(len(net.theta)), 1)
    x = x.astype(np.float32).astype(float)

    def loss(theta, rows, sign):
        f = quality_classifier.Net(net.mean, net.scale, theta).forward(x[rows])[2]
        return sum(math.log1p(math.exp(-v if sign else v)) for v in f)

    groups = [(kind == 1, 1), (kind == 2, 1), (kind == 1, 0), (kind == 2, 0), (kind == 0, 0)]
    for got, (rows, sign) in zip(seen[0], groups):
        assert got[0] == rows.sum() and abs(got[1] - loss(net.theta, rows, sign)) < 1e-6
        for k in rng.integers(0, len(net.theta), 12):
            step = np.zeros(len(net.theta))
            step[k] = 1e-5
            assert abs(got[2 + k] - (loss(net.theta + step, rows, sign) - loss(net.theta - step, rows, sign)) / 2e-5) < 1e-4

    def risk(theta, prior):
        """(positives' part, negatives' part) of the unbiased risk."""
        p = kind > 0
        return prior * loss(theta, p, 1) / p.sum(), loss(theta, ~p, 0) / (~p).sum() - prior * loss(theta, p, 0) / p.sum()

    for prior in (0.1, 0.98):
        got, negative = quality_classifier.risk_direction(seen[0], prior), risk(net.theta, prior)[1]
        for k in rng.integers(0, len(net.theta), 12):
            step = np.zeros(len(net.theta))
            step[k] = 1e-5
            up, down = risk(net.theta + step, prior), risk(net.theta - step, prior)
            expected = (sum(up) - sum(down)) / 2e-5 if negative >= 0 else -(up[1] - down[1]) / 2e-5
            assert abs(got[k] - expected) < 1e-4
    below = seen[0].copy()
    below[4, 1] = 0.0  # unlabelled texts without loss: the negatives' risk is below 0
    flat = quality_classifier.risk_direction(below, 0.5)
    n = max(1.0, below[2, 0] + below[3, 0])
    assert np.allclose(flat, -(below[4, 2:] / max(1.0, below[4, 0]) - 0.5 * (below[2, 2:] + below[3, 2:]) / n))


def test_class_prior_of_known_shares(spark):
    """Unlabelled rows of which 30 % are like the positives, and ties of scores."""
    rng = np.random.default_rng(8)
    row = lambda good: [float(good * 3 + v) for v in rng.normal(0, 0.5, quality_classifier.FEATURES)]
    rows = [(row(k % 10 < 3), 0) for k in range(2000)] + [(row(True), 1 + k % 2) for k in range(800)] + [([0.0] * quality_classifier.FEATURES, 0)] * 20
    _, prior = quality_classifier.fit(spark.createDataFrame(rows, "x array<float>, kind int"))
    assert 0.25 < prior < 0.36
