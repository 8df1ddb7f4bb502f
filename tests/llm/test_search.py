"""Decontamination and license scans against exact containment."""

import random

from pyspark.sql import functions as F

from tesserae.llm import decontamination, license_scan
from tests.llm import util


def grams(words, width=5):
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def contained_brute(docs, items):
    out = {}
    for d, text in docs:
        w = (text or "").encode().lower().split()
        for i, item in items:
            v = (item or "").encode().lower().split()
            if not v:
                continue
            width = min(5, len(v))
            g = grams(v, width)
            n = len(g & grams(w, width))
            if n / len(g) >= 0.8:
                out[d, i] = (len(g), n)
    return out


def case():
    r = random.Random(11)
    items = [util.prose(n, 1000 + n) for n in (5, 6, 9, 17, 33, 60, 130, 400)] + ["three little words", "one", "", None, util.prose(17, 1017), "a a a a a a a a"]
    texts = util.odd_texts() + [util.prose(300 + 7 * k, k) for k in range(12)]
    for k, item in enumerate(items[:8]):
        body = util.prose(3000, 50 + k).split()
        at = r.randrange(len(body))
        texts.append(" ".join(body[:at] + [item.upper()] + body[at:]))
        w = item.split()
        for edits in (1, 2):
            v = list(w)
            for _ in range(edits):
                v[r.randrange(len(v))] = "edited"
            texts.append(" ".join(body[:40] + v + body[40:60]))
        texts.append(" ".join(w[: len(w) // 2] + body[:100] + w[len(w) // 2 :]))  # in two halves
        texts.append(item)
    texts += ["so three Little\nwords here", "x a a a a a a a a a y"]
    return list(enumerate(texts)), list(enumerate(items))


def test_op1_against_brute_force(spark, tmp_path):
    docs, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    sf = util.write(spark, tmp_path, documents=util.clash(util.docs(spark, [t for _, t in docs])), benchmark=bench)
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_shared) for r in decontamination.op1_decontamination(spark, sf).collect()}
    assert got == contained_brute(docs, items)


def test_decontamination_edges(spark):
    docs, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = util.clash(util.docs(spark, [t for _, t in docs]))
    hit = {d for d, _ in contained_brute(docs, items)}
    kept = decontamination.drop_contaminated(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - hit
    assert decontamination.contained(df.where("doc_id < 0"), bench).count() == 0
    assert decontamination.contained(df, bench.where("item_id < 0")).count() == 0
    twice = util.docs(spark, [items[3][1]] * 2, ids=[None, None])
    assert [(r.doc, r.item) for r in decontamination.contained(twice, bench.where("item_id = 3")).collect()] == [(None, 3)]


def test_op2_against_brute_force(spark, tmp_path):
    r = random.Random(4)
    texts = util.odd_texts() + [util.prose(400, k) for k in range(5)]
    for _, notice in license_scan.TEMPLATES:
        body = util.prose(500, len(texts)).split()
        texts.append(" ".join(body[:200]) + "\n" + notice + "\n" + " ".join(body[200:]))
        w = notice.split()
        w[r.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
        texts.append(notice.upper().replace(" ", "\n  * "))
    sf = util.write(spark, tmp_path, documents=util.clash(util.docs(spark, texts)))
    got = {(x.doc_id, x.template_id): (x.n_shingles, x.n_shared) for x in license_scan.op2_license_scan(spark, sf).collect()}
    import re

    words = lambda t: re.findall("[a-z0-9]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    expected = {}
    for d, t in enumerate(texts):
        have = grams(words(t))
        for k, (_, notice) in enumerate(license_scan.TEMPLATES):
            g = grams(words(notice))
            if len(g & have) / len(g) >= 0.8:
                expected[d, k] = (len(g), len(g & have))
    assert got == expected and len(got) > 30


def test_op2_notice_between_repeats(spark):
    """Repeats beside a notice don't hide it, whatever their hash."""
    number = 8
    notice = license_scan.TEMPLATES[number][1]
    texts = [" ".join([f"r{k}"] * 100 + [notice] + [f"r{k}"] * 100) for k in range(200)]
    found = license_scan.scan_licenses(util.docs(spark, texts)).where(F.col("template") == number)
    assert sorted((r.doc, r.n_shared) for r in found.collect()) == [(k, 17) for k in range(200)]


def test_license_library(spark, monkeypatch):
    import pytest

    df = util.docs(spark, ["we say: alpha beta gamma delta epsilon zeta", None])
    found = license_scan.scan_licenses(df, [("X", "Alpha, beta, gamma, delta: epsilon!")])
    assert [(r.doc, r.license) for r in found.collect()] == [(0, "X")]
    with pytest.raises(ValueError):
        license_scan.scan_licenses(df, [("short", "too few words")])
    monkeypatch.setattr(license_scan, "LIBRARY", 0)  # a large library is joined by shuffle
    found = license_scan.scan_licenses(df, [("X", "Alpha, beta, gamma, delta: epsilon!")])
    assert [(r.doc, r.license) for r in found.collect()] == [(0, "X")]
    assert license_scan.scan_licenses(df.where("doc_id > 5")).count() == 0


def test_op2_rests_on_its_bands(spark, monkeypatch):
    """Retrieval is by bands alone: with fewer of them notices are missed, with none nothing is found."""
    texts = [notice for _, notice in license_scan.TEMPLATES]
    df = util.docs(spark, [" ".join(t.split()[:-2]) for t in texts])
    whole = license_scan.scan_licenses(df, containment=0.5).count()
    monkeypatch.setattr(license_scan, "signatures", lambda rows, *by: rows.select(*by, "size", F.lit(0).alias("band"), F.col("h").alias("key")).limit(0))
    assert whole >= len(texts) - 4 and license_scan.scan_licenses(df, containment=0.5).count() == 0
