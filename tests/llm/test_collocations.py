"""Collocations against brute force, and the perfect hash."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tesserae.llm import collocations
from tests.llm import util


def brute(docs, least=10, absorbed=50, top=2000):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    good = {x: c for x, c in f.items() if c >= least and len(x[1]) > 1}
    gone = set()
    for (lang, w), c in good.items():
        if len(w) == 3:
            gone |= {(lang, part) for part in (w[:2], w[1:]) if 100 * c >= absorbed * f[lang, part]}
    rows = []
    for (lang, w), a in good.items():
        if (lang, w) not in gone:
            score, k = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            rows.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right, total in sorted(rows):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, total, -score))
    return out


def corpus():
    r = random.Random(6)
    vocab = ["Aa", "bb", "c", "dé", "ee", "F", "gg", "hh", "z" * 70, "漢字"]
    texts = [" ".join(r.choice(vocab) + r.choice(["", "", "", ",", ".", "\t", "  ", " x"]) for _ in range(r.randint(0, 90))) for _ in range(220)]
    texts += ["the quick fox " * 40, "aa aa aa aa " * 9, None, "", " \t ", "...;;\x0b\x0c", "one two three\r" * 12, "x\x1cy z " * 11]
    return [(t, r.choice(["en", "de", None, "und"])) for t in texts]


def got(spark, docs, **kw):
    df = spark.createDataFrame([(k, t, x, "s", 1) for k, (t, x) in enumerate(docs)], util.SCHEMA).repartition(5)
    return sorted(map(tuple, collocations.collocations(util.clash(df), **kw).collect()))


def test_against_brute_force(spark):
    docs = corpus()
    assert got(spark, docs) == sorted(brute(docs))
    assert got(spark, docs, least=3, absorbed=80, top=20) == sorted(brute(docs, 3, 80, 20))
    assert len(brute(docs)) > 100


def test_small_blocks_stretches_and_sent_occurrences(spark, monkeypatch):
    """The same rows where occurrences go to the blocks' tasks, with many blocks, salts, stretches and steps of the sum, and with a filter that lets all through."""
    for name, value in (("WINDOW", 90), ("CHUNK", 700), ("COMBINE", 50), ("BLOCK", 16), ("TAKEN", 64), ("FAN_IN", 2), ("FILTER_BITS", 7)):
        monkeypatch.setattr(collocations, name, value)
    docs = corpus()
    expected = sorted(brute(docs))
    assert got(spark, docs) == expected
    monkeypatch.setattr(collocations, "SENT", 10)
    assert got(spark, docs) == expected


def test_counts_past_64_bits(spark):
    f = spark.createDataFrame([("en", "a b", 2, 9 * 10**12, 1, 10**13, 10**13)], collocations.CUT)
    from pyspark.sql import functions as F

    score = F.expr("(1000000 * cast(f as decimal(38,0)) * cast(f as decimal(38,0))) div (cast(l as decimal(38,0)) * cast(r as decimal(38,0)))")
    assert f.select(score).first()[0] == 10**6 * (9 * 10**12) ** 2 // 10**26


def test_perfect_hash():
    r = np.random.default_rng(1)
    for n in (1, 2, 50, 3000):
        a, b = r.integers(0, 1 << 64, (2, n), np.uint64)
        a[: n // 3] = a[0]  # told apart by the second key alone
        made = collocations.PerfectHash.build(a, b)
        assert sorted(made.verified(a, b).tolist()) == list(range(n))
        again = collocations.PerfectHash.unpacked(**made.packed())
        assert (again.verified(a, b) == made.verified(a, b)).all()
        strange = again.verified(a, b + np.uint64(1))
        assert (strange == -1).all()


def test_nothing(spark):
    assert got(spark, []) == [] and got(spark, [(None, "en"), ("", None)]) == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op13_matches_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{path}/documents.parquet'")
    rel = c.sql(collocations.OP13_SQL)
    df = collocations.op13_collocations(spark, path)
    assert sorted(rel.columns) == sorted(df.columns)
    at = [rel.columns.index(x) for x in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[k] for k in at) for r in rel.fetchall())
