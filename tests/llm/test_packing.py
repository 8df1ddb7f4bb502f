"""Packing against the tokenizer on whole texts, and the curve against its definition."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tesserae.llm import packing
from tests.llm import util

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("dims,bits", [(2, 1), (2, 3), (3, 2), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = packing.hilbert(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_cuts_need_no_padding():
    for total in (0, 1, 7, 4095, 4096, 4097, 12345):
        full, tail = packing.cuts(total, 4096)
        assert full * 4096 + sum(tail) == total and len(set(tail)) == len(tail) and all(t & (t - 1) == 0 for t in tail)


def test_runs_give_the_ids_of_whole_texts(monkeypatch):
    whole = Tokenizer.from_file(PATH)
    r = random.Random(1)
    texts = [t or "" for t in util.odd_texts()] + ["It's <|endoftext|> A.B c1d2 x y", "é É ́ a", "\x1c\x1d a\x85b", "’s 'S're", "T̈ Ï ü. İ", "<|EndOfText|> a.<|endoftext|>b", "aΣ.Σ,b…,c", "Straße ÀÉÎÕÜ œŒ Ÿ ŉ ǰ ǅ ſ ª º ƛ ɏɐ naïve, élan'vital 'été (été", "é,a è.\" é×, ÷. «é», ñ« Ȿ, é'", "ﬁ ΑΣ ΌΣΟΣ. İ ǅ", "a" * 3000]
    texts += ["".join(r.choice("abZ 'É́\t\n1 .ß漢€") for _ in range(300)) for _ in range(60)]
    monkeypatch.setattr(packing, "STEP", 50)
    monkeypatch.setattr(packing, "CACHED", 40)
    ids = packing.Ids(PATH)
    together = packing.Ids(PATH).of_all([t.encode() for t in texts])
    for t, found in zip(texts, together):
        assert found == ids.of(t.encode())
        assert np.frombuffer(ids.of(t.encode()), ids.dtype).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, ids = Tokenizer.from_file(path), packing.Ids(path)
    assert not ids.by_runs and packing.Ids(PATH).direct
    for t in ("one two  three\n\n", "", "É x"):
        assert np.frombuffer(ids.of(t.encode()), ids.dtype).tolist() == whole.encode(t, add_special_tokens=False).ids


def check(rows, texts, length=4096):
    whole = Tokenizer.from_file(PATH)
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for k, t in texts.items():
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(parts.pop(k), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert not parts
    sizes = {}
    for s, found in sequences.items():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        sizes[s] = at
    assert sorted(sizes) == list(range(len(sizes)))
    assert all(v == length or (v < length and v & (v - 1) == 0) for v in sizes.values())


def test_op11(spark, tmp_path):
    texts = dict(enumerate(util.odd_texts() + [util.prose(20 + k % 90, k % 70) for k in range(400)] + ["same text here"] * 300))
    df = util.docs(spark, list(texts.values())).repartition(7)
    sf = util.write(spark, tmp_path, documents=util.clash(df))
    rows = packing.op11_packing(spark, sf).collect()
    check(rows, texts)
    again = packing.op11_packing(spark, sf).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_repeated_rows_null_ids_and_nothing(spark):
    rows = util.docs(spark, ["one two", "one two", None, ""], ids=[4, 4, 5, 6])
    got = packing.pack(rows, PATH).collect()
    assert sum(r.length for r in got) == 8 and {r.doc_id for r in got} == {4, 5, 6}
    null = spark.createDataFrame([(None, "a b"), (None, "c")], "doc_id long, text string")
    assert sum(r.length for r in packing.pack(null, PATH).collect()) == 5
    assert packing.pack(util.docs(spark, []), PATH).count() == 0


def test_neighbours_share_words(spark):
    vocab = [[f"{chr(97 + a)}{chr(97 + b)}{chr(97 + t)}" for a in range(6) for b in range(6)] for t in range(8)]
    r = random.Random(2)
    topic = {k: r.randrange(8) for k in range(800)}
    df = util.docs(spark, [" ".join(r.choice(vocab[topic[k]]) for _ in range(120)) for k in range(800)])
    rows = sorted(packing.pack(df, PATH).where("start = 0").collect(), key=lambda r: (r.sequence_id, r.offset))
    same = sum(topic[a.doc_id] == topic[b.doc_id] for a, b in zip(rows, rows[1:])) / 799
    assert same > 0.6  # an eighth by chance
