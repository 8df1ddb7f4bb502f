"""The language model's states are told apart by all rows that it may learn from."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tesserae.llm import lm_scoring


def test_no_bound_on_the_rows_that_states_come_from(spark, monkeypatch):
    r = random.Random(2)
    words = {"a": ["ba", "be", "bi", "bo"], "b": ["ku", "ka", "ko", "ke"]}
    rows = [(k, " ".join(r.choices(words["ab"[k % 2]], k=12)), "ab"[k % 2]) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counted, seen = lm_scoring.counted, []

    def watched(df, *more):
        seen.append(df.count())
        return counted(df, *more)

    monkeypatch.setattr(lm_scoring, "counted", watched)
    monkeypatch.setattr(lm_scoring, "CLASSED_ROWS", 10, raising=False)
    assert lm_scoring.score_documents(docs, F.col("doc_id") % 10 != 0).count() == 60
    assert seen[0] == 54


def vocabulary(rows):
    return pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.binary()), pa.array([0] * len(rows), pa.int32()), pa.array([c for _, c in rows], pa.int64())], ["tok", "z", "c"])


def summed(batches, bits):
    flat = np.zeros(lm_scoring.ORDERS * (2 << bits))
    for b in batches:
        places, values = lm_scoring.unpacked(b.column(1)[0].as_py())
        flat[b.column(0)[0].as_py() * lm_scoring.ROW + places.astype(np.int64)] += values
    return flat


def test_count_tables_take_four_bytes_a_slot():
    bits = 18
    tags = lm_scoring.tags_of([(b"abc", 0)], bits)
    list(lm_scoring.count_tables(iter([vocabulary([(b"abc", 3)])]), tags, bits))  # what is imported late
    tracemalloc.start()
    rows = list(lm_scoring.count_tables(iter([vocabulary([(b"abc", 3), (b"b", 0)])]), tags, bits))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows and peak < 1.4 * 4 * lm_scoring.ORDERS * (2 << bits)


def test_counts_beyond_a_slot_are_whole(monkeypatch):
    bits = 16
    tags = lm_scoring.tags_of([(b"abc", 0), (b"abd", 0)], bits)
    some = [(b"abc", 7), (b"abd", 11), (b"", 5), (b"x", 0)]
    small = summed(lm_scoring.count_tables(iter([vocabulary(some)]), tags, bits), bits)
    large = summed(lm_scoring.count_tables(iter([vocabulary([(t, c << 30) for t, c in some])]), tags, bits), bits)
    assert (large == small * 2.0**30).all() and small.sum() > 0
    monkeypatch.setattr(lm_scoring, "FULL", 30)
    assert (summed(lm_scoring.count_tables(iter([vocabulary(some)] * 3), tags, bits), bits) == 3 * small).all()


def test_texts_are_taken_a_few_at_a_time():
    b = vocabulary([(b"%d" % k, k) for k in range(1000)])
    parts = list(lm_scoring.slices(iter([b, b.slice(0, 0)])))
    assert max(p.num_rows for p in parts) == lm_scoring.TEXTS and pa.Table.from_batches(parts).equals(pa.Table.from_batches([b]))
