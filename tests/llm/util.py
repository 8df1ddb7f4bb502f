"""Small tables for the tests of the corpus operators."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None, ids=None, langs=None):
    rows = []
    for k, t in enumerate(texts):
        rows.append((ids[k] if ids else k, t, langs[k] if langs else "en", sources[k] if sources else "s", len(t) if t is not None else None))
    return spark.createDataFrame(rows, SCHEMA)


def write(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def prose(n, seed=0, vocab=400):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(vocab)]
    return " ".join(r.choice(words) for _ in range(n))


def odd_texts():
    """Null, empty, blank, one word, a very long text, repeats, and texts beyond ASCII."""
    return [None, "", " \t\n", "word", prose(30000, 1), prose(80, 2), prose(80, 2), "Ünï cödé " * 40, "\n\n\n", "x" * 5000]


def clash(df):
    """The table with extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    for name in ("size", "shard", "id", "key", "n", "kept", "row", "fp", "target", "doc", "host", "i", "like", "lost", "__id", "__doc", "__row", "__hash", "__row_like", "__digests"):
        df = df.withColumn(name, F.lit(7))
    return df
