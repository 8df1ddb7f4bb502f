"""The pipeline against brute-force versions of its stages."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import util
from tests.llm.test_lines_quality import counts_brute
from tests.llm.test_near_dedup import components_brute, fp_brute
from tests.llm.test_search import contained_brute


def test_pipeline_against_brute_force(spark, tmp_path):
    items = [(k, util.prose(25, 500 + k)) for k in range(3)]
    texts = [util.prose(60 + 3 * k, k) for k in range(40)]
    texts += [texts[3], texts[3], texts[4] + " tail"] + [util.prose(100, 80) + " " + items[1][1] + " " + util.prose(70, 81)] + ["a b c " * 70, "few words", None, ""]
    texts += [texts[6]] * 20
    sources = [f"s{k % 3}" for k in range(len(texts))]
    df = util.docs(spark, texts, sources)
    sf = util.write(spark, tmp_path, documents=df, benchmark=spark.createDataFrame(items, "item_id long, text string"))
    kept = {k: t for k, t in enumerate(texts) if not counts_brute(t)[-1]}
    ids = sorted(kept)
    part = components_brute([fp_brute(kept[k]) for k in ids])
    kept = {ids[k]: kept[ids[k]] for k in range(len(ids)) if part[k] == k}
    hit = {d for d, _ in contained_brute(list(kept.items()), items)}
    kept = {k: t for k, t in kept.items() if k not in hit}
    docs = df
    for (name, stage), left in zip(corpus_pipeline.STAGES, (None, None, set(kept), None, None)):
        docs = stage(spark, docs, sf)
        if left is not None:
            assert {r.doc_id for r in docs.collect()} == left
        if name != "sharding":
            assert docs.columns == df.columns
    rows = corpus_pipeline.run(spark, sf).collect()
    copies = Counter(r.doc_id for r in rows)
    assert set(copies) <= set(kept) and max(copies.values()) <= 3
    sizes = {s: sum(len(t.split()) for k, t in kept.items() if sources[k] == s) for s in set(sources)}
    taken = Counter()
    for r in rows:
        assert r.text == kept[r.doc_id] and r.source == sources[r.doc_id]
        taken[r.source] += len(r.text.split())
    total = sum(sizes.values())
    for s, w in (("s0", 5), ("s1", 2), ("s2", 1)):
        assert abs(taken[s] - total * w / 8) <= 400
    shard = {}
    for r in rows:
        assert shard.setdefault(r.text, r.shard) == r.shard
    assert sorted(map(str, rows)) == sorted(map(str, corpus_pipeline.run(spark, sf).collect()))


def test_pipeline_of_nothing(spark, tmp_path):
    sf = util.write(spark, tmp_path, documents=util.docs(spark, []), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_pipeline_with_clashing_columns(spark, tmp_path):
    """Every name that a stage uses may be a column of documents; the result can be written."""
    texts = util.odd_texts() + [util.prose(60 + k, k) for k in range(20)]
    df = util.clash(util.docs(spark, texts, [f"s{k % 2}" for k in range(len(texts))])).withColumn("slot", F.lit("x")).withColumn("_Slot", F.lit("y"))
    sf = util.write(spark, tmp_path, documents=df, benchmark=spark.createDataFrame([(1, util.prose(30, 900))], "item_id long, text string"))
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*df.columns, "__shard", "__slot"]
    out.write.parquet(f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert rows and all(r["shard"] == 7 and r["slot"] == "x" and 0 <= r["__shard"] < 16 for r in rows)
