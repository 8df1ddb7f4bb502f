"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import common, decontamination, mixing, near_dedup, quality_rules, sharding


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the others lose the lines that their host repeats above the limit, and n_chars follows.

    A null or empty text, and one below 50 words, is rejected. A null source is a host of its own. Rows that are equal in all columns, and
    equal texts under different ids, are kept alike (near-dedup is for them). Texts of any length are read whole. No rows give none.
    """
    kept = quality_rules.keep_good(docs)
    return kept.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: that of the least doc_id.

    Texts without a word are alike, so one of them stays. Rows of one id and text are one document, and one row of them stays. A null id comes before all others. A
    long text has one fingerprint of all its shingles. No rows give none.
    """
    return near_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    A null or empty text holds none, an item without text is in none. All rows of an id whose text holds one go. Long texts are searched whole. No
    items leave all rows.
    """
    return decontamination.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, so a row may repeat.

    A text without a word has size 0 and counts for nothing in the mix. A null source is a source, the last in order. Repeated rows and ties are told apart
    by a hash of the row, and equal rows by their number. One text may be larger than its source's target; it is taken whole or not. No rows give none.
    """
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in 16 shards of near equal bytes, equal texts together: the columns of documents, shard and slot.

    Null counts as the empty text. A text larger than a shard's share makes its shard larger. Repeated rows have a slot each. Where
    documents have a column shard or slot of their own, both new names get underscores before them until they are free. No rows give none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    taken, prefix = {c.lower() for c in docs.columns}, ""
    while {f"{prefix}shard", f"{prefix}slot"} & taken:
        prefix += "_"
    return sharding.assign_shards(docs, F.octet_length(text) + 1, text, [F.col("doc_id")], prefix=prefix)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dups),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again as the next one's input.

    What a stage writes on its way, and its input once its output is written, is deleted; the last stage's tables are read by the result.
    """
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with common.scratch():
            docs = common.keep(common.materialise(stage(spark, docs, sf_dir), name))
        common.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: MinHash, SimHash, pivotal rounding and the heap have no SQL form; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None
