"""Shared pieces of the corpus operators: reading, materialising, hashing, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.lineage import discard, keep, materialise, scratch

__all__ = ["discard", "keep", "materialise", "scratch", "table", "ascii_lower", "words", "word_count", "text_hash", "unit", "without", "row_hash"]

#: The six ASCII whitespace characters that separate words, as a regex class and as text.
WHITE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else. All-ASCII texts take the faster lower(), which does the same there."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column) -> Column:
    """The words of a text, in order; null gives none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), WHITE_CLASS + "+", -1), lambda w: w != "")


def word_count(c: Column) -> Column:
    """Number of words, as the number of separators between the first and the last of them."""
    bare = F.btrim(F.coalesce(c, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, WHITE_CLASS + "+", -1))).cast("long")


def text_hash(c: Column) -> list[Column]:
    """128 bits of a value, as two 64-bit hashes of different seeds."""
    return [F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(7), c).alias("h2")]


def unit(*keys: Column) -> Column:
    """A uniform number in [0, 1) that depends on the keys alone, so that reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") * F.lit(2.0**-53)


#: Up to so many keys (some 100 bytes each) are broadcast to drop rows; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def without(docs: DataFrame, keys: DataFrame, on: dict[str, Column]) -> DataFrame:
    """docs less the rows that match a row of keys (written before, as it is counted and then joined).

    on: for each column of keys what it equals in docs (nulls are equal). docs may have columns of any names.
    """
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    left = docs.select(F.struct("*").alias("row"), *[c.alias(f"d{i}") for i, c in enumerate(on.values())])
    right = keys.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(on)])
    same = F.expr(" and ".join(f"d{i} <=> k{i}" for i in range(len(on))))
    return left.join(F.broadcast(right) if few else right, same, "left_anti").select("row.*")


def row_hash(df: DataFrame) -> Column:
    """64 bits over all columns; a null counts by its place."""
    each = [c for name in df.columns for c in (F.col(f"`{name}`").isNull(), F.col(f"`{name}`").cast("string"))]
    return F.xxhash64(*each)
