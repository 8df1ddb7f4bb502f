"""Shuffles whose tasks stay of one size: as many partitions as the input is large."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of input files for each partition.
SHARE = 8 << 20
#: Shares from which on a join is dealt.
WORTH = 16


def partitions(df: DataFrame, share: int | None = None) -> int:
    """How many shares of `share` bytes the files that df reads hold; 0 for less than one."""
    spark = df.sparkSession
    conf, size = spark._jsc.hadoopConfiguration(), 0
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        size += path.getFileSystem(conf).getFileStatus(path).getLen()
    return -(-size // (share or SHARE)) if size >= (share or SHARE) else 0


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """df hashed by the keys to n partitions, but at least one for each core; 0 leaves it to Spark, which merges partitions up to a size of its own."""
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys) if n else df


def sides(df: DataFrame, n: int) -> int:
    """Partitions for both sides of a join of n shares; 0, which leaves it to Spark, for less than WORTH. Spark would shuffle what has fewer than its own number once more."""
    return max(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if n >= WORTH else 0


def joined(left: DataFrame, right: DataFrame, n: int, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """left and right, whose column names differ, where the keys are equal; both are dealt by them to n partitions.

    Spark would shuffle what has fewer partitions than its own number once more, so they are at least as many; inputs of less than WORTH shares are left to it.
    """
    n = sides(left, n)
    return dealt(left, n, left_key).join(dealt(right, n, right_key), F.col(left_key) == F.col(right_key), how)
