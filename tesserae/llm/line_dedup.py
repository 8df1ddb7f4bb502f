"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import common

KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return common.ascii_lower(F.btrim(line, F.lit(common.WHITE)))


class LineRuns:
    """Levels of sorted runs: entries (h1, h2, n_docs, max_id), each run sorted by key within ranges of the key's hash.

    A batch is aggregated to one entry a key and merge-anti-joined with all runs: what no run has is added to level 0 as a run
    of its own, so a key is in one run only; what some run has becomes a run of changes. When a level has `fanout` runs they are
    merged into one run of the next level, so a key is rewritten once a level and the number of runs stays logarithmic in the
    number of batches; changes are added up in the same rhythm. Batches must not share documents.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout, self.levels, self.changes = spark, fanout, [[]], []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def union(self, runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        return out

    def added(self, runs: list[DataFrame]) -> DataFrame:
        return self.union(runs).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("max_id").alias("max_id"))

    def write(self, entries: DataFrame) -> DataFrame:
        return common.materialise(entries.repartition(*KEY).sortWithinPartitions(*KEY), "run")

    def absent(self, entries: DataFrame, known: DataFrame) -> DataFrame:
        """The entries whose key no run has."""
        return entries.join(known, KEY, "left_anti")

    def ingest(self, occurrences: DataFrame) -> DataFrame:
        """occurrences: id, h1, h2 (one row for each document and key). Returns the batch's new run: the keys that no earlier batch had."""
        entries = occurrences.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("max_id"))
        if runs := self.runs():
            known = self.union([r.select(*KEY) for r in runs])
            fresh = self.write(self.absent(entries, known))
            self.changes.append(self.write(entries.join(known, KEY, "left_semi")))
        else:
            fresh = self.write(entries)
        self.levels[0].append(fresh)
        return fresh

    def compact(self) -> None:
        """To be called between batches: rewrites full levels and deletes their runs."""
        k = 0
        while k < len(self.levels):
            if len(full := self.levels[k]) >= self.fanout:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self.write(self.union(full)))
                self.levels[k] = []
                for r in full:
                    common.discard(r)
            k += 1
        if len(self.changes) > self.fanout:
            old, self.changes = self.changes, [self.write(self.added(self.changes))]
            for r in old:
                common.discard(r)

    def total(self) -> DataFrame:
        """One entry for each key over all batches: that of its run with the changes added."""
        entries = self.union(self.runs())
        if not self.changes:
            return entries
        later = self.added(self.changes).select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.col("n_docs").alias("more"), F.col("max_id").alias("later_id"))
        met = entries.join(later, F.expr("h1 = c1 and h2 = c2"), "left")
        return met.select(*KEY, (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("max_id", "later_id").alias("max_id"))

    def discard(self) -> None:
        for r in [*self.runs(), *self.changes]:
            common.discard(r)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20, batches: int = 4, prefix: str = "") -> DataFrame:
    """docs without the lines that documents share, and <prefix>n_lines, <prefix>n_dropped.

    Lines end at \\n; a null or empty text is one empty line. A key (see line_key) of at least min_chars code points that is in
    at least min_docs documents loses all its lines but those of the largest id that has it, repeats in that document included.
    Rows with the same id are one document. A null id is a document below all others. The kept lines are joined by \\n again
    (a document that loses all its lines has the empty text). Dropped lines are known by their places, so the work on a text is
    in proportion to its lines however many go. An empty table stays empty.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    lines = rows.select("id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where(F.char_length("line") >= min_chars)
    h1, h2 = common.text_hash(F.col("key"))
    found = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars).select("id", "text_hash", "pos", h1, h2)
    found = common.materialise(found.withColumn("batch", F.pmod(F.xxhash64(F.lit(3), F.col("id")), F.lit(batches)).cast("int")), "lines")
    store = LineRuns(docs.sparkSession)
    for k in range(batches):
        store.ingest(found.where(F.col("batch") == k).select("id", *KEY).distinct())
        store.compact()
    shared = common.materialise(store.total().where(F.col("n_docs") >= min_docs).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "max_id"), "shared")
    store.discard()
    lost = found.join(shared, F.expr("h1 = k1 and h2 = k2 and not id <=> max_id"))
    drops = common.materialise(lost.groupBy("id", "text_hash").agg(F.collect_set("pos").alias("lost")).withColumnsRenamed({"id": "i", "text_hash": "t"}), "drops")
    for x in (found, shared):
        common.discard(x)
    met = rows.join(drops, F.expr("id <=> i and xxhash64(text) = t"), "left").withColumn("lines", F.split("text", "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "lost")  # by a hash set, in order
    kept = F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    names = [kept.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return met.select(*names, F.size("lines").cast("long").alias(f"{prefix}n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias(f"{prefix}n_dropped"))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without shared lines, as counts and the digest of what stays."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH ids AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM ids),
keyed AS (
  SELECT doc_id, n, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
shared AS (
  SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT doc_id, n, line, s.k IS NOT NULL AND doc_id <> s.holder AS dropped FROM keyed LEFT JOIN shared s USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
