"""Quality rules: counts within a text, and lines that too many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm import common

SYMBOLS = "#*$%&|<>"
#: Bits of a packed window that hold its position; texts with more words take the unpacked way.
POSITION_BITS = 20


def covered(starts: Column, span: int) -> Column:
    """Number of positions that the windows [p, p + span) of the sorted array `starts` cover together."""
    return F.when(F.size(starts) == 0, F.lit(0)).otherwise(
        F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-span).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(span), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    )


def neighbours_equal(s: Column, part=lambda x: x) -> Column:
    """The elements of the sorted array s that equal the one before or after them, by `part`."""
    return F.filter(s, lambda x, i: ((i > 0) & (part(x) == part(F.get(s, i - 1)))) | ((i < F.size(s) - 1) & (part(x) == part(F.get(s, i + 1)))))


def with_counts(rows: DataFrame, text: Column) -> DataFrame:
    """rows with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text; a null one has no words.

    Windows of three words that occur twice are looked for only where the set of window hashes is smaller than their number. They
    are found by sorting the hashes packed with their positions; positions found so are compared by full 64-bit hashes again.
    """
    text = F.coalesce(text, F.lit(""))
    low = (1 << POSITION_BITS) - 1
    out = rows.withColumn("_text", text).withColumn("_words", common.words(F.col("_text"))).withColumn("_size", F.size("_words"))
    hashed = F.transform(F.sequence(F.lit(0), F.col("_size") - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))
    out = out.withColumn("_h", F.when(F.col("_size") >= 3, hashed).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn("_again", F.size(F.array_distinct("_h")) < F.size("_h"))
    packed = F.sort_array(F.transform("_h", lambda h, i: F.shiftleft(F.shiftright(h, POSITION_BITS), POSITION_BITS).bitwiseOR(i.cast("long"))))
    out = out.withColumn("_packed", F.when(F.col("_again") & (F.size("_h") <= low), packed))
    at = F.transform(neighbours_equal(F.col("_packed"), lambda x: F.shiftright(x, POSITION_BITS)), lambda x: x.bitwiseAND(F.lit(low)).cast("int"))
    every = F.sequence(F.lit(0), F.size("_h") - 1)
    none = F.array().cast("array<int>")
    out = out.withColumn("_at", F.when(~F.col("_again"), none).when(F.size("_h") <= low, at).otherwise(every))
    out = out.withColumn("_same", F.array_sort(F.transform("_at", lambda i: F.struct(F.get("_h", i).alias("h"), i.alias("i")))))
    repeats = F.array_sort(F.transform(neighbours_equal(F.col("_same"), lambda x: x["h"]), lambda x: x["i"]))
    bare = F.translate("_text", common.WHITE, "")
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.btrim(x, F.lit(common.WHITE)) != "")
    out = out.withColumn("_repeats", repeats).withColumn("_lines", lines).withColumn("_bare", bare)
    return out.select(
        *rows.columns,
        F.col("_size").cast("long").alias("n_words"),
        F.char_length("_bare").cast("long").alias("word_chars"),
        (F.char_length("_bare") - F.char_length(F.translate("_bare", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered(F.col("_repeats"), 3).cast("long").alias("n_repeat_words"),
    )


#: Code points of the shortest line that counts across documents.
MIN_LINE = 20
#: A line is above the limit of a host once more documents of it than this have the line.
MAX_DOCUMENTS = 10
#: A document is depleted if less than this share of its words, or fewer than so many words, are left.
KEEP_SHARE, MIN_WORDS = 0.3, 50


def normalised_lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: common.ascii_lower(F.btrim(x, F.lit(common.WHITE))))


def digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def keyed(docs: DataFrame, id_col: str, host_col: str, text_col: str) -> DataFrame:
    """Rows (id, host, text): names of docs' own columns play no part after this."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{host_col}`").alias("host"), F.col(f"`{text_col}`").alias("text"))


def frequent_lines(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", limit: int = MAX_DOCUMENTS) -> DataFrame:
    """Rows (host, digest, documents, holder): lines that more than `limit` different documents (ids) of a host have.

    Lines are lower-cased (A-Z), without white space at their ends; those under MIN_LINE code points don't count. A line counts
    once a document, however often it has it; rows of one id are one document; null hosts are one host. holder is the least id of
    them: there the line is at its place, everywhere else it is a repeat.
    """
    kept = F.filter(normalised_lines(F.col("text")), lambda x: F.char_length(x) >= MIN_LINE)
    lines = keyed(docs, id_col, host_col, text_col).select("id", "host", F.explode(F.transform(F.array_distinct(kept), digest)).alias("digest"))
    # a line of many documents is counted in two steps, spread by id first
    counted = lines.distinct().groupBy("host", "digest").agg(F.count(F.lit(1)).alias("documents"), F.min("id").alias("holder"))
    return counted.where(F.col("documents") > limit)


def lines_lost(docs: DataFrame, frequent: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """Rows (id, host, text_hash, lost, lost_words): places of the lines that each text loses, and their words. Repeated rows count once."""
    line = F.posexplode(normalised_lines(F.col("text"))).alias("pos", "line")
    at = keyed(docs, id_col, host_col, text_col).select("id", "host", F.xxhash64("text").alias("text_hash"), line).where(F.char_length("line") >= MIN_LINE)
    at = at.select("id", "host", "text_hash", "pos", digest(F.col("line")).alias("digest"), common.word_count(F.col("line")).alias("n"))
    much = frequent.select(F.col("host").alias("h"), F.col("digest").alias("d"), "holder")
    hits = at.join(much, F.expr("host <=> h and digest = d and not id <=> holder")).groupBy("id", "host", "text_hash", "pos").agg(F.max("n").alias("n"))
    return hits.groupBy("id", "host", "text_hash").agg(F.collect_list("pos").alias("lost"), F.sum("n").alias("lost_words"))


def with_verdict(rows: DataFrame, docs: DataFrame, id_col: str, host_col: str, text_col: str, limit: int, keep_share: float) -> DataFrame:
    """rows (id, host, text and others) with the counts, text_hash, lost, lost_words, base_failed and kept; the lines are those of docs."""
    frequent = common.materialise(frequent_lines(docs, id_col, host_col, text_col, limit), "frequent-lines")
    lost = common.materialise(lines_lost(docs, frequent, id_col, host_col, text_col), "lost-lines")
    told = lost.select(F.col("id").alias("i"), F.col("host").alias("o"), F.col("text_hash").alias("t"), "lost", "lost_words")
    counted = with_counts(rows.withColumn("text_hash", F.xxhash64("text")), F.col("text"))
    met = counted.join(told.hint("merge"), F.expr("id <=> i and host <=> o and text_hash = t"), "left").drop("i", "o", "t")
    met = met.withColumn("lost_words", F.coalesce("lost_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("lost_words")
    depleted = (left < keep_share * F.col("n_words")) | (left < MIN_WORDS)
    return met.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def stripped(met: DataFrame) -> DataFrame:
    """met with `text` less the lines at the places `lost` (null: none); a null text stays null."""
    lines = met.withColumn("lines", F.split("text", "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "lost")  # by a hash set, in order
    text = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    return lines.withColumn("text", F.when(F.col("lost").isNull() | F.col("text").isNull(), F.col("text")).otherwise(text))


def judge(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", limit: int = MAX_DOCUMENTS, keep_share: float = KEEP_SHARE) -> DataFrame:
    """Rows (id, host, the counts of with_counts, lost_words, base_failed, kept, text_hash, lost), one for each row of docs.

    base_failed: under 50 words, or over half of the words in windows of three words that the text repeats. Any other document
    is kept unless the lines that its host repeats too often (frequent_lines) leave less than keep_share of its words or fewer
    than 50. Repeated rows fare alike. A null or empty text fails. A line of any length is one line. An empty table stays empty.
    """
    rows = keyed(docs, id_col, host_col, text_col)
    return with_verdict(rows, docs, id_col, host_col, text_col, limit, keep_share).drop("text")


def keep_good(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", limit: int = MAX_DOCUMENTS, keep_share: float = KEEP_SHARE) -> DataFrame:
    """docs without the rows that judge() rejects; the texts of the others lose the lines above the limit. Columns stay, in their order."""
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{host_col}`").alias("host"), F.col(f"`{text_col}`").alias("text"))
    judged = with_verdict(rows, docs, id_col, host_col, text_col, limit, keep_share).select("row", "lost", "kept")
    # written before it is filtered: a filter pushed below the counts would work them out anew in every lambda
    kept = common.materialise(judged, "judged").where("kept").withColumn("text", F.col(f"row.`{text_col}`"))
    return stripped(kept).select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def remove_frequent_lines(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", limit: int = MAX_DOCUMENTS) -> DataFrame:
    """docs whose texts have lost the lines above the limit, but none rejected."""
    frequent = common.materialise(frequent_lines(docs, id_col, host_col, text_col, limit), "frequent-lines")
    lost = lines_lost(docs, frequent, id_col, host_col, text_col).select(F.col("id").alias("i"), F.col("host").alias("o"), F.col("text_hash").alias("t"), "lost")
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{host_col}`").alias("host"), F.col(f"`{text_col}`").alias("text"))
    met = rows.join(lost, F.expr("id <=> i and host <=> o and xxhash64(text) = t"), "left")
    return stripped(met).select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """All documents with the base counts and the verdict."""
    judged = judge(common.table(spark, sf_dir, "documents"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words"]
    return judged.select(F.col("id").alias("doc_id"), *names, F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_lost_lines"))


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^ 	-
]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS ls FROM d),
tri AS (
  SELECT doc_id, i, (ws[i], ws[i + 1], ws[i + 2]) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, g FROM tri GROUP BY ALL HAVING count(*) > 1),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM tri JOIN twice USING (doc_id, g), (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, source, pos, md5(k) AS m, len(regexp_extract_all(k, '[^ 	-
]+')) AS n
  FROM (SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS pos,
               translate(trim(unnest(string_split(text, chr(10))), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                         '{common.UPPER}', '{common.LOWER}') AS k FROM d)
  WHERE length(k) >= {MIN_LINE}),
bad AS (
  SELECT source, m, min(doc_id) AS holder FROM lines
  GROUP BY source, m HAVING count(DISTINCT doc_id) > {MAX_DOCUMENTS}),
lost AS (
  SELECT doc_id, sum(n) AS n, count(*) AS k FROM lines l JOIN bad b ON l.m = b.m AND l.source IS NOT DISTINCT FROM b.source AND doc_id <> holder GROUP BY doc_id),
c AS (
  SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS lost_words,
         coalesce(lost.k, 0)::BIGINT AS n_lost_lines
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id LEFT JOIN lost ON w.doc_id = lost.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - lost_words >= {KEEP_SHARE} * n_words
         AND n_words - lost_words >= {MIN_WORDS} AS kept, lost_words, n_lost_lines
FROM c
"""
