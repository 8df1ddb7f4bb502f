"""Benchmark decontamination by size-partitioned MinHash containment search."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import common
from tesserae.llm import shingles as sh

WIDTH = 5
CONTAINMENT = 0.8
#: Hash functions of a signature; each is a band of its own.
#: A size partition holds items of U/2 < n <= U shingles and searches windows of 2U shingles that begin every U, among those of the
#: text that any item has. So an item that stands in a text lies whole in one of them. At the containment C the Jaccard index with that window is at least
#: C * U/2 / (2U + (1 - C) * U/2) = 0.19, and no band meets with a probability of 0.81 ** 64 = 1.4e-6. Items that stand whole
#: have 0.25 or more: 1e-8.
HASHES = 64
MULTIPLIERS = sh.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: log2 of the bits of a filter: FILTER_SPARE bits a key, between the two bounds. Beyond the upper one (16 MB) more keys only let more through.
FILTER_LEAST, FILTER_MOST, FILTER_SPARE = 16, 27, 6
#: Shingles of a text's windows whose signatures are held at a time.
CHUNK = 1 << 15


class Search(NamedTuple):
    """What a task needs of the items: filters of bounded size, the size partitions in use, and the widths of items under WIDTH words."""

    bands: np.ndarray
    shingles: np.ndarray
    partitions: tuple[int, ...]
    short: tuple[int, ...]
    containment: float


def filter_bits(keys: int) -> int:
    return min(max(FILTER_LEAST, keys.bit_length() + FILTER_SPARE), FILTER_MOST)


def lookup(filt: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter, whose bits are a power of 2, lets each hash through."""
    at = (hashes >> np.uint64(64 - (len(filt).bit_length() + 2))).astype(np.int64)
    return (filt[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def band(values: np.ndarray, hash_number: np.ndarray, partition: int) -> np.ndarray:
    """The key of a band: the least value under one hash function, in one size partition."""
    return sh.mix(values ^ (hash_number.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(partition + 1)))


def partition_of(n: int) -> int:
    """log2 of U for an item of n shingles."""
    return max(0, (n - 1).bit_length())


def permuted(hashes: np.ndarray) -> np.ndarray:
    """One row for each hash function. The high half of a product depends on all lower bits."""
    return (hashes[None, :] * MULTIPLIERS[:, None]) ^ (hashes[None, :] >> np.uint64(29))


def own_shingles(words: np.ndarray) -> np.ndarray:
    """Distinct shingle hashes of an item; under WIDTH words they are one shingle."""
    return np.unique(sh.shingle_hashes(words, min(WIDTH, len(words)))) if len(words) else np.zeros(0, np.uint64)


def item_rows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (item, n_words, n, partition, bands, grams, hashes) of items with a word; grams are the distinct shingles as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = b.column(0), []
            for k, text in enumerate(b.column(1).to_pylist()):
                raw = sh.encoded(text)
                data = np.frombuffer(raw, np.uint8)
                starts, ends = sh.bounds(data)
                if not len(starts):
                    continue
                parts = raw.split()
                width = min(WIDTH, len(parts))
                grams = list({b" ".join(parts[i : i + width]) for i in range(len(parts) - width + 1)})
                hashes = own_shingles(sh.word_hashes(data, starts, ends))
                if width < WIDTH:
                    part, keys = -width, band(hashes, np.zeros(1, np.uint64), -width + 64)
                else:
                    part = partition_of(len(hashes))
                    keys = band(permuted(hashes).min(1), np.arange(HASHES), part)
                out.append((k, len(parts), len(grams), part, keys.view(np.int64).tolist(), grams, hashes.view(np.int64).tolist()))
            if out:
                at, n_words, n, part, keys, grams, hashes = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at)), pa.array(n_words, pa.int64()), pa.array(n, pa.int64()), pa.array(part, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(grams, pa.list_(pa.binary())), pa.array(hashes, pa.list_(pa.int64()))],
                    ["item", "n_words", "n", "partition", "bands", "grams", "hashes"],
                )

    kind = dict(items.dtypes)[id_col]
    return items.select(F.col(id_col).alias("item"), F.col(text_col).alias("t")).mapInArrow(run, f"item {kind}, n_words long, n long, partition int, bands array<long>, grams array<binary>, hashes array<long>")


def filter_of(hashes: DataFrame, column: str) -> np.ndarray:
    """A bit array with the slot of every value set. Bits are gathered in words of 64, so the driver gets a bounded number of rows."""
    bits = filter_bits(hashes.agg(F.coalesce(F.sum(F.size(column)), F.lit(0))).first()[0])
    slot = F.shiftrightunsigned(F.col("x"), 64 - bits)
    each = hashes.select(F.explode(column).alias("x")).select(F.shiftrightunsigned(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(shiftrightunsigned(x, {64 - bits}), 64) as int))").alias("bit"))
    found = each.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def window_bands(known: np.ndarray, search: Search) -> list[np.ndarray]:
    """Keys of a text's windows, for each size partition, that the filter lets through.

    known: the text's shingles that some item may have, in order; the windows are over these, so that no signature is taken of
    what no item has. An item's shingles that stand together do so here too, and its Jaccard index with a window is at least
    what it would be among all of the text's shingles.
    """
    found, numbers, distinct = [], np.arange(HASHES), len(np.unique(known))
    for p in search.partitions:
        size = 1 << p
        if distinct < search.containment * (size // 2 + 1) - 1e-9:  # fewer than any item of this size shares with a text that holds it
            continue
        starts = np.arange(0, max(1, len(known) - size), size)
        step = max(1, CHUNK // (2 * size))
        for k in range(0, len(starts), step):
            at = np.minimum(starts[k : k + step, None] + np.arange(2 * size), len(known) - 1)
            values = known[at]
            shifted = values >> np.uint64(29)
            mins = np.stack([((values * m) ^ shifted).min(1) for m in MULTIPLIERS])
            keys = band(mins, numbers[:, None], p).ravel()
            found.append(keys[lookup(search.bands, keys)])
    return found


def candidate_bands(words: np.ndarray, known: np.ndarray, search: Search) -> np.ndarray:
    """Keys of the text's windows that the filter lets through."""
    found = []
    for width in search.short:
        keys = band(sh.shingle_hashes(words, width), np.zeros(1, np.uint64), -width + 64)
        found.append(keys[lookup(search.bands, keys)])
    if len(known):
        found += window_bands(known, search)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def document_rows(docs: DataFrame, search: Search, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc, bands, grams) of the texts that a band brings near some item; grams are the text's shingles that the filter lets through."""
    sent = docs.sparkSession.sparkContext.broadcast(search)  # bounded: two filters of at most 2 ** FILTER_MOST bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = sent.value
        for b in batches:
            out = []
            for k, text in enumerate(b.column(1).to_pylist()):
                raw = sh.encoded(text)
                data = np.frombuffer(raw, np.uint8)
                starts, ends = sh.bounds(data)
                words = sh.word_hashes(data, starts, ends)
                five = sh.shingle_hashes(words, WIDTH)
                known = lookup(search.shingles, five)
                keys = candidate_bands(words, five[known], search)
                if not len(keys):
                    continue
                grams = set()
                for width in (*search.short, WIDTH):
                    has = known if width == WIDTH else lookup(search.shingles, sh.shingle_hashes(words, width))
                    for i in np.flatnonzero(has).tolist():
                        grams.add(b" ".join(raw[x:y] for x, y in zip(starts[i : i + width].tolist(), ends[i : i + width].tolist())))
                if grams:
                    out.append((k, keys.view(np.int64).tolist(), list(grams)))
            if out:
                at, keys, grams = zip(*out)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(keys, pa.list_(pa.int64())), pa.array(grams, pa.list_(pa.binary()))], ["doc", "bands", "grams"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("t")).mapInArrow(run, f"doc {kind}, bands array<long>, grams array<binary>")


def contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """Rows (doc, item, n_shingles, n_shared, containment): items whose share of shingles that a text has too is at least `containment`.

    Words are cut at ASCII white space, A-Z lower-cased; shingles are five words, and an item of fewer words is one shingle of
    them all. Bands of MinHash signatures over windows, by size partition, retrieve the pairs; the share is then counted over
    the whole text from the shingles themselves. Items without words are in no text; null and empty texts hold no item.
    Rows of the same id count as one text for the pairs they yield: a pair comes once, with the largest share. Empty tables give no rows.
    """
    known = common.materialise(item_rows(items, item_id, item_text), "items")
    used = [r["partition"] for r in known.select("partition").distinct().collect()]  # at most 64 + WIDTH different values
    search = Search(filter_of(known, "bands"), filter_of(known, "hashes"), tuple(sorted(p for p in used if p >= 0)), tuple(sorted(-p for p in used if p < 0)), containment)
    near = common.materialise(document_rows(docs, search, doc_id, doc_text).withColumn("row", F.xxhash64("doc", F.array_sort("grams"))), "near")
    keys = known.select("item", F.explode("bands").alias("key"))
    pairs = near.select("doc", "row", F.explode("bands").alias("band")).join(keys, F.col("band") == F.col("key")).select("doc", "row", "item").distinct()
    full = pairs.join(known.select(F.col("item").alias("i"), "n", F.col("grams").alias("item_grams")), F.expr("item <=> i")).drop("i")
    met = full.join(near.select(F.col("row").alias("r"), F.col("doc").alias("d"), "grams").dropDuplicates(["r", "d"]), F.expr("row = r and doc <=> d"))
    shared = F.size(F.array_intersect("item_grams", "grams")).cast("long")
    counted = met.select("doc", "item", F.col("n").alias("n_shingles"), shared.alias("n_shared"))
    share = F.col("n_shared") / F.col("n_shingles")
    return counted.groupBy("doc", "item", "n_shingles").agg(F.max("n_shared").alias("n_shared")).where(share >= containment).withColumn("containment", share)


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows whose text holds an item."""
    hit = common.materialise(contained(docs, items, doc_id, doc_text, item_id, item_text).select("doc").distinct(), "hit")
    return common.without(docs, hit, {"doc": F.col(f"`{doc_id}`")})


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    found = contained(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_shingles", "n_shared", F.round("containment", 9).alias("containment"))


OP1_SQL = rf"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[^\x20\x09-\x0D]+') FROM benchmark),
widths AS (SELECT DISTINCT least(5, len(ws)) AS width FROM words WHERE kind = 'b' AND len(ws) > 0),
grams AS (
  SELECT DISTINCT kind, id, width, array_to_string(ws[i:i + width - 1], ' ') AS gram
  FROM (SELECT kind, id, ws, width, unnest(range(1, len(ws) - width + 2)) AS i FROM words, widths
        WHERE len(ws) >= width AND (kind = 'd' OR width = least(5, len(ws))))),
items AS (SELECT id, width, gram, count(*) OVER (PARTITION BY id) AS n FROM grams WHERE kind = 'b'),
shared AS (
  SELECT g.id AS doc_id, i.id AS item_id, any_value(i.n) AS n_shingles, count(*) AS n_shared
  FROM items i JOIN grams g ON g.kind = 'd' AND g.width = i.width AND g.gram = i.gram GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_shared, round(n_shared / n_shingles, 9) AS containment
FROM shared WHERE n_shared / n_shingles >= 0.8
"""
