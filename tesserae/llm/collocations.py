"""Phrase collocations, counted by slot of a minimal perfect hash over candidate phrases."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm import common
from tesserae.llm.shingles import mix, powers

#: Bytes of text that a task hashes at a time and combines, and pairs that it combines further before it hands them on.
WINDOW, CHUNK, COMBINE = 1 << 17, 1 << 20, 1 << 19
#: Bits of a filter of what is frequent, as a power of two: 16 MB. A full filter only lets more candidates through.
FILTER_BITS = 27
#: Candidates of one block of the hash, about.
BLOCK = 1 << 15
#: So many candidates (17 bytes each) are sent to every task; beyond that their occurrences are sent to the tasks that hold their blocks.
SENT = 1 << 21
#: Occurrences that one task takes of a block then, about.
TAKEN = 1 << 21
#: Arrays of a block that one step of the sum takes.
FAN_IN = 16

_RNG = np.random.default_rng(20250313)
#: Two random values for each byte, after A-Z are lower-cased.
_BYTES = [_RNG.integers(0, 1 << 64, 256, np.uint64) for _ in range(2)]
for _table in _BYTES:
    _table[65:91] = _table[97:123]
#: Odd multipliers of the places in a phrase and of its language, for both hashes.
_PLACES = [_RNG.integers(0, 1 << 63, 4, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]

#: 0 in a word, 1 between words, 2 between pieces.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = 2
_BREAK = re.compile(rb"[.,;:!?\x0A-\x0D]")


class Words:
    """The words of a stretch of text: starts and ends, two hashes each, piece and language; and the runs of them within pieces."""

    def __init__(self, raw: bytes, edges: np.ndarray, langs: np.ndarray):
        """raw: texts one after the other, each with a separator of pieces at its end; edges: their ends; langs: a hash of each one's language."""
        self.raw = raw
        data = np.frombuffer(raw, np.uint8)
        kind = _CLASS[data]
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = kind == 0
        step = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.found: dict[int, np.ndarray] = {}
        breaks = np.cumsum(kind == 2, dtype=np.int32)
        self.piece, self.pieces = breaks[self.starts], int(breaks[-1]) + 1 if len(breaks) else 1
        self.doc = np.searchsorted(edges, self.starts, "right")
        self.lang = langs[self.doc]
        self.hashes = []
        for table in _BYTES:
            prefix = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(table[data] * powers("base", len(data)), out=prefix[1:])
            self.hashes.append(mix((prefix[self.ends] - prefix[self.starts]) * powers("inverse", len(data) + 1)[self.starts]))

    def runs(self, k: int) -> np.ndarray:
        """First words of the runs of k words within a piece."""
        n = len(self.starts) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.piece[:n] == self.piece[k - 1 :])

    def keys(self, at: np.ndarray, k: int, which: int) -> np.ndarray:
        """A 64-bit hash of the runs of k words from the words `at` on, in their language."""
        total = self.lang[at] * _PLACES[which][3]
        for j in range(k):
            total += self.hashes[which][at + j] * _PLACES[which][j]
        return mix(total)

    def phrase(self, at: int, k: int) -> str:
        words = [self.raw[self.starts[i] : self.ends[i]] for i in range(at, at + k)]
        return b" ".join(words).lower().decode("utf-8", "replace")


def lang_hash(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def stretches(batches: Iterator[pa.RecordBatch], chunk: int, window: int) -> Iterator[tuple[Words, list[str]]]:
    """The words of batches (text: binary, ends with a separator; lang) in stretches of about `chunk` bytes, with the language of each doc; cut between pieces."""
    for batch in batches:
        held, size, parts, total = [], 0, [], 0
        for k in range(0, batch.num_rows, 128):
            some = batch.slice(k, 128)
            for lang, text in zip(some.column("lang").to_pylist(), some.column("text").to_pylist()):
                at = 0
                while at < len(text):
                    stop = min(at + window - size, len(text))
                    stop = _BREAK.search(text, stop - 1).end()
                    held.append((text[at:stop], lang))
                    size += stop - at
                    at = stop
                    if size >= window:
                        parts.append(gathered(held))
                        held, size, total = [], 0, total + size
                        if total >= chunk:
                            yield joined(parts)
                            parts, total = [], 0
        if held:
            parts.append(gathered(held))
        if parts:
            yield joined(parts)


def gathered(held: list[tuple[bytes, str]]) -> tuple[Words, list[str]]:
    of = {x: lang_hash(x) for x in {x for _, x in held}}
    edges = np.cumsum([len(t) for t, _ in held])
    return Words(b"".join(t for t, _ in held), edges, np.array([of[x] for _, x in held], np.uint64)), [x for _, x in held]


def joined(parts: list[tuple[Words, list[str]]]) -> tuple[Words, list[str]]:
    """Words of one stretch after the other as one."""
    if len(parts) == 1:
        return parts[0]
    out = Words.__new__(Words)
    out.found = {}
    each = [w for w, _ in parts]
    before = np.cumsum([0] + [len(w.raw) for w in each])
    docs = np.cumsum([0] + [len(langs) for _, langs in parts])
    pieces = np.cumsum([0] + [w.pieces for w in each])
    out.raw, out.pieces = b"".join(w.raw for w in each), int(pieces[-1])
    out.starts, out.ends = (np.concatenate([getattr(w, c) + b for w, b in zip(each, before)]) for c in ("starts", "ends"))
    out.doc = np.concatenate([w.doc + d for w, d in zip(each, docs)])
    out.piece = np.concatenate([w.piece + p for w, p in zip(each, pieces)])
    out.lang = np.concatenate([w.lang for w in each])
    out.hashes = [np.concatenate([w.hashes[k] for w in each]) for k in (0, 1)]
    return out, [x for _, langs in parts for x in langs]


def combined(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of one row of each different key, and of how many rows it stands for; keys are columns, the first of them tells nearly all apart."""
    order = np.argsort(keys[0])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


class Filter:
    """Bits of hashed keys. What was put in is always found, so nothing frequent is lost; a strange key may be found too."""

    def __init__(self, keys: DataFrame, column: str, bits: int):
        bit = F.shiftrightunsigned(F.col(column), 64 - bits)
        set_bits = keys.select(F.shiftright(bit, 6).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int))").alias("bit"))
        found = set_bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most 2 ** (bits - 6) rows
        table = np.zeros(1 << (bits - 6), np.uint64)
        table[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        self.shift, self.sent = np.uint64(64 - bits), keys.sparkSession.sparkContext.broadcast(table)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        bit = keys >> self.shift
        return (self.sent.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, phrase, f: how often each word occurs in each language."""

    def run(batches):
        for w, langs in stretches(batches, CHUNK, WINDOW):
            every = np.arange(len(w.starts))
            rows, n = combined(w.keys(every, 1, 0), w.keys(every, 1, 1))
            names = pa.array([langs[d] for d in w.doc[rows]], pa.string())
            words = pa.array([w.phrase(i, 1) for i in rows.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([names, words, pa.array(n)], ["lang", "phrase", "f"])

    return texts.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def of_phrases(phrases: list[str], langs: list[str]) -> tuple[Words, np.ndarray, np.ndarray]:
    """Phrases as words again: with the first word and the number of words of each."""
    texts = [p.encode() + b"\n" for p in phrases]
    w = Words(b"".join(texts), np.cumsum([len(t) for t in texts]), np.array([lang_hash(x) for x in langs], np.uint64))
    size = np.bincount(w.doc, minlength=len(phrases))
    return w, np.cumsum(size) - size, size


def with_keys(phrases: DataFrame) -> DataFrame:
    """lang, phrase, words, a, b: phrases (lang, phrase) with their two hashes, which are worked out anew rather than shuffled."""

    def run(batches):
        for batch in batches:
            w, first, size = of_phrases(batch.column("phrase").to_pylist(), batch.column("lang").to_pylist())
            keys = np.zeros((2, len(size)), np.uint64)
            for k in (1, 2, 3):
                rows = np.flatnonzero(size == k)
                for which in (0, 1):
                    keys[which, rows] = w.keys(first[rows], k, which)
            arrays = [batch.column("lang"), batch.column("phrase"), pa.array(size.astype(np.int32)), *[pa.array(x.view(np.int64)) for x in keys]]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "phrase", "words", "a", "b"])

    return phrases.select("lang", "phrase").mapInArrow(run, "lang string, phrase string, words int, a long, b long")


class Safe:
    """Runs that may be frequent: words, pairs of such words, and triples of such pairs, as far as their filters are known."""

    def __init__(self, words: Filter, pairs: Filter | None = None, triples: Filter | None = None):
        self.words, self.pairs, self.triples = words, pairs, triples

    def runs(self, w: Words, k: int) -> np.ndarray:
        """First words of the runs of k words, all parts of which pass their filters, and the runs themselves if theirs is known."""
        if k in w.found:
            return w.found[k]
        at = w.runs(k)
        own = (self.words, self.pairs, self.triples)[k - 1]
        if k > 1:
            part = np.zeros(len(w.starts) + 1, bool)
            part[self.runs(w, k - 1)] = True
            at = at[part[at] & part[at + 1]]
        w.found[k] = at if own is None else at[own(w.keys(at, k, 0))]
        return w.found[k]


def screened(texts: DataFrame, safe: Safe, k: int, least: int) -> DataFrame:
    """key: the hashes whose safe runs of k words occur `least` times or more together, so those of all frequent ones are among them."""

    def run(batches):
        def settle():
            keys = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(np.diff(np.append(first, len(keys))))], ["key", "n"])

        held = []
        for w, _ in stretches(batches, CHUNK, WINDOW):
            held.append(w.keys(safe.runs(w, k), k, 0))
            if sum(map(len, held)) >= COMBINE:
                yield settle()
                held = []
        if held:
            yield settle()

    return texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key")


def candidates(texts: DataFrame, safe: Safe) -> DataFrame:
    """lang, phrase: each different safe phrase of two or three words once."""

    def run(batches):
        for w, langs in stretches(batches, CHUNK, WINDOW):
            for k in (2, 3):
                at = safe.runs(w, k)
                rows, _ = combined(w.keys(at, k, 0), w.keys(at, k, 1))
                names = pa.array([langs[d] for d in w.doc[at[rows]]], pa.string())
                text = pa.array([w.phrase(i, k) for i in at[rows].tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([names, text], ["lang", "phrase"])

    return texts.mapInArrow(run, "lang string, phrase string").distinct()


class PerfectHash:
    """A minimal perfect hash of n different pairs of 64-bit keys, with the keys at their slots.

    Levels of bits: a key alone at its place of a level has its slot there, the others go on to the next level. A slot is the number of set
    bits before the key's. A key that was not put in is told by the stored keys.
    """

    def __init__(self, levels: list[np.ndarray], a: np.ndarray, b: np.ndarray):
        self.levels, self.a, self.b = levels, a, b
        self.ranks, before = [], 0
        for bits in levels:
            self.ranks.append(before + np.cumsum(bits, dtype=np.int64) - bits)
            before += int(bits.sum())

    @staticmethod
    def place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(a ^ mix(b + np.uint64((2 * level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        levels, left = [], np.arange(len(a))
        while len(left):
            at = cls.place(a[left], b[left], len(levels), 2 * len(left))
            alone = np.bincount(at, minlength=2 * len(left)) == 1
            levels.append(alone)
            left = left[~alone[at]]
        made = cls(levels, a, b)
        slots = made.slots(a, b)
        made.a, made.b = np.empty_like(a), np.empty_like(b)
        made.a[slots], made.b[slots] = a, b
        return made

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key; that of a strange key is any, or -1."""
        found, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            at = self.place(a[left], b[left], level, len(bits))
            hit = bits[at]
            found[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return found

    def verified(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key that was put in, -1 for others."""
        found = self.slots(a, b)
        if not len(self.a):
            return found
        return np.where((found >= 0) & (self.a[found] == a) & (self.b[found] == b), found, -1)

    def packed(self) -> dict:
        return {"sizes": [len(x) for x in self.levels], "bits": np.packbits(np.concatenate(self.levels)).tobytes(), "a": self.a.tobytes(), "b": self.b.tobytes()}

    @classmethod
    def unpacked(cls, sizes, bits: bytes, a: bytes, b: bytes) -> PerfectHash:
        flat = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(sum(sizes))).astype(bool)
        return cls(np.split(flat, np.cumsum(sizes)[:-1]), np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64))


HASHED = "block int, sizes array<int>, bits binary, a binary, b binary, langs array<string>, phrases array<string>, words array<int>"


def hashed(found: DataFrame, blocks: int) -> DataFrame:
    """A perfect hash for each block of the candidates, with the phrase of each slot."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        made = PerfectHash.build(group.a.to_numpy().view(np.uint64), group.b.to_numpy().view(np.uint64))
        order = np.empty(len(group), int)
        order[made.slots(group.a.to_numpy().view(np.uint64), group.b.to_numpy().view(np.uint64))] = np.arange(len(group))
        rest = {c: group[n].to_numpy()[order].tolist() for c, n in (("langs", "lang"), ("phrases", "phrase"), ("words", "words"))}
        return pd.DataFrame([{"block": int(group.block.iloc[0]), **made.packed(), **rest}])

    return found.withColumn("block", F.pmod(F.col("a"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(build, HASHED)


def block_of(a: np.ndarray, blocks: int) -> np.ndarray:
    return (a.view(np.int64) % blocks).astype(np.int64)


class Counters:
    """Counts by slot of some blocks of the hash."""

    def __init__(self, hashes: dict[int, PerfectHash]):
        self.hashes, self.counts = hashes, {}

    def add(self, block: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
        order = np.argsort(block, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            made = self.hashes.get(int(block[rows[0]])) if len(rows) else None
            if made is not None:
                slots = made.verified(a[rows], b[rows])
                known = slots >= 0
                # the weights of one call add up to far less than 2 ** 53, so they are exact
                more = np.bincount(slots[known], weights=n[rows][known], minlength=len(made.a)).astype(np.int64)
                k = int(block[rows[0]])
                self.counts[k] = self.counts[k] + more if k in self.counts else more

    def batch(self, node: int) -> pa.RecordBatch:
        """One row a block that something was counted in."""
        some = list(self.counts)
        packed = [narrow(self.counts[k]) for k in some]
        sizes = pa.array([len(self.counts[k]) for k in some], pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([node] * len(some), pa.int64()), sizes, pa.array(packed, pa.binary())], ["block", "node", "size", "counts"])


COUNTED = "block int, node long, size int, counts binary"


def narrow(counts: np.ndarray) -> bytes:
    """Counts as bytes of the narrowest unsigned integers that hold them."""
    top = int(counts.max(initial=0))
    return counts.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if top < 1 << 8 * int(t[2]))).tobytes()


def wide(counts: bytes, size: int) -> np.ndarray:
    return np.frombuffer(counts, f"<u{len(counts) // size}").astype(np.int64)


def occurrences(w: Words, safe: Safe, blocks: int) -> tuple[np.ndarray, ...]:
    """block, a, b, n of the different safe phrases of a stretch."""
    out = []
    for k in (1, 2, 3):
        at = safe.runs(w, k)
        a, b = w.keys(at, k, 0), w.keys(at, k, 1)
        rows, n = combined(a, b)
        out.append((block_of(a[rows], blocks), a[rows], b[rows], n))
    return tuple(np.concatenate(x) for x in zip(*out))


def unpacked(rows: list[dict]) -> dict[int, PerfectHash]:
    return {r["block"]: PerfectHash.unpacked(r["sizes"], r["bits"], r["a"], r["b"]) for r in rows}


KEPT = ["block", "sizes", "bits", "a", "b"]


def counted_here(texts: DataFrame, safe: Safe, hashes, blocks: int) -> DataFrame:
    """COUNTED of each task over its texts; hashes is a broadcast of all of them."""

    def run(batches):
        from pyspark import TaskContext

        counters = Counters(unpacked(hashes.value))
        for w, _ in stretches(batches, CHUNK, WINDOW):
            counters.add(*occurrences(w, safe, blocks))
        yield counters.batch(TaskContext.get().partitionId())

    return texts.mapInArrow(run, COUNTED)


def counted_there(texts: DataFrame, safe: Safe, table: DataFrame, blocks: int, salts: int) -> DataFrame:
    """COUNTED of each block and salt: occurrences, combined within stretches, are sent to tasks that hold their block's hash.

    A stretch's occurrences have one salt, so a frequent phrase is spread like any other, and a task takes about TAKEN of them.
    """

    def send(batches):
        for w, _ in stretches(batches, CHUNK, WINDOW):
            block, a, b, n = occurrences(w, safe, blocks)
            salt = int(mix(w.hashes[0].sum(keepdims=True))[0] % np.uint64(salts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.astype(np.int32)), pa.array(np.full(len(a), salt, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(n)],
                ["block", "salt", "a", "b", "n"],
            )

    def count(occurred: pa.Table, hashes: pa.Table) -> pa.Table:
        counters = Counters(unpacked(hashes.select(KEPT).to_pylist()))
        if occurred.num_rows:
            block, a, b, n = (occurred.column(c).to_numpy() for c in ("block", "a", "b", "n"))
            counters.add(block.astype(np.int64), a.view(np.uint64), b.view(np.uint64), n)
        return pa.Table.from_batches([counters.batch(hashes.column("salt")[0].as_py() if hashes.num_rows else 0)])

    sent = texts.mapInArrow(send, "block int, salt int, a long, b long, n long")
    held = table.select(*KEPT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return sent.groupBy("block", "salt").cogroup(held.groupBy("block", "salt")).applyInArrow(count, COUNTED)


def tree_sum(found: DataFrame) -> DataFrame:
    """block, counts (array<long> by slot): the arrays of each block added up, FAN_IN at a time."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(wide(c, int(s)) for c, s in zip(group.counts, group["size"]))
        return pd.DataFrame({"block": group.block[:1], "node": group.up[:1], "size": [len(total)], "counts": [narrow(total)]})

    def finish(frames):
        for f in frames:
            yield pd.DataFrame({"block": f.block, "counts": [wide(c, int(s)).tolist() for c, s in zip(f.counts, f["size"])]})

    found = common.materialise(found, "slot-counts")
    last = found.agg(F.max("node")).first()[0] or 0
    while True:
        found = found.withColumn("up", F.floor(F.col("node") / FAN_IN)).groupBy("block", "up").applyInPandas(add, COUNTED)
        last //= FAN_IN
        if not last:
            return found.mapInPandas(finish, "block int, counts array<long>")


CUT = "lang string, phrase string, words int, f long, k int, l long, r long"


def cuts_here(frequent: DataFrame, counts: DataFrame, hashes, blocks: int) -> DataFrame:
    """CUT of each candidate and place to cut it; the counts of both parts are read by their slots from broadcast arrays."""
    sent = frequent.sparkSession.sparkContext.broadcast({r["block"]: np.array(r["counts"]) for r in counts.toArrow().to_pylist()})  # at most SENT counts

    def read(w: Words, at: np.ndarray, k: int, made: dict[int, PerfectHash]) -> np.ndarray:
        a, b = w.keys(at, k, 0), w.keys(at, k, 1)
        block, out = block_of(a, blocks), np.zeros(len(a), np.int64)
        for x in np.unique(block):
            rows = np.flatnonzero(block == x)
            out[rows] = sent.value[int(x)][made[int(x)].verified(a[rows], b[rows])]
        return out

    def run(batches):
        made = unpacked(hashes.value)
        for batch in batches:
            phrases, langs = batch.column("phrase").to_pylist(), batch.column("lang").to_pylist()
            w, first, size = of_phrases(phrases, langs)
            for words, k in ((2, 1), (3, 1), (3, 2)):
                rows = np.flatnonzero(size == words)
                parts = [batch.column(c).take(pa.array(rows)) for c in ("lang", "phrase", "words", "f")]
                left, right = read(w, first[rows], k, made), read(w, first[rows] + k, words - k, made)
                yield pa.RecordBatch.from_arrays([*parts, pa.array(np.full(len(rows), k, np.int32)), pa.array(left), pa.array(right)], ["lang", "phrase", "words", "f", "k", "l", "r"])

    return frequent.where("words > 1").select("lang", "phrase", "words", "f").mapInArrow(run, CUT)


def cuts_there(frequent: DataFrame) -> DataFrame:
    """CUT, with the parts' counts from joins by language and phrase."""
    parts = F.split("phrase", " ")
    cut = frequent.where("words > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.withColumn("left", F.array_join(F.slice(parts, 1, F.col("k")), " ")).withColumn("right", F.array_join(F.slice(parts, F.col("k") + 1, F.col("words") - F.col("k")), " "))
    for part, name in (("left", "l"), ("right", "r")):
        cut = cut.join(frequent.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
    return cut.select("lang", "phrase", "words", "f", "k", "l", "r")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, absorbed: int = 50, top: int | None = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the phrases of two and three words that hold together best, in each language.

    Words are runs without white space within pieces (see the contract of op13), A-Z lower-cased; a null or empty text has none; a null
    language is `und`. A phrase's f counts all its occurrences; candidates have `least` or more. Of a candidate's cuts the one of the lowest score
    floor(10^6 a^2 / (l r)) counts, the earliest of equals. A candidate within a longer one that makes up `absorbed` per cent of its
    occurrences goes. Ranks are by falling score, falling a, phrase; `top` of each language stay (None: all). Repeated rows count as often
    as they occur, texts of any length are worked on in stretches, an empty table gives no rows, other columns are not looked at.

    Words are counted first, then hashes of pairs of frequent words, then of triples of such pairs (Apriori): a sum below `least` proves a
    run rare. What passes is a superset of what is frequent, the candidates. They and the frequent words get a minimal perfect hash; tasks count
    by slot, keys stored at the slot turn strangers away, and the arrays are added up a tree. Both hashes of a phrase have 64 bits.
    """
    text = F.concat(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.lit("\n")).cast("binary")
    texts = docs.select(text.alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"))
    words = common.materialise(word_counts(texts), "words")
    totals = common.materialise(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    often = common.materialise(with_keys(words.where(F.col("f") >= least)), "often")
    safe = Safe(Filter(often, "a", FILTER_BITS))
    safe.pairs = Filter(screened(texts, safe, 2, least), "key", FILTER_BITS)
    safe.triples = Filter(screened(texts, safe, 3, least), "key", FILTER_BITS)
    every = common.materialise(with_keys(candidates(texts, safe)).unionByName(often), "candidates")
    size, running = every.count(), totals.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-size // BLOCK))
    table = common.materialise(hashed(every, blocks), "perfect-hash")
    here = size <= SENT
    if here:
        hashes = docs.sparkSession.sparkContext.broadcast(table.select(*KEPT).toArrow().to_pylist())
        counts = counted_here(texts, safe, hashes, blocks)
    else:
        counts = counted_there(texts, safe, table, blocks, max(1, -(-3 * running // (blocks * TAKEN))))
    counts = common.materialise(tree_sum(counts), "counts")
    slot = F.explode(F.arrays_zip("langs", "phrases", "words", "counts")).alias("s")
    found = table.join(counts, "block").select(slot).select(F.col("s.langs").alias("lang"), F.col("s.phrases").alias("phrase"), F.col("s.words").alias("words"), F.col("s.counts").alias("f"))
    frequent = common.materialise(found.where(F.col("f") >= least), "frequent")
    cut = common.materialise(cuts_here(frequent, counts, hashes, blocks) if here else cuts_there(frequent), "cuts")
    for sent in [safe.words.sent, safe.pairs.sent, safe.triples.sent, *([hashes] if here else [])]:
        sent.destroy()
    score = F.expr("(1000000 * cast(f as decimal(38,0)) * cast(f as decimal(38,0))) div (cast(l as decimal(38,0)) * cast(r as decimal(38,0)))")
    best = cut.groupBy("lang", "phrase", "words").agg(F.max("f").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    longer = frequent.where("words = 3").withColumn("w", F.split("phrase", " "))
    inner = F.explode(F.array(*[F.array_join(F.slice("w", i, 2), " ") for i in (1, 2)]))
    longer = longer.select("lang", inner.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    left = best.join(longer, ["lang", "phrase"], "left").where(~(F.coalesce(100 * F.col("most") >= absorbed * F.col("a"), F.lit(False))))
    order = Window.partitionBy("lang").orderBy(F.col("best.score").desc(), F.col("a").desc(), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals) if totals.count() <= 100_000 else totals, "lang").select("lang", "rank", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of all documents."""
    return collocations(common.table(spark, sf_dir, "documents").select("text", "lang"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS pos
  FROM (SELECT row_number() OVER () AS doc_id, lang,
               string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]') AS p FROM documents)),
listed AS (SELECT lang, doc_id, pos, list_filter(string_split_regex(piece, '[ 	]+'), lambda x: x <> '') AS w FROM pieces),
one AS (SELECT lang, doc_id, pos, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM listed),
run AS (
  SELECT lang, a, lead(a, 1) OVER p AS b, lead(a, 2) OVER p AS c FROM one WINDOW p AS (PARTITION BY lang, doc_id, pos ORDER BY i)),
n AS (SELECT lang, count(*) AS n FROM run GROUP BY lang),
f AS (
  SELECT lang, a AS phrase, 1 AS words, count(*) AS f FROM run GROUP BY ALL
  UNION ALL SELECT lang, a || ' ' || b, 2, count(*) FROM run WHERE b IS NOT NULL GROUP BY lang, a, b
  UNION ALL SELECT lang, a || ' ' || b || ' ' || c, 3, count(*) FROM run WHERE c IS NOT NULL GROUP BY lang, a, b, c),
often AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE f >= 10),
cut AS (
  SELECT lang, phrase, words, f, 1 AS k, w[1] AS lp, array_to_string(w[2:], ' ') AS rp FROM often WHERE words > 1
  UNION ALL SELECT lang, phrase, words, f, 2, w[1] || ' ' || w[2], w[3] FROM often WHERE words = 3),
scored AS (
  SELECT c.lang, c.phrase, c.words, c.f AS a, c.k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score
  FROM cut c JOIN often x ON x.lang = c.lang AND x.phrase = c.lp JOIN often y ON y.lang = c.lang AND y.phrase = c.rp),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(f) AS most FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, f FROM often WHERE words = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], f FROM often WHERE words = 3)
  GROUP BY ALL),
kept AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE coalesce(100 * g.most < 50 * b.a, true))
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, n.n, k.score::BIGINT AS score FROM kept k JOIN n ON n.lang = k.lang WHERE k.rank <= 2000
"""
