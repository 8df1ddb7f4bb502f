"""Packing documents into token sequences along a space-filling curve."""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm import common
from tesserae.llm.shingles import mix

#: Buckets of a hashed document vector, dimensions it is projected to, and bits of each on the curve (60 in all).
BUCKETS, DIMENSIONS, BITS = 1024, 4, 15
#: Different runs of text whose ids a Python worker keeps, each of at most CACHED_BYTES; as many older ones wait to be asked for again.
CACHED, CACHED_BYTES = 240_000, 48
#: A text is cut at white space into runs in steps of so many bytes.
STEP = 1 << 20

_WHITE = re.compile(rb"[\x20\x09-\x0D]")
#: ASCII letters, and ASCII marks and digits: a text is cut between one of the first and one of the second, too.
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[0x21:0x7F] = ~_LETTER[0x21:0x7F]


#: The characters that stand for bytes in a byte-level vocabulary: printable ones of Latin-1 for themselves, the others from 256 on in order.
_SHOWN = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE))}
_MARKS = bytes(np.flatnonzero(_MARK).astype(np.uint8))


def runs(text: bytes) -> list[bytes]:
    """Runs without white space, cut between a letter and an ASCII mark too. Letters are ASCII's, and those from U+00C0 to U+023F: two bytes, the first from C3 to C8 (C3 97 and C3 B7 are signs)."""
    data = np.frombuffer(text, np.uint8)
    letter = _LETTER[data[:-1]]
    far = np.flatnonzero(data[:-1] >= 0xC3)
    far = far[(data[far] <= 0xC8) & ~((data[far] == 0xC3) & ((data[far + 1] == 0x97) | (data[far + 1] == 0xB7)))] + 1
    letter[far[far < len(letter)]] = True
    return np.insert(data, np.flatnonzero(letter & _MARK[data[1:]]) + 1, 32).tobytes().split()


class Ids(dict):
    """The ids of runs of text, as bytes, made when first asked for.

    The tokenizer splits at white space, and where letters end, before it merges, so a text's ids are those of its runs, one after the
    other. In a text that may hold a special token only white space is a place to cut. Runs of Latin letters go to the tokenizer's
    model, lower-cased as it would do it. A full cache becomes the older generation; what is
    found there moves back. A tokenizer that works otherwise (PROBES tell) gets whole texts.
    """

    PROBES = ("ab", "ab cd", "Ab. cd's\tEf", "x1,y", "z\n\nq!?")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = self.dtype.char
        self.older: dict[bytes, bytes] = {}
        encode = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.by_runs = all(encode(p) == [i for r in runs(p.lower().encode()) for i in encode(r.decode())] for p in self.PROBES)
        self.direct = self.by_runs and all([t.id for t in self.tokenizer.model.tokenize(w)] == encode(w) for w in ("ab", "word", "tokenizers"))
        self.direct = self.direct and [t.id for t in self.tokenizer.model.tokenize("é".encode().decode("latin-1").translate(_SHOWN))] == encode("é")

    def encode(self, run: bytes) -> bytes:
        """Ids of a run. Latin letters go to the model; ASCII marks before them are a run of their own unless they may begin 's or the like."""
        if self.direct and run.isalpha() and run.islower():
            return array(self.code, [t.id for t in self.tokenizer.model.tokenize(run.decode())]).tobytes()
        if self.direct:
            letters = run.lstrip(_MARKS)
            text = letters.decode("utf-8", "replace").lower()
            if text.isalpha() and max(text) < "\u0250":
                if len(letters) == len(run):
                    seen = text if text.isascii() else text.encode().decode("latin-1").translate(_SHOWN)
                    return array(self.code, [t.id for t in self.tokenizer.model.tokenize(seen)]).tobytes()
                marks = run[: len(run) - len(letters)]
                if not marks.endswith(b"'"):
                    return self[marks] + self[letters]
        return self.whole(run)

    def whole(self, text: bytes) -> bytes:
        return array(self.code, self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def __missing__(self, run: bytes) -> bytes:
        """A run that is not kept, because it is long, or not there yet."""
        made = self.older.get(run)
        if made is None:
            made = self.encode(run) if b"<|" not in run else self.whole(run)
        if len(run) <= CACHED_BYTES:
            self[run] = made
        return made

    def prepare(self, found: set[bytes]) -> None:
        """Makes the ids of the runs that are not there."""
        if len(self) >= CACHED:
            self.older = dict(self)
            self.clear()
        new = found - self.keys()
        again = new & self.older.keys()
        for run in again:
            self[run] = self.older[run]
        tokenize, code = self.tokenizer.model.tokenize, self.code
        for run in new - again:
            if len(run) > CACHED_BYTES or b"<|" in run:
                continue
            if run.isalpha() and run.islower():  # most of them
                self[run] = array(code, [t.id for t in tokenize(run.decode())]).tobytes()
            else:
                self[run] = self.encode(run)

    def cut(self, text: bytes) -> list[bytes]:
        if b"<|" in text:
            return text.split()
        if text and np.frombuffer(text, np.uint8).max() < 0xCC:  # nothing that could combine with a letter before it
            text = text.lower()
        return runs(text)

    def of(self, text: bytes) -> bytes:
        """The ids of a text, which is cut in steps so that a long one is never all runs at once."""
        if not self.by_runs:
            return self.whole(text)
        out, start = [], 0
        special = b"<|" in text
        while start < len(text):
            end = _WHITE.search(text, start + STEP)
            end = end.start() if end else len(text)
            part = text[start:end].split() if special else self.cut(text[start:end])
            if self.direct:
                self.prepare(set(part))
            out.append(b"".join(map(self.__getitem__, part)))
            start = end
        return b"".join(out)

    def of_all(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text. Those of the short ones are looked up together."""
        if not self.direct:
            return [self.of(t) for t in texts]
        parts = [self.cut(t) if len(t) <= STEP else None for t in texts]
        self.prepare(set().union(*[p for p in parts if p]))
        return [self.of(t) if p is None else b"".join(map(self.__getitem__, p)) for t, p in zip(texts, parts)]


@functools.cache
def ids_of(path: str) -> Ids:
    """One for all tasks of a Python worker."""
    return Ids(path)


def projection() -> np.ndarray:
    return np.random.default_rng(11).normal(size=(BUCKETS, DIMENSIONS))


def bucket(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.uint64) + np.uint64(1)) % np.uint64(BUCKETS)).astype(np.int64)


#: The buckets of ids of two bytes.
SHORT = bucket(np.arange(1 << 16))


def coordinates(ids: np.ndarray, onto: np.ndarray) -> np.ndarray:
    """Hashed counts of ids, damped and of length one, projected; the origin if there are none."""
    counts = np.log1p(np.bincount(SHORT[ids] if ids.itemsize == 2 else bucket(ids), minlength=BUCKETS))
    length = np.sqrt(counts @ counts)
    return counts @ onto / length if length else np.zeros(onto.shape[1])


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place along the Hilbert curve of each row of cells (integers below 2 ** bits); bits * columns is at most 63.

    The axes are turned into the curve's transposed index by undoing the reflections and swaps of each level from the top, after
    which a Gray decoding across the axes is left; its bits, axis by axis within a level, are the key.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(dims):
            turned = (x[i] >> level) & 1 == 1
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    carry = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        carry ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= carry
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def cuts(total: int, length: int) -> tuple[int, list[int]]:
    """Number of full sequences of a stream of `total` ids, and the lengths of those after them: powers of two, falling, without padding."""
    rest = total % length
    return total // length, [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def tokenised(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """docs (id, text) -> id, n, ids (bytes), c0.. (coordinates)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, onto = ids_of(path), projection()
        end = np.array([end_id], ids.dtype).tobytes()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                own = ids.of_all([t or b"" for t in part.column("text").to_pylist()])
                at = np.array([coordinates(np.frombuffer(o, ids.dtype), onto) for o in own])
                own = [o + end for o in own]
                n = pa.array([len(o) // ids.dtype.itemsize for o in own], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), n, pa.array(own, pa.binary()), *[pa.array(at[:, j]) for j in range(DIMENSIONS)]], ["id", "n", "ids", *names])

    names = [f"c{j}" for j in range(DIMENSIONS)]
    fields = [docs.schema["id"], T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType()), *[T.StructField(c, T.DoubleType()) for c in names]]
    return docs.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(run, T.StructType(fields))


def along_curve(rows: DataFrame) -> DataFrame:
    """rows (id, n, ids, c0..) -> id, n, ids, part, local: sorted along the curve, with the ids before a row in its partition of that order.

    Each coordinate is spread over its cells by a logistic curve about its mean, so that cells are used evenly. Ties go by id and text.
    """
    names = [f"c{j}" for j in range(DIMENSIONS)]
    stats = rows.agg(*[f(c).alias(f"{c}_{f.__name__}") for c in names for f in (F.avg, F.stddev_pop)]).first()
    scale = [(round(stats[f"{c}_avg"] or 0.0, 9), round(stats[f"{c}_stddev_pop"] or 0.0, 9)) for c in names]

    @F.pandas_udf("long")
    def key(*columns: pd.Series) -> pd.Series:
        at = np.column_stack([(c.to_numpy() - m) / s if s else np.zeros(len(c)) for c, (m, s) in zip(columns, scale)])
        cells = np.minimum((1 << BITS) / (1 + np.exp(-1.702 * np.clip(at, -30, 30))), (1 << BITS) - 1).astype(np.int64)
        return pd.Series(hilbert(cells, BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            local = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(local)], ["id", "n", "ids", "part", "local"])

    order = ["key", "id", "tie", "row"]
    keyed = rows.select("id", "n", "ids", key(*names).alias("key"), F.xxhash64("ids").alias("tie"), F.monotonically_increasing_id().alias("row"))
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "n", "ids")
    fields = [rows.schema["id"], rows.schema["n"], rows.schema["ids"], T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType())]
    return ranged.mapInArrow(run, T.StructType(fields))


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces of documents: <id_col>, start, length, ids (bytes of little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset.

    A document is the ids of its text (null: empty) and end_id. Documents of alike words are neighbours along a Hilbert curve over
    projected hashed counts of ids; they follow each other in one stream of ids, which is cut at every multiple of `length`. What is left at the
    end makes sequences of falling powers of two, so no sequence needs padding. Texts of any length are spread over as many sequences as
    they need. Equal texts are neighbours, ordered by id; repeated rows are packed as often as they occur; a null id comes first; an empty
    table gives no pieces. Other columns are not looked at.

    Rows with their ids are sorted by ranges of the curve; copies of one text share a key and are told apart by id, so no range grows
    with them. The driver sees one count of ids a range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    made = common.materialise(tokenised(rows, tokenizer, end_id), "tokens")
    placed = common.materialise(along_curve(made), "curve")
    common.discard(made)
    bases, total = [], 0
    for r in sorted(placed.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        bases.append((r["part"], total))
        total += r["n"]
    full, tail = cuts(total, length)
    edges = np.concatenate([[0], np.cumsum(tail)]).astype(np.int64) + full * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                n, at = part.column("n").to_numpy(), part.column("at").to_numpy()
                of, starts, lengths, sequences, offsets, ids = [], [], [], [], [], []
                for i, (size, first, raw) in enumerate(zip(n.tolist(), at.tolist(), part.column("ids"))):
                    data, place = raw.as_py(), first
                    width = len(data) // size
                    wide = np.frombuffer(data, f"<u{width}").astype("<u4").tobytes()
                    while place < first + size:
                        if place < full * length:
                            sequence, begin = divmod(place, length)
                            begin, stop = place - begin, place - begin + length
                        else:
                            e = int(np.searchsorted(edges, place, "right"))
                            sequence, begin, stop = full + e - 1, int(edges[e - 1]), int(edges[e])
                        stop = min(stop, first + size)
                        of.append(i)
                        starts.append(place - first)
                        lengths.append(stop - place)
                        sequences.append(sequence)
                        offsets.append(place - begin)
                        ids.append(wide[4 * (place - first) : 4 * (stop - first)])
                        place = stop
                taken = pa.array(of, pa.int64())
                longs = [pa.array(v, pa.int64()) for v in (starts, lengths)]
                more = [pa.array(v, pa.int64()) for v in (sequences, offsets)]
                yield pa.RecordBatch.from_arrays([part.column("id").take(taken), *longs, pa.array(ids, pa.binary()), part.column("n").take(taken), *more], names)

    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    fields = [T.StructField(id_col, placed.schema["id"].dataType), *[T.StructField(c, T.BinaryType() if c == "ids" else T.LongType()) for c in names[1:]]]
    # one row a range of the sort
    base = F.broadcast(spark.createDataFrame(bases, "p int, base long"))
    positioned = placed.join(base, F.col("part") == F.col("p")).select("id", "n", "ids", (F.col("base") + F.col("local")).alias("at"))
    return positioned.mapInArrow(run, T.StructType(fields))


def op11_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens of the public word-level BPE, as pieces with the checksum of their ids."""
    import public_tokenizers

    done = pack(common.table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return done.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
