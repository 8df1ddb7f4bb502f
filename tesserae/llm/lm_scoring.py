"""LM scoring by logistic mixing of hashed-context bit predictors.

A text is its tokens in order: lower-cased (A-Z) words and one end. A token is coded byte by byte, bits from the highest down, with a
closing byte, so the bits of all tokens make up the text and their log probabilities its score. Contexts are the bytes back to the
token's start and a state: the class (such as the language) that the text before looks most like, and the token before, if it is one
of the commonest. So a token costs the same wherever it stands in the same state: the model is worked out once for each different
token and state of the corpus.

Predictors count the bits seen in hashed contexts: the last two to four bytes, the whole token so far (of the frequent ones), and the whole
token so far after the token before. A mixer adds their log odds with weights that are chosen by gate (place in the token, place in the byte) and by how much each
context has seen. It learns online, batch by batch, from the training tokens, each seen without its own occurrence. A last table
refines the mixed probability by what came of such probabilities before.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import common
from tesserae.llm import shingles as sh

#: Slots of each predictor's table as a power of 2: SPARE bits more than the corpus has different tokens, between the two bounds. Counts
#: are kept in steps of a tenth of an octave, so a model is 20 MB at most.
SLOTS_LEAST, SLOTS_MOST, SPARE = 16, 21, 2
GRAIN = 10
#: Predictors: the last two to four bytes (two and three with the class), the whole token with the class, and that with the token before.
STATED = (0, 1)
ORDERS, WHOLE, WORD, BACK = 5, 3, 4, 4
#: Classes beside the unknown one: the commonest values of the class column. Words that tell them apart; a text's class is set anew
#: after FIRST tokens and whenever its length so far has grown GROWTH times, until a class leads by SURE (natural log odds).
CLASSES, TELLING, FIRST, GROWTH, SURE = 7, 4096, 4, 4, 30.0
#: A state is a class in the low CLASS_BITS bits and the number of the token before (0: none of the BEFORE commonest) above them.
CLASS_BITS, BEFORE = 3, 15
#: Of so many slots one is meant for a token whose nodes the whole-token predictor has; and so many tokens (with their states) are
#: looked up in place rather than joined.
NODES, LOOKUP = 16, 1 << 18
#: The learning stream is dealt by hash into so many pieces, each in an order of its own, whatever the partitions; each piece learns a mixer.
PIECES = 32
#: Tokens that stand in every batch from which the mixer learns.
OFTEN = 256
#: Steps of a task before what came of its mixed odds counts.
SETTLE = 8
#: Added to each count of a node. It is small, as the weights scale the odds down where a context has seen little.
PRIOR = 0.05
#: Levels of what a context has seen (by powers of 4, apart where only one bit value was seen), and places in a token that gates tell apart.
LEVELS, PLACES = 16, 6
#: Cells of the last table: steps of the mixed log odds, and the byte before.
STEPS, REACH = 33, 8.0
CHUNK_TOKENS, CHUNK_BYTES = 2048, 1 << 17
#: Slots in a row of the count tables as they travel.
ROW = 1 << 13
#: What the counts of a task may come to before it hands them on: each byte meets a slot once for each of its bits.
FULL = (1 << 32) // 8 - 1
#: Texts that a task takes from Arrow at a time.
TEXTS = 256
RATE = 0.02
BASE_SMOOTH = 0.1
SALT = sh.mix(np.arange(1, ORDERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
NODE = np.uint64(0xD1B54A32D192ED03)


def tokens_of(text: str | None) -> list[bytes]:
    """Words of the text; the end is the empty token."""
    return [*sh.encoded(text).split(), b""]


class Teller(NamedTuple):
    """Telling words, and for each the log odds of each class; a last row of zeros for all others. before: numbers of the commonest tokens."""

    rows: dict[bytes, int]
    odds: np.ndarray
    before: dict[bytes, int]


def segments(tokens: list[bytes], teller: Teller) -> list[tuple[int, list[bytes]]]:
    """The text's tokens in runs of one state: 0 at first, then the class that the tokens before the run speak for most."""
    out, state, at, size = [], 0, 0, FIRST
    total, sure = np.zeros(teller.odds.shape[1]), False
    while at < len(tokens):
        if sure:
            out.append((state, tokens[at:]))
            break
        part = tokens[at : at + size]
        out.append((state, part))
        at += len(part)
        size = at * (GROWTH - 1)
        if at < len(tokens) and len(total):
            rows = np.fromiter(map(teller.rows.get, part, repeat(-1)), np.int64, len(part))
            total += teller.odds[rows].sum(0)  # the last row, of other words, is 0
            if total.any():
                state = int(total.argmax()) + 1
                sure = int((total > total[state - 1] - SURE).sum()) == 1
    return out


def states_of(tokens: list[bytes], teller: Teller) -> list[int]:
    """The state of each token."""
    state, at = np.zeros(len(tokens), np.int64), 0
    for z, part in segments(tokens, teller):
        state[at : at + len(part)] = z
        at += len(part)
    if len(tokens) > 1:
        state[1:] |= np.fromiter(map(teller.before.get, tokens[:-1], repeat(0)), np.int64, len(tokens) - 1) << CLASS_BITS
    return state.tolist()


class Trace(NamedTuple):
    """The bytes of some tokens with their contexts."""

    byte: np.ndarray
    token: np.ndarray
    place: np.ndarray
    before: np.ndarray
    context: list[np.ndarray]


def trace(tokens: list[bytes], states: np.ndarray) -> Trace:
    raw = b"".join(t + b" " if t else b"\n" for t in tokens)
    data = np.frombuffer(raw, np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths)
    token = np.repeat(np.arange(len(tokens)), lengths)
    start = (ends - lengths)[token]
    place = np.arange(len(data)) - start
    back = []
    wide = data.astype(np.uint64)
    for k in range(1, BACK + 1):
        b = np.zeros(len(data), np.uint64)
        b[k:] = wide[:-k] if k < len(data) else 0
        b[place < k] = 0
        back.append(b)
    whole_state = states.astype(np.uint64)
    contexts, total, state = [], np.zeros(len(data), np.uint64), ((whole_state & np.uint64((1 << CLASS_BITS) - 1)) << np.uint64(56))[token]
    for k, b in enumerate(back):
        total = total | (b << np.uint64(8 * k))
        if k:
            contexts.append(sh.mix((total | state if k - 1 in STATED else total) + SALT[k - 1]))
    prefix = np.zeros(len(data), np.uint64)
    np.cumsum((sh.BYTE[data] * sh.powers("base", len(data)))[:-1], out=prefix[1:])
    whole = (prefix - prefix[start]) * sh.powers("inverse", len(data))[start]
    whole += place.astype(np.uint64) * NODE
    whole = sh.mix(whole)
    contexts.append(sh.mix((whole ^ state) + SALT[WHOLE]))
    contexts.append(sh.mix((whole ^ (whole_state << np.uint64(56))[token]) + SALT[WORD]))
    return Trace(data, token, place, back[0].astype(np.int64), contexts)


def node_keys(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    return (context + node * NODE) * np.uint64(0xBF58476D1CE4E5B9)


def slot_of(t: Trace, order: int, node: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Slot of a node in a predictor's table; the whole-token table also has a tag that tells its nodes from others."""
    keys = node_keys(t.context[order], node)
    slots = (keys >> np.uint64(64 - bits)).astype(np.int64)
    return slots, (keys & np.uint64(0xFFFF)).astype(np.uint16) | np.uint16(1) if order == WHOLE else None


def bits_of(t: Trace) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place in the byte, node, bit) from the highest bit down; a node is the bits of the byte so far after a leading 1."""
    wide = t.byte.astype(np.uint64)
    for j in range(8):
        yield j, (np.uint64(1 << j) | (wide >> np.uint64(8 - j))), ((t.byte >> (7 - j)) & 1).astype(np.int64)


def tags_of(frequent: list[tuple[bytes, int]], bits: int) -> np.ndarray:
    """Tags of the nodes of the frequent tokens (with their classes) in the whole-token table; the first to claim a slot has it."""
    tags = np.zeros(1 << bits, np.uint16)
    for part in chunks(frequent):
        t = trace([x for x, _ in part], np.array([z for _, z in part]))
        for _, node, _ in bits_of(t):
            slots, tag = slot_of(t, WHOLE, node, bits)
            slots, first = np.unique(slots, return_index=True)
            free = tags[slots] == 0
            tags[slots[free]] = tag[first][free]
    return tags


def chunks(rows: list[tuple]) -> Iterator[list]:
    """Runs of rows of bounded number and, but for single long tokens (the first of a row), bounded bytes."""
    part, size = [], 0
    for r in rows:
        if part and (len(part) >= CHUNK_TOKENS or size + len(r[0]) > CHUNK_BYTES):
            yield part
            part, size = [], 0
        part.append(r)
        size += len(r[0])
    if part:
        yield part


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Tokens, their states and training counts in these, a chunk at a time."""
    for b in batches:
        for part in chunks(list(zip(*(c.to_pylist() for c in b.columns[:3])))):
            tokens, states, counts = zip(*part)
            yield list(tokens), np.array(states), np.array(counts, float)


def coarse(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes (of whole numbers) on a log scale; 0 and 1 stay what they are."""
    return np.minimum(np.rint(GRAIN * np.log2(1 + counts.astype(float))), 255).astype(np.uint8)


def node_tables(less: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Log odds and level for each pair of count bytes (as one number, zeros' count low). less: the bit of which one occurrence is left out."""
    counts = 2.0 ** (np.arange(256) / GRAIN) - 1
    n1, n0 = np.meshgrid(counts, counts, indexing="ij")
    n0, n1 = np.maximum(n0 - (less == 0), 0).ravel(), np.maximum(n1 - (less == 1), 0).ravel()
    level = np.minimum(np.frexp(n0 + n1 + 0.5)[1] // 2, LEVELS // 2 - 1) + LEVELS // 2 * ((n0 == 0) | (n1 == 0))
    return np.log((n1 + PRIOR) / (n0 + PRIOR)).astype(np.float32), level.astype(np.int32)


#: For all counts, and for leaving out one occurrence of the bit 0 or 1 (the second after the first).
PLAIN = node_tables(None)
ODDS, LEVEL = (np.concatenate([node_tables(k)[i] for k in (0, 1)]) for i in (0, 1))


def packed(row: np.ndarray) -> bytes:
    """The places and values of what isn't 0, deflated."""
    at = np.flatnonzero(row)
    return zlib.compress(at.astype(np.uint16).tobytes() + row[at].astype(np.float64).tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    n = len(raw) // 10
    return np.frombuffer(raw, np.uint16, n), np.frombuffer(raw, np.float64, n, 2 * n)


class Model(NamedTuple):
    bits: int
    tags: np.ndarray
    tables: list[np.ndarray]
    weights: np.ndarray | None = None
    last: np.ndarray | None = None


def start_weights() -> np.ndarray:
    w = np.full((PLACES * 8, ORDERS, LEVELS), 0.15)
    w[:, WHOLE] = 0.4
    return w


def inputs(model: Model, t: Trace, node: np.ndarray, bit: np.ndarray, less: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Log odds of every predictor, and how much its context has seen. less: leave one occurrence of the token out of the counts."""
    odds, level = [], []
    for k in range(ORDERS):
        slots, tag = slot_of(t, k, node, model.bits)
        n = model.tables[k][slots].astype(np.int32)
        if tag is not None:
            n *= model.tags[slots] == tag
        if less:
            n += (bit << 16).astype(np.int32)
            odds.append(ODDS[n])
            level.append(LEVEL[n])
        else:
            odds.append(PLAIN[0][n])
            level.append(PLAIN[1][n])
    return odds, level


def mixed(weights: np.ndarray, gate: np.ndarray, odds: list[np.ndarray], level: list[np.ndarray]) -> np.ndarray:
    flat, base = weights.astype(np.float32).ravel(), gate.astype(np.int32) * (ORDERS * LEVELS)
    return np.clip(sum(flat[base + (k * LEVELS + level[k])] * odds[k] for k in range(ORDERS)), -16, 16)


def cells(t: Trace, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower cell of the last table for each mixed log odds, and how far x is to the next."""
    at = (np.clip(x, -REACH, REACH) + REACH) * ((STEPS - 1) / (2 * REACH))
    low = np.minimum(at.astype(np.int64), STEPS - 2)
    return t.before * STEPS + low, at - low


def count_tables(batches: Iterator[pa.RecordBatch], tags: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (row, n): counts of a task, ROW slots at a time. They are whole numbers, so their sums don't depend on any order.

    Tables have 32 bits a slot (84 MB at most in all) and are handed on before the counts in them could pass FULL; what sums up the rows has more.
    """
    tables = [np.zeros(2 << bits, np.uint32) for _ in range(ORDERS)]  # those of bit 1 after those of bit 0
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        number = 0
        for table in tables:
            for part in table.reshape(-1, ROW):
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([packed(part)], pa.binary())], ["row", "n"])
                    part[:] = 0
                number += 1

    for tokens, states, counts in rows_of(batches):
        t, left = None, counts.astype(np.int64)
        while (left > 0).any():  # more than once only where a token has more than its share of FULL
            part = np.clip(left, 0, max(1, FULL // (sum(map(len, tokens)) + len(tokens))))
            left = left - part
            t = t or trace(tokens, states)
            weight = part[t.token].astype(np.uint32)
            mass = int(part[t.token].sum())
            if held + mass > FULL:
                yield from flush()
                held = 0
            held += mass
            for _, node, bit in bits_of(t):
                for k in range(ORDERS):
                    slots, tag = slot_of(t, k, node, bits)
                    at, w = slots + (bit << bits), weight
                    if tag is not None:
                        own = tags[slots] == tag
                        at, w = at[own], w[own]
                    np.add.at(tables[k], at, w)
    yield from flush()


def added_rows(rows: DataFrame) -> DataFrame:
    """The sums of equal rows of counts as bytes on the log scale, one row at a time in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(coarse(total).tobytes(), 1)], pa.binary())], ["row", "n"])
        for b in batches:
            for row, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if row != at:
                    if at is not None:
                        yield out()
                    at, total = row, np.zeros(ROW)
                places, values = unpacked(n)
                total[places] += values
        if at is not None:
            yield out()

    return rows.repartition("row").sortWithinPartitions("row").mapInArrow(run, "row int, n binary")


def learn_weights(batches: Iterator[pa.RecordBatch], model: Model, often: list[tuple[bytes, int, float]], mass: float) -> Iterator[pa.RecordBatch]:
    """Online mixing over the training tokens of a piece; one row of (piece, mass, weights, last).

    The weights are the mean over the second half of the steps. last: what came of the mixed log odds as they were when met.

    The most common tokens stand in every batch with their share of the mass, as they would in a stream of text; otherwise
    the few batches that have them would pull the weights to and fro.
    """
    w, m, v, step, seen, kept = start_weights(), 0.0, 0.0, 0, 0.0, []
    apart = {(t, z) for t, z, _ in often}
    names, places, shares = [t for t, _, _ in often], [z for _, z, _ in often], np.array([c for _, _, c in often], float)
    rest = max(1.0, mass - shares.sum())
    size = 256 * STEPS
    found = np.zeros((2, size))
    for tokens, states, counts in rows_of(batches):
        own = [(t, z, c) for t, z, c in zip(tokens, states.tolist(), counts) if c > 0 and (t, z) not in apart]
        if not own:
            continue
        part = np.array([c for _, _, c in own])
        t = trace([t for t, _, _ in own] + names, np.array([z for _, z, _ in own] + places))
        each = np.concatenate([part, shares * (part.sum() / rest)])
        weight = each[t.token]
        place = np.minimum(t.place, PLACES - 1)
        grad, total = np.zeros(w.size), weight.sum()
        for j, node, bit in bits_of(t):
            odds, level = inputs(model, t, node, bit, True)
            gate = place * 8 + j
            x = mixed(w, gate, odds, level)
            slope = (0.5 * (1 + np.tanh(x / 2)) - bit) * weight
            if step >= SETTLE:
                low, far = cells(t, x)
                found += np.bincount(np.concatenate([low, low + 1]) + size * np.tile(bit, 2), np.concatenate([weight * (1 - far), weight * far]), 2 * size).reshape(2, size)
            for k in range(ORDERS):
                grad += np.bincount((gate * ORDERS + k) * LEVELS + level[k], slope * odds[k], w.size)
        step += 1
        g = grad.reshape(w.shape) / total
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-5)
        kept.append(w)
        seen += part.sum()
        if len(kept) > 64:  # means of pairs, so that the tail average needs bounded memory
            kept = [(a + b) / 2 for a, b in zip(kept[::2], kept[1::2])] + ([kept[-1]] if len(kept) % 2 else [])
    if step:
        w = np.mean(kept[len(kept) // 2 :], axis=0)
        from pyspark import TaskContext

        piece = TaskContext.get().partitionId() if TaskContext.get() else 0
        yield pa.RecordBatch.from_arrays([pa.array([piece]), pa.array([seen]), pa.array([w.tobytes()], pa.binary()), pa.array([found.astype(np.float32).tobytes()], pa.binary())], ["piece", "mass", "w", "last"])


def token_scores(tokens: list[bytes], states: np.ndarray, model: Model) -> np.ndarray:
    """log10 probability of each token in its state."""
    t = trace(tokens, states)
    total = np.zeros(len(tokens))
    for j, node, bit in bits_of(t):
        x = mixed(model.weights, np.minimum(t.place, PLACES - 1) * 8 + j, *inputs(model, t, node, bit, False))
        low, far = cells(t, x)
        refined = model.last[low] * (1 - far) + model.last[low + 1] * far
        p = np.clip((0.5 * (1 + np.tanh(x / 2)) + refined) / 2, 2**-16, 1 - 2**-16)
        total += np.bincount(t.token, np.log10(np.where(bit == 1, p, 1 - p)), len(tokens))
    return total


def commonest(df: DataFrame, most: int) -> DataFrame:
    """The rows of the largest c, as many whole count classes (an eighth of an octave each) as give at most `most` rows.

    The cut comes from the sizes of the classes, so that no task sorts what all others hand it.
    """
    place = F.floor(F.log2("c") * 8)
    classes = df.where("c > 0").groupBy(place.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 8 * 64 rows
    cut, total = None, 0
    for r in sorted(classes, key=lambda r: -r["k"]):
        total += r["n"]
        if total > most:
            break
        cut = r["k"]
    return df.where(F.lit(False)) if cut is None else df.where((F.col("c") > 0) & (place >= cut))


def sorted_top(rows: DataFrame, most: int) -> list[tuple[bytes, int, float]]:
    """At most `most` rows (tok, z, c) of the largest c, in an order that doesn't depend on partitions."""
    return sorted(((bytes(r["tok"]), r["z"], float(r["c"])) for r in commonest(rows, most).collect()), key=lambda x: (-x[2], x[0], x[1]))


def fit(vocab: DataFrame, distinct: int) -> Model:
    """vocab: tok, z, c (training count in state z); distinct: different training tokens. The tables' size follows the corpus up to a bound,
    and what comes to the driver is of bounded size: the tables as bytes and PIECES mixers, whatever the number of tasks."""
    sc = vocab.sparkSession.sparkContext
    bits = min(max(SLOTS_LEAST, int(distinct).bit_length() + SPARE), SLOTS_MOST)
    by_class = vocab.groupBy("tok", F.col("z").bitwiseAND(F.lit((1 << CLASS_BITS) - 1)).alias("z")).agg(F.sum("c").alias("c"))
    tags = tags_of([x[:2] for x in sorted_top(by_class, (1 << bits) // NODES)], bits)
    often = sorted_top(vocab, 16 * OFTEN)[:OFTEN]
    sent = sc.broadcast(tags)
    rows = added_rows(vocab.select("tok", "z", "c").mapInArrow(lambda batches: count_tables(batches, sent.value, bits), "row int, n binary")).collect()
    flat = np.zeros((ORDERS * (2 << bits) // ROW, ROW), np.uint8)
    for r in rows:
        flat[r["row"]] = np.frombuffer(zlib.decompress(r["n"]), np.uint8)
    n = flat.reshape(ORDERS, 2, -1).astype(np.uint16)
    model = Model(bits, tags, [n[k, 0] | (n[k, 1] << 8) for k in range(ORDERS)])
    del flat, rows, n
    counted = sc.broadcast(model)
    total = float(vocab.agg(F.sum("c")).first()[0] or 0)
    key = F.xxhash64(F.lit(4), "tok", "z")
    stream = vocab.select("tok", "z", "c").repartition(PIECES, key).sortWithinPartitions(key, "tok", "z")
    got = stream.mapInArrow(lambda batches: learn_weights(batches, counted.value, often, total), "piece long, mass double, w binary, last binary").collect()
    got.sort(key=lambda r: r["piece"])
    mass = sum(r["mass"] for r in got)
    weights = sum(np.frombuffer(r["w"]).reshape(PLACES * 8, ORDERS, LEVELS) * (r["mass"] / mass) for r in got) if got else start_weights()
    n0, n1 = sum((np.frombuffer(r["last"], np.float32).astype(float) for r in got), np.zeros(2 * 256 * STEPS)).reshape(2, -1)
    for b in (sent, counted):
        b.destroy()
    # empty cells say what the mixed log odds say
    own = 0.5 * (1 + np.tanh(np.tile(np.linspace(-REACH, REACH, STEPS), 256) / 2))
    return model._replace(weights=weights, last=(n1 + 2 * own) / (n0 + n1 + 2))


#: Different keys that a task counts before it hands them on.
HELD = 500_000


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches TEXTS rows at a time, so that Python holds no more than these as objects."""
    for b in batches:
        for k in range(0, b.num_rows, TEXTS):
            yield b.slice(k, TEXTS)


def counted(docs: DataFrame, text_col: str, told: Column, schema: str, places_of) -> DataFrame:
    """Counts by (token, place) over the texts. places_of(tokens, told) gives the tokens' places and whether they count; what doesn't count has 0."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, Counter] = {True: Counter(), False: Counter()}

        def flush() -> Iterator[pa.RecordBatch]:
            for counts, c in held.items():
                if c:
                    tokens, places = zip(*c)
                    values = np.fromiter(c.values(), np.int64, len(c)) * counts
                    yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.binary()), pa.array(places, pa.int32()), pa.array(values)], names)
                    c.clear()

        for b in slices(batches):
            for text, told in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tokens = tokens_of(text)
                places, counts = places_of(tokens, told)
                held[counts].update(zip(tokens, places))
                if sum(map(len, held.values())) > HELD:
                    yield from flush()
        yield from flush()

    found = docs.select(F.col(f"`{text_col}`").alias("t"), told.alias("told")).mapInArrow(run, schema)
    return found.groupBy(*names[:2]).agg(F.sum(names[2]).alias(names[2]))


def by_class(tokens: list[bytes], cls: int) -> tuple:
    return repeat(cls), True


def by_state(teller: Teller):
    return lambda tokens, train: (states_of(tokens, teller), bool(train))


def teller_of(classed: DataFrame) -> Teller:
    """Log odds of the classes for the most frequent tokens; at most TELLING rows of CLASSES counts come to the driver."""
    sums = classed.where("cls > 0").groupBy("cls").agg(F.sum("c").alias("n")).collect()
    size = max((r["cls"] for r in sums), default=0)
    whole = np.ones(size)
    for r in sums:
        whole[r["cls"] - 1] += r["n"]
    each = [F.sum(F.when(F.col("cls") == k + 1, F.col("c")).otherwise(0)).cast("double").alias(f"c{k}") for k in range(size)]
    top = sorted(commonest(classed.groupBy("tok").agg(F.sum("c").alias("c"), *each), TELLING).collect(), key=lambda r: (-r["c"], bytes(r["tok"])))
    odds = np.array([[r[f"c{k}"] for k in range(size)] for r in top]).reshape(len(top), size)
    rate = np.log((odds + 0.5) / whole)
    rate = np.clip(rate - rate.max(1, keepdims=True), -4, 0) if size and len(top) else np.zeros((0, size))
    tokens = [bytes(r["tok"]) for r in top]
    return Teller({t: k for k, t in enumerate(tokens)}, np.concatenate([rate, np.zeros((1, size))]), {t: k + 1 for k, t in enumerate([t for t in tokens if t][:BEFORE])})


class Ready(NamedTuple):
    """Rows of the commonest tokens with their states, and their base and model scores."""

    rows: dict[tuple[bytes, int], int]
    base: np.ndarray
    score: np.ndarray


def ready_of(scored: DataFrame) -> Ready:
    top = commonest(scored, LOOKUP).select("tok", "z", "base", "score").toArrow()
    rows = {key: k for k, key in enumerate(zip(top.column("tok").to_pylist(), top.column("z").to_pylist()))}
    return Ready(rows, top.column("base").to_numpy(), top.column("score").to_numpy())


def documents_scored(docs: DataFrame, id_col: str, text_col: str, trains: Column, ready: Ready, teller: Teller) -> DataFrame:
    """Rows (id, train, key, n_tokens, n_bytes, n_known, base, score, toks, zs, tfs): sums over the commonest tokens, and what is left to join."""
    sent = docs.sparkSession.sparkContext.broadcast((ready, teller))  # LOOKUP and TELLING tokens at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (known, teller), key = sent.value, TaskContext.get().partitionId() << 40
        for b in slices(batches):
            out: list[tuple] = []
            for text in b.column(2).to_pylist():
                tokens = tokens_of(text)
                toks, zs, tfs = [], [], []
                count = Counter(zip(tokens, states_of(tokens, teller)))
                at = np.fromiter(map(known.rows.get, count, repeat(-1)), np.int64, len(count))
                n, on = np.fromiter(count.values(), np.int64, len(count)), at >= 0
                seen = int(n[on].sum())
                x = float((n[on] * known.base[at[on]]).sum())
                y = float((n[on] * known.score[at[on]]).sum())
                if not on.all():
                    names, left = list(count), np.flatnonzero(~on).tolist()
                    toks, zs = zip(*(names[k] for k in left))
                    tfs = n[left].tolist()
                out.append((key, len(tokens), sum(map(len, tokens)) + len(tokens), seen, x, y, list(toks), list(zs), tfs))
                key += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["id", "train", "key", "n_tokens", "n_bytes", "n_known", "base", "score", "toks", "zs", "tfs"])

    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, train boolean, key long, n_tokens long, n_bytes long, n_known long, base double, score double, toks array<binary>, zs array<int>, tfs array<long>"
    return docs.select(F.col(f"`{id_col}`").alias("id"), trains.alias("train"), F.col(f"`{text_col}`").alias("t")).mapInArrow(run, schema)


def score_documents(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = "lang") -> DataFrame:
    """Rows (id, train, n_tokens, n_bytes, n_known, train_tokens, base_score, score, bits_per_byte), one for each row of docs.

    The model learns from the rows where `trains` holds, and takes their class_col (none: no states) to tell states apart; a
    text's own class is never looked at when it is scored. Null and empty texts are one end. Null ids and classes are values
    like others. With nothing to learn from, each bit costs one bit. An empty table stays empty. Repeated rows are scored each.
    Tokens of any length are scored whole. Ties of counts are broken by the tokens' bytes, so that scores don't depend on partitions.
    bits_per_byte: the bits of the text by its coded bytes (n_bytes: each token with its closing byte).
    """
    spark = docs.sparkSession
    cls, learnt = F.lit(0), docs.where(trains)
    if class_col:
        values = learnt.where(F.col(class_col).isNotNull()).groupBy(class_col).count().orderBy(F.desc("count"), class_col).limit(CLASSES).collect()
        for k, r in enumerate(values):
            cls = F.when(F.col(class_col) == r[0], F.lit(k + 1)).otherwise(cls)
    teller = teller_of(common.materialise(counted(learnt, text_col, cls.cast("int"), "tok binary, cls int, c long", by_class), "classed"))
    vocab = common.materialise(counted(docs, text_col, trains, "tok binary, z int, c long", by_state(teller)), "vocabulary")
    counts = common.materialise(vocab.groupBy("tok").agg(F.sum("c").alias("n")).where("n > 0"), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    model = fit(vocab, distinct)
    floor = total + BASE_SMOOTH * (distinct + 1)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, states, counts in rows_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.binary()), pa.array(states.astype(np.int32)), pa.array(counts.astype(np.int64)), pa.array(token_scores(tokens, states, sent.value))], ["tok", "z", "c", "score"])

    based = F.log10((F.coalesce("n", F.lit(0)) + BASE_SMOOTH) / F.lit(floor))
    scored = vocab.mapInArrow(run, "tok binary, z int, c long, score double").join(counts.withColumnRenamed("tok", "w"), F.col("tok") == F.col("w"), "left")
    scored = common.materialise(scored.select("tok", "z", "c", "score", based.alias("base"), F.col("n").isNotNull().alias("known")), "token-scores")
    rows = common.materialise(documents_scored(docs, id_col, text_col, trains, ready_of(scored), teller), "documents-scored")
    rest = rows.select("key", F.explode(F.arrays_zip("toks", "zs", "tfs")).alias("x")).select("key", F.col("x.toks").alias("t"), F.col("x.zs").alias("s"), F.col("x.tfs").alias("n"))
    met = rest.join(scored, F.expr("t = tok and s = z"))
    # sums of decimals don't depend on the order of rows
    exact = lambda c: F.sum((F.col("n") * F.col(c)).cast("decimal(28,12)")).cast("double")
    sums = met.groupBy(F.col("key").alias("k")).agg(exact("base").alias("b"), exact("score").alias("y"), F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("m"))
    joined = rows.drop("toks", "zs", "tfs").join(sums, F.col("key") == F.col("k"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    score = F.col("score") + zero("y")
    return joined.select("id", "train", "n_tokens", "n_bytes", (F.col("n_known") + zero("m")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + zero("b")).alias("base_score"), score.alias("score"), (-score * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of the rows whose remainder is not 0."""
    trains = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 != 0
    found = score_documents(common.table(spark, sf_dir, "documents"), trains)
    return found.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
