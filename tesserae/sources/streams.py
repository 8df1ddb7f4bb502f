"""Binary evidence streams: magic, version, a JSON header with counts, then little-endian columns. Counts are checked before anything is read by them."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAGIC, VERSION = b"TSEV", 1
#: Points of one stream at most; larger clips are several streams.
LIMIT = 1 << 16


def packed(points: pd.DataFrame) -> bytes:
    """One stream of the columns point, x, y, z."""
    header = json.dumps({"points": len(points)}, sort_keys=True).encode()
    columns = [points["point"].to_numpy("<i8"), *(points[c].to_numpy("<f8") for c in "xyz")]
    return MAGIC + struct.pack("<II", VERSION, len(header)) + header + b"".join(c.tobytes() for c in columns)


def unpacked(data: bytes) -> pd.DataFrame:
    """The columns of a stream; anything but an exact stream of this version raises."""
    if data[:4] != MAGIC or len(data) < 12:
        raise ValueError("not an evidence stream")
    version, size = struct.unpack("<II", data[4:12])
    if version != VERSION:
        raise ValueError(f"unknown version: {version}")
    if size > len(data) - 12:
        raise ValueError("the header is cut short")
    n = json.loads(data[12 : 12 + size])["points"]
    if not isinstance(n, int) or not 0 <= n <= LIMIT:
        raise ValueError(f"count out of bounds: {n}")
    if len(data) != 12 + size + 32 * n:
        raise ValueError("the stream doesn't end where its counts say")
    at, out = 12 + size, {}
    for name, kind in (("point", "<i8"), ("x", "<f8"), ("y", "<f8"), ("z", "<f8")):
        out[name] = np.frombuffer(data, kind, n, at)
        at += 8 * n
    return pd.DataFrame(out)


def encode(points: DataFrame, piece: int = LIMIT // 4) -> DataFrame:
    """points: clip, point, x, y, z. Rows (clip, piece, stream): a clip is dealt by hash into pieces of about `piece` points."""
    sizes = points.groupBy("clip").agg(F.ceil(F.count(F.lit(1)) / piece).alias("pieces")).withColumnRenamed("clip", "c")
    dealt = points.join(sizes, F.expr("clip <=> c")).withColumn("piece", F.pmod(F.xxhash64("point"), "pieces").cast("int"))
    kind = dict(points.dtypes)["clip"]

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("point")
        parts = [p.iloc[k : k + LIMIT] for k in range(0, len(p), LIMIT)]
        return pd.DataFrame({"clip": [key[0]] * len(parts), "piece": [key[1]] * len(parts), "stream": [packed(x) for x in parts]})

    return dealt.select("clip", "piece", "point", "x", "y", "z").groupBy("clip", "piece").applyInPandas(run, f"clip {kind}, piece int, stream binary")


def decode(streams: DataFrame) -> DataFrame:
    """Rows (clip, point, x, y, z) of the streams."""
    kind = dict(streams.dtypes)["clip"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for clip, data in zip(b["clip"], b["stream"]):
                yield unpacked(bytes(data)).assign(clip=clip)[["clip", "point", "x", "y", "z"]]

    return streams.select("clip", "stream").mapInPandas(run, f"clip {kind}, point long, x double, y double, z double")
