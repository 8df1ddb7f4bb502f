"""Files of scanned scenes as Spark data sources: point files (`ply`, to read and write) and camera trajectories (`trajectory`); mappings and camera tables as text.

    register(spark)
    spark.read.format("ply").load("/scans").where("z < 3")
    points.write.format("ply").mode("append").save("/scans")

Paths may be files or folders on any file system that pyarrow knows. Binary point files are split by records, trajectories by lines; comparisons with
numbers are pushed to the reader.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

#: Records of one partition and of one written file, rows of one batch, bytes of one partition of text.
RECORDS, ROWS, BYTES = 1 << 20, 1 << 16, 32 << 20

# The number types of a point file's header, with numpy's and Spark's.
NUMBERS = {
    "char": ("i1", T.IntegerType()),
    "uchar": ("u1", T.IntegerType()),
    "short": ("i2", T.IntegerType()),
    "ushort": ("u2", T.IntegerType()),
    "int": ("i4", T.IntegerType()),
    "uint": ("u4", T.LongType()),
    "float": ("f4", T.FloatType()),
    "double": ("f8", T.DoubleType()),
}
SAME = {"int8": "char", "uint8": "uchar", "int16": "short", "uint16": "ushort", "int32": "int", "uint32": "uint", "float32": "float", "float64": "double"}
ORDERS = {"binary_little_endian": "<", "binary_big_endian": ">", "ascii": None}
COMPARE = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files(path: str, ending: str | tuple) -> list[str]:
    """The path itself, or the files of a folder with this ending, in order; those whose names begin with _ or . are not there."""
    system, inner = opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [inner]
    if info.type != fs.FileType.Directory:
        raise ValueError(f"no such file: {path}")
    found = system.get_file_info(fs.FileSelector(inner))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.endswith(ending) and f.base_name[0] not in "_.")


@dataclass
class Header:
    order: str | None
    count: int
    fields: list[tuple[str, str]]
    size: int

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(n, (self.order or "<") + NUMBERS[t][0]) for n, t in self.fields])

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, NUMBERS[t][1]) for n, t in self.fields])


def header(system: fs.FileSystem, path: str) -> Header:
    """The vertex part of a point file's header; vertices must come first and hold single numbers."""
    with system.open_input_file(path) as f:
        head = b""
        while b"end_header" not in head or b"\n" not in head[head.index(b"end_header") :]:
            more = f.read(4096)
            if not more:
                raise ValueError(f"not a point file: {path}")
            head += more
    size = head.index(b"\n", head.index(b"end_header")) + 1
    lines = [x.split() for x in head[:size].decode("ascii", "replace").splitlines()]
    order, count, fields, part = "", None, [], None
    if lines[0] != ["ply"]:
        raise ValueError(f"not a point file: {path}")
    for w in lines[1:]:
        if w[:1] == ["format"] and w[1] in ORDERS:
            order = ORDERS[w[1]]
        elif w[:1] == ["element"]:
            if w[1] == "vertex" and part is None:
                count = int(w[2])
            elif count is None:
                raise ValueError(f"vertices don't come first: {path}")
            part = w[1]
        elif w[:1] == ["property"] and part == "vertex":
            kind = SAME.get(w[1], w[1])
            if kind not in NUMBERS:
                raise ValueError(f"a vertex property of type {w[1]}: {path}")
            fields.append((w[2], kind))
    if order == "" or count is None or count < 0 or not fields:
        raise ValueError(f"an incomplete header: {path}")
    return Header(order, count, fields, size)


@dataclass
class Part(InputPartition):
    path: str
    first: int
    count: int

    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class PointReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema, self.tests = path, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of a number with a constant are done here; the others are left to Spark."""
        for f in filters:
            if type(f) in COMPARE and len(f.attribute) == 1 and isinstance(f.value, (int, float)) and not isinstance(f.value, bool):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Part]:
        out = []
        for path in files(self.path, ".ply"):
            h = header(opened(self.path)[0], path)
            step = RECORDS if h.order else max(h.count, 1)  # lines of text have no places, so such a file is one partition
            out += [Part(path, k, min(step, h.count - k)) for k in range(0, h.count, step)]
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        system = opened(self.path)[0]
        h = header(system, part.path)
        if [(f.name, f.dataType) for f in self.schema] != [(f.name, f.dataType) for f in h.schema]:
            raise ValueError(f"other columns than the first file's: {part.path}")
        with system.open_input_file(part.path) as f:
            f.seek(h.size + (part.first * h.dtype.itemsize if h.order else 0))
            text = None if h.order else io.BufferedReader(f)
            for k in range(0, part.count, ROWS):
                n = min(ROWS, part.count - k)
                if h.order:
                    data = f.read(n * h.dtype.itemsize)
                    if len(data) < n * h.dtype.itemsize:
                        raise ValueError(f"cut short: {part.path}")
                    rows = np.frombuffer(data, h.dtype)
                else:
                    rows = np.array([tuple(self.line(text, len(h.fields), part.path)) for _ in range(n)], h.dtype)
                keep = np.ones(n, bool)
                for name, kind, value in self.tests:
                    keep &= COMPARE[kind](rows[name], value)
                arrays = [pa.array(rows[f.name][keep].astype(rows.dtype[f.name].newbyteorder("="))).cast(ARROW[type(f.dataType)]) for f in self.schema]
                yield pa.RecordBatch.from_arrays(arrays, self.schema.names)

    @staticmethod
    def line(text: io.BufferedReader, n: int, path: str) -> list[float]:
        out = text.readline().split()
        if len(out) != n:
            raise ValueError(f"a vertex needs {n} numbers: {path}")
        return [float(x) for x in out]


ARROW = {T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.FloatType: pa.float32(), T.DoubleType: pa.float64()}


@dataclass
class Written(WriterCommitMessage):
    names: list


class PointWriter(DataSourceArrowWriter):
    """Tasks write files of at most RECORDS points under a temporary name each; commit moves them to their place, abort deletes them. No null is allowed."""

    def __init__(self, path: str, schema: T.StructType, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex
        kinds = {T.IntegerType: "int", T.FloatType: "float", T.DoubleType: "double", T.ShortType: "short", T.ByteType: "char"}
        wrong = [f.name for f in schema if type(f.dataType) not in kinds or not f.name.isidentifier()]
        if wrong:
            raise ValueError(f"not columns of a point file: {wrong}")
        self.fields = [(f.name, kinds[type(f.dataType)]) for f in schema]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, inner = opened(self.path)
        system.create_dir(f"{inner}/_temporary-{self.job}", recursive=True)
        dtype = np.dtype([(n, "<" + NUMBERS[t][0]) for n, t in self.fields])
        names, held, size = [], [], 0

        def close() -> None:
            nonlocal held, size
            name = f"part-{uuid.uuid4().hex}.ply"
            head = ["ply", "format binary_little_endian 1.0", f"element vertex {size}", *[f"property {t} {n}" for n, t in self.fields], "end_header"]
            with system.open_output_stream(f"{inner}/_temporary-{self.job}/{name}") as f:
                f.write("".join(x + "\n" for x in head).encode())
                for rows in held:
                    f.write(rows.tobytes())
            names.append(name)
            held, size = [], 0

        for batch in batches:
            if any(c.null_count for c in batch.columns):
                raise ValueError("a point file has no nulls")
            rows = np.empty(batch.num_rows, dtype)
            for (n, _), c in zip(self.fields, batch.columns):
                rows[n] = c.to_numpy(zero_copy_only=False)
            for k in range(0, len(rows), RECORDS):
                held.append(rows[k : k + RECORDS])
                size += len(held[-1])
                if size >= RECORDS:
                    close()
        if held:
            close()
        return Written(names)

    def commit(self, messages: list) -> None:
        system, inner = opened(self.path)
        system.create_dir(inner, recursive=True)
        old = files(self.path, ".ply") if self.overwrite else []
        for m in messages:
            for name in m.names if m else []:
                system.move(f"{inner}/_temporary-{self.job}/{name}", f"{inner}/{name}")
        for path in old:
            system.delete_file(path)
        self.clear()

    def abort(self, messages: list) -> None:
        self.clear()

    def clear(self) -> None:
        system, inner = opened(self.path)
        if system.get_file_info(f"{inner}/_temporary-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{inner}/_temporary-{self.job}")


class Points(DataSource):
    """The vertices of point files of one kind, with the columns of the header."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> T.StructType:
        found = files(self.options["path"], ".ply")
        if not found:
            raise ValueError(f"no point file: {self.options['path']}")
        return header(opened(self.options["path"])[0], found[0]).schema

    def reader(self, schema: T.StructType) -> PointReader:
        return PointReader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> PointWriter:
        return PointWriter(self.options["path"], schema, overwrite)


class PathReader(DataSourceReader):
    """A record is a line of three fields and four of four numbers. A partition begins at the first line of three fields from its first byte on, and ends with the record that begins last in it."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        system = opened(self.path)[0]
        sizes = [(p, system.get_file_info(p).size) for p in files(self.path, (".log", ".txt"))]
        return [Part(p, k, min(BYTES, size - k)) for p, size in sizes for k in range(0, size, BYTES)]

    def read(self, part: Part) -> Iterator[tuple]:
        with io.BufferedReader(opened(self.path)[0].open_input_file(part.path)) as f:
            at = part.first
            if at:
                f.seek(at - 1)
                at += len(f.readline()) - 1  # what is left of the line that the byte before belongs to
            head = None
            while at < part.first + part.count or head is not None:
                line = f.readline()
                if not line:
                    break
                at += len(line)
                words = line.split()
                if len(words) == 3 and head is None and at - len(line) < part.first + part.count:
                    head, numbers = words, []
                elif head is not None:
                    if len(words) != 4:
                        raise ValueError(f"a trajectory's row needs four numbers: {part.path}: {line!r}")
                    numbers += [float(w) for w in words]
                    if len(numbers) == 16:
                        yield part.path.rsplit("/", 1)[-1], int(head[0]), numbers, numbers[3], numbers[7], numbers[11]
                        head = None
                elif words and not (part.first and len(words) == 4):
                    raise ValueError(f"a trajectory's record begins with three fields: {part.path}: {line!r}")
            if head is not None:
                raise ValueError(f"a trajectory is cut short: {part.path}")


class Trajectory(DataSource):
    """file, camera, matrix (16 numbers by rows, camera to world), x, y, z (its place)."""

    @classmethod
    def name(cls) -> str:
        return "trajectory"

    def schema(self) -> str:
        return "file string, camera long, matrix array<double>, x double, y double, z double"

    def reader(self, schema: T.StructType) -> PathReader:
        return PathReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session, and lets Spark hand filters to such readers."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Points)
    spark.dataSource.register(Trajectory)


def mapping(spark: SparkSession, path: str) -> DataFrame:
    """reference, frame: the pairs of a mapping file, whose first two lines say how many there are and of how many frames."""
    lines = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "").alias("l"))  # one small file a scan
    pairs = lines.select(F.get("l", F.lit(0)).cast("long").alias("n"), F.posexplode(F.slice("l", 3, 1 << 30)).alias("at", "pair")).where("at < n")
    cut = F.split(F.trim("pair"), r"\s+")
    fine = F.when(F.size(cut) == 2, cut).otherwise(F.raise_error(F.concat(F.lit("a mapping's row needs two numbers: "), F.col("pair"))))
    return pairs.select(fine.alias("p")).select(F.col("p")[0].cast("long").alias("reference"), F.col("p")[1].cast("long").alias("frame"))


def camera_table(spark: SparkSession, path: str) -> DataFrame:
    """frame_index, x, y, z of camera tables with a header."""
    return spark.read.option("header", True).option("mode", "FAILFAST").csv(path).select(F.col("frame_index").cast("long").alias("frame_index"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
