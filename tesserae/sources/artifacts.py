"""Versioned artifacts: named tables in one folder with a manifest of their schemas, row counts and content hashes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSION = 1


def digest(df: DataFrame) -> tuple[int, str]:
    """Rows and a hash of the content that does not depend on the order of rows."""
    cells = F.sha2(F.to_json(F.struct("*")), 256)
    sums = [F.sum(F.conv(F.substring(cells, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(8)]
    r = df.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    return r["n"], "".join(f"{int(r[f's{k}'] or 0) % (1 << 32):08x}" for k in range(8))


def write(tables: dict[str, DataFrame], folder: str, kind: str, partition: dict[str, str] | None = None) -> dict:
    """Write the tables as Parquet (partition: column by table) and then the manifest, so a folder without one is unfinished."""
    spark = next(iter(tables.values())).sparkSession
    manifest = {"schema_version": VERSION, "kind": kind, "tables": {}}
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        column = (partition or {}).get(name)
        (w.partitionBy(column) if column else w).parquet(f"{folder}/{name}")
        n, content = digest(spark.read.schema(df.schema).parquet(f"{folder}/{name}").select(*df.columns))
        manifest["tables"][name] = {"rows": n, "content_hash": content, "schema": json.loads(df.schema.json())}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return manifest


def manifest_of(spark: SparkSession, folder: str) -> dict:
    found = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    if found.get("schema_version") != VERSION:
        raise ValueError(f"unsupported version {found.get('schema_version')}")
    return found


def read(spark: SparkSession, folder: str, kind: str, verify: bool = False) -> dict[str, DataFrame]:
    """The tables, lazily; with verify, rows and content are held against the manifest first."""
    found = manifest_of(spark, folder)
    if found["kind"] != kind:
        raise ValueError(f"{folder} holds {found['kind']}, not {kind}")
    out = {}
    for name, t in found["tables"].items():
        schema = StructType.fromJson(t["schema"])
        df = spark.read.schema(schema).parquet(f"{folder}/{name}").select(*[F.col(f"`{c}`") for c in schema.names])
        if verify and digest(df) != (t["rows"], t["content_hash"]):
            raise ValueError(f"{name} is not what was written")
        out[name] = df
    return out
