"""Writers: ordered Parquet with a manifest, JSON payloads, and binary payloads."""

from __future__ import annotations

import hashlib
import json
import re
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hypervector import to_bytes
from .tables import manifest

ORDER = {"concepts": ["id"], "associations": ["src_id", "dst_id"], "concept_versions": ["id", "version"], "benchmarks": ["suite", "name", "run_at_us"]}
CODECS = {"zstd": "zstd", "snappy": "snappy", "none": "uncompressed"}
MAGIC = b"TESSER01"


def export_parquet(rows: DataFrame, table: str, path: str, compression: str = "zstd", row_group_bytes: int = 128 << 20, partition_by: str | None = None) -> int:
    """Rows in the order of the table's keys (range-partitioned, so no single task sorts them); returns their number."""
    if partition_by is not None and not re.fullmatch(r"[A-Za-z_]\w*", partition_by):
        raise ValueError(f"not a column name: {partition_by}")
    writer = rows.orderBy(*ORDER[table]).write.option("compression", CODECS[compression.lower()]).option("parquet.block.size", row_group_bytes)
    (writer.partitionBy(partition_by) if partition_by else writer).mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path).count()


def export_all(tables: dict[str, DataFrame], folder: str, **options: object) -> str:
    """All tables and ``manifest.json`` with rows, bytes and SHA-256 of their files, in any store that Spark writes to.

    A file is hashed by the task that reads it; the table's hash is that of its files' hashes in the order of their names.
    """
    files = {}
    for name, rows in tables.items():
        path = f"{folder}/{name}.parquet"
        n = export_parquet(rows, name, path, **options)
        parts = _hashed(rows.sparkSession, path).orderBy("path").collect()
        files[name] = {"rows": n, "bytes": sum(p.size for p in parts), "sha256": hashlib.sha256(b"".join(bytes.fromhex(p.digest) for p in parts)).hexdigest()}
    text = manifest(files, dict(options))
    spark = next(iter(tables.values())).sparkSession
    put(spark, f"{folder}/manifest.json", text.encode())
    return text


def _hashed(spark: SparkSession, folder: str) -> DataFrame:
    """``path``, ``size`` and ``digest`` of the Parquet files below a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("digest"))


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file to any store, in place of one that is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def get(spark: SparkSession, path: str, most: int) -> bytes:
    """A file of at most ``most`` bytes from any store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(path)
    if fs.getFileStatus(p).getLen() > most:
        raise ValueError(f"{path} has over {most} bytes")
    return bytes(spark.read.format("binaryFile").load(path).select("content").first().content)


def payload(concepts: DataFrame, edges: DataFrame, namespace: str | None = None, exported_at: int = 0) -> DataFrame:
    """One row with the JSON payload of a namespace, vectors in base64. Bounded by the import limit; use Parquet beyond."""
    if namespace is not None:
        concepts, edges = concepts.where(F.col("namespace") == namespace), edges.where(F.col("namespace") == namespace)
    own = F.struct("id", "namespace", F.base64(to_bytes(F.col("vector"))).alias("vector"), "metadata", "created_at", "modified_at", "expires_at", "canonical_concept_ids")
    a = concepts.agg(F.array_sort(F.collect_list(own)).alias("concepts"))
    triple = F.to_json(F.struct(F.col("from_id"), F.col("to_id"), F.col("strength")))
    b = edges.agg(F.array_sort(F.collect_list(triple)).alias("associations"))
    return a.withColumn("associations", b.select("associations").scalar()).select(F.to_json(F.struct(F.lit("1").alias("version"), F.lit(exported_at).alias("exported_at"), "concepts", "associations")).alias("payload"))


def pack_binary(rows: list[dict]) -> bytes:
    """A payload with magic, version 1 and a codec byte (0: JSON). The other codecs' layouts are not public here."""
    return MAGIC + struct.pack("<BB", 1, 0) + json.dumps(rows, sort_keys=True).encode()


def unpack_binary(data: bytes) -> list[dict]:
    if data[: len(MAGIC)] != MAGIC or data[8] != 1:
        raise ValueError("not a payload of version 1")
    if data[9] != 0:
        raise ValueError(f"codec {data[9]} is not supported")
    return json.loads(data[10:])
