"""A sink whose commit writes the manifest: exports that are whole or not there, and are not read again to be told.

``register(spark)`` makes ``df.write.format("tesserine_export")`` known. A task streams its rows into a Parquet file of a
name of its own and hashes the bytes as they pass; rows, bytes and SHA-256 go to the driver in its commit message, a few
numbers a task. When all tasks are done, ``manifest.json`` appears by a rename, and names the files that count. A failed or
repeated task leaves no more than a file that no manifest names; readers go by the manifest alone. Overwriting makes new
files and then a new manifest, so readers of the old one are not disturbed; :func:`vacuum` removes what is not named.

Files are written through Arrow, so the folder is a path that all executors share, or a URI that Arrow opens (``s3``,
``gs``, ``hdfs``, ``file``); for stores that only Spark opens there is :func:`writers.export_all`.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from . import tables
from .writers import CODECS

NAME = "tesserine_export"
MANIFEST = "manifest.json"


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


@dataclass
class Written(WriterCommitMessage):
    """What a task made; ``file`` is empty if it had no rows."""

    file: str
    rows: int
    bytes: int
    sha256: str


class _Hashing(io.RawIOBase):
    """A stream that counts and hashes what passes."""

    def __init__(self, out: pa.NativeFile) -> None:
        self.out, self.digest, self.size = out, hashlib.sha256(), 0

    def writable(self) -> bool:
        return True

    def write(self, data: Any) -> int:
        data = memoryview(data)
        self.out.write(data)
        self.digest.update(data)
        self.size += data.nbytes
        return data.nbytes


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool, compression: str, row_group_bytes: int) -> None:
        self.path, self.schema, self.overwrite, self.row_group_bytes = path, schema.json(), overwrite, row_group_bytes
        self.compression = {"uncompressed": "none"}.get(CODECS[compression], CODECS[compression])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = _opened(self.path)
        name, rows, writer = f"part-{uuid.uuid4().hex}.parquet", 0, None
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in iterator:
            if not batch.num_rows:
                continue
            if writer is None:
                fs.create_dir(folder, recursive=True)
                raw = fs.open_output_stream(f"{folder}/{name}")
                stream = _Hashing(raw)
                writer = pq.ParquetWriter(stream, batch.schema, compression=self.compression)
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if size >= self.row_group_bytes:
                writer.write_table(pa.Table.from_batches(held))
                held, size = [], 0
        if writer is None:
            return Written("", 0, 0, "")
        if held:
            writer.write_table(pa.Table.from_batches(held))
        writer.close()
        raw.close()
        return Written(name, rows, stream.size, stream.digest.hexdigest())

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = _opened(self.path)
        files = sorted((m for m in messages if m is not None and m.file), key=lambda m: m.file)
        target = f"{folder}/{MANIFEST}"
        if not self.overwrite and fs.get_file_info(target).type != pafs.FileType.NotFound:
            self.abort(messages)
            raise FileExistsError(f"{self.path} has a manifest; write with mode overwrite")
        total = hashlib.sha256(b"".join(bytes.fromhex(m.sha256) for m in files)).hexdigest()
        content = {
            "schema": json.loads(self.schema),
            "rows": sum(m.rows for m in files),
            "bytes": sum(m.bytes for m in files),
            "sha256": total,
            "files": [{"name": m.file, "rows": m.rows, "bytes": m.bytes, "sha256": m.sha256} for m in files],
        }
        fs.create_dir(folder, recursive=True)
        aside = f"{folder}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(aside) as out:
            out.write(json.dumps(content).encode())
        fs.move(aside, target)

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = _opened(self.path)
        for m in messages:
            if m is not None and m.file:
                fs.delete_file(f"{folder}/{m.file}")


class ExportSource(DataSource):
    """Options: ``path``, ``compression`` (zstd, snappy, none) and ``row_group_bytes``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        if not self.options.get("path"):
            raise ValueError("an export needs a path")
        return _Writer(self.options["path"].rstrip("/"), schema, overwrite, self.options.get("compression", "zstd").lower(), int(self.options.get("row_group_bytes", 128 << 20)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ExportSource)


def export(rows: DataFrame, path: str, overwrite: bool = False, **options: object) -> dict:
    """Write rows as they are dealt and ordered; returns the manifest."""
    register(rows.sparkSession)
    rows.write.format(NAME).options(path=path, **options).mode("overwrite" if overwrite else "append").save()
    return manifest(rows.sparkSession, path)


def manifest(spark: SparkSession, path: str) -> dict:
    return tables.load_json(spark, f"{path.rstrip('/')}/{MANIFEST}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files that the manifest names."""
    told = manifest(spark, path)
    schema = T.StructType.fromJson(told["schema"])
    files = [f"{path.rstrip('/')}/{f['name']}" for f in told["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """``name`` and ``problem`` (``missing``, ``size`` or ``hash``) of files that are not as the manifest says."""
    told = manifest(spark, path)["files"]
    named = spark.createDataFrame([(f["name"], f["bytes"], f["sha256"]) for f in told], "name string, bytes long, sha256 string")
    there = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.parquet").load(path)
    there = there.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("found"))
    problem = F.when(F.col("length").isNull(), "missing").when(F.col("length") != F.col("bytes"), "size").when(F.col("found") != F.col("sha256"), "hash")
    return named.join(there, "name", "left").select("name", problem.alias("problem")).where("problem is not null")


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove data files that the manifest does not name: of failed tasks, and of what was overwritten. Not while a write runs."""
    kept = {f["name"] for f in manifest(spark, path)["files"]}
    gone = [n for n in tables.names(spark, path) if n.startswith("part-") and n not in kept]
    for name in gone:
        fs, p = tables._fs(spark, f"{path.rstrip('/')}/{name}")
        fs.delete(p, False)
    return len(gone)
