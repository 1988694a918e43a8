"""Derived tables that are kept: built once for a state of their source and read by every later query."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import checkpoint_dir


def source_state(spark: SparkSession, *paths: str) -> str:
    """Names, sizes and times of all files below some paths, at any depth; it changes when a source does."""
    state = []
    for path in paths:
        fs, p = _fs(spark, path)
        files = fs.listFiles(p, True)
        while files.hasNext():
            s = files.next()
            state.append(f"{s.getPath()}:{s.getLen()}:{s.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(state)).encode()).hexdigest()[:32]


def kept(spark: SparkSession, name: str, state: str, build: Callable[[], DataFrame], by: list[str] | None = None, folder: str | None = None, parts: int | None = None) -> DataFrame:
    """The table ``name`` of a source's state, from ``folder`` or the application's part of the shared folder; built if
    it isn't there.

    With ``by`` its rows are clustered by those columns, in ``parts`` if given, so that a filter on them reads few row groups. It is written aside
    and appears by a rename, so sessions that build it at once don't delete under each other.
    """
    path = f"{folder or _own(spark)}/{name}-{state}"
    fs, mark = _fs(spark, f"{path}/_SUCCESS")
    if not fs.exists(mark):
        rows = build()
        if by:
            rows = (rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)).sortWithinPartitions(*by)
        aside = f"{path}.{uuid.uuid4().hex}"
        rows.write.parquet(aside)
        fs, made = _fs(spark, aside)
        target = mark.getParent()
        if fs.exists(target) and not fs.exists(mark):  # a part that an older version left
            fs.delete(target, True)
        if fs.exists(mark) or not fs.rename(made, target):
            fs.delete(made, True)
    return spark.read.parquet(path)


def _own(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/kept/{spark.sparkContext.applicationId}"


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def forget(spark: SparkSession, folder: str | None = None) -> None:
    """Drop all kept tables of a folder, or of the application."""
    fs, p = _fs(spark, folder or _own(spark))
    fs.delete(p, True)
