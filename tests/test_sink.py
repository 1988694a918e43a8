"""Exports through a sink that commits."""

import hashlib
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tesserine.sources import sink


def rows(spark, n=200):
    return spark.range(n, numPartitions=5).select(
        "id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("é"), F.col("id"))).alias("text"), F.array("id", F.lit(None)).alias("vector"), F.lit(datetime(2024, 5, 6)).alias("at"),
        F.col("id").cast("decimal(12,2)").alias("price"), F.struct(F.col("id").alias("a b")).alias("s"),
    )


def test_round_trip_and_manifest(spark, tmp_path):
    path = str(tmp_path / "out")
    told = sink.export(rows(spark), path, row_group_bytes=2000, compression="snappy")
    assert told["rows"] == 200 and len(told["files"]) == 5 and sum(f["rows"] for f in told["files"]) == 200
    for f in told["files"]:
        data = open(f"{path}/{f['name']}", "rb").read()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (f["bytes"], f["sha256"])
    back = sink.read(spark, path)
    assert back.schema.simpleString() == rows(spark).schema.simpleString()
    assert sorted(back.collect()) == sorted(rows(spark).collect())
    assert sink.damaged(spark, path).count() == 0


def test_a_failed_task_leaves_no_manifest(spark, tmp_path):
    path = str(tmp_path / "out")
    bad = rows(spark).withColumn("text", F.when(F.col("id") == 150, F.raise_error(F.lit("no"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no"):
        sink.export(bad, path)
    assert not os.path.exists(f"{path}/manifest.json")
    # what the failed write left is not seen by the next, and can be removed
    sink.export(rows(spark, 20), path)
    assert sink.read(spark, path).count() == 20
    sink.vacuum(spark, path)
    assert len([n for n in os.listdir(path) if n.endswith(".parquet") and not n.startswith(".")]) == len(sink.manifest(spark, path)["files"])


def test_overwriting_and_damage(spark, tmp_path):
    path = str(tmp_path / "out")
    sink.export(rows(spark), path)
    old = sink.read(spark, path)
    with pytest.raises(Exception, match="overwrite"):
        sink.export(rows(spark, 10), path)
    assert sink.read(spark, path).count() == 200
    sink.export(rows(spark, 10), path, overwrite=True)
    # a reader of the old manifest still finds its files
    assert old.count() == 200 and sink.read(spark, path).count() == 10
    assert sink.vacuum(spark, path) == 5 and sink.read(spark, path).count() == 10
    first, second, third = (f["name"] for f in sink.manifest(spark, path)["files"][:3])
    os.remove(f"{path}/{first}")
    with open(f"{path}/{second}", "ab") as f:
        f.write(b"x")
    with open(f"{path}/{third}", "r+b") as f:
        f.seek(10)
        f.write(b"\x00\xff")
    assert {r.name: r.problem for r in sink.damaged(spark, path).collect()} == {first: "missing", second: "size", third: "hash"}


def test_no_rows(spark, tmp_path):
    told = sink.export(rows(spark).where("false"), str(tmp_path / "out"))
    assert told["rows"] == 0 and told["files"] == [] and sink.read(spark, str(tmp_path / "out")).count() == 0
