import pytest
from pyspark.sql import functions as F

from tesserine.functions import embedding
from tesserine.plans import harness


def test_benchmark(spark):
    got = {r.task_type: r for r in harness.run(spark, n=5).collect()}
    assert got["recall"].cases == 15 and got["recall"].reciprocal_rank == 1.0
    assert got["abstain"].abstain_recall == 1.0


def test_links_and_versions(spark):
    turns = harness.sessions(spark, 1, 2)
    assert harness.latest(turns).count() == 6
    assert harness.neighbour_links(turns).count() == 2 * 2 * 5
    links = harness.overlap_links(turns).collect()
    assert links and all(0.15 < e.strength <= 0.5 and e.from_id[:12] != e.to_id[:12] for e in links)
    row = spark.createDataFrame([("a:v2",), ("a:v1",), ("a",)], "i string").select(harness.previous_version(F.col("i")).alias("p")).collect()
    assert [r.p for r in row] == ["a:v1", None, None]
    made = harness.predicted(harness.answers(turns, harness.cases(turns)), turns)
    assert made.where("task_type = 'recall' and not exact_match").count() == 0


def test_providers(spark):
    rows = spark.createDataFrame([("hello world",), ("",)], "t string")
    hdc = embedding.get_provider("hdc-text")
    made = hdc.embed(rows, "t").select("t", F.size("embedding").alias("n"), hdc.project(F.col("embedding")).alias("v"), embedding.encoder()(F.col("t")).alias("e")).collect()
    assert all(r.n == 10_240 and r.v == r.e for r in made)
    client = embedding.get_provider("fastembed:x", lambda ts: [[float(len(t)), 1.0] for t in ts], 2)
    assert [list(r.embedding) for r in client.embed(rows, "t").collect()] == [[11.0, 1.0], [0.0, 1.0]]
    for bad in ("openai", "other"):
        with pytest.raises(ValueError, match="client|unknown"):
            embedding.get_provider(bad)
