"""Expiries and attempts over micro-batches, against the whole at once."""

import json

import pytest

from tesserine.streaming import timers


@pytest.fixture
def states(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timers.PROVIDER)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, folder, schema, make, batches):
    """Rows that a stream gives over batches, one file each; the query is started anew for each."""
    (folder / "in").mkdir()
    stream = spark.readStream.schema(schema).json(str(folder / "in"))
    for k, rows in enumerate(batches):
        (folder / "in" / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows))
        q = make(stream).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    return sorted(tuple(map(str, r)) for r in spark.read.parquet(str(folder / "out")).collect())


def at(minutes):
    return f"2024-01-01T{minutes // 60:02d}:{minutes % 60:02d}:00Z"


def test_expiries(spark, tmp_path, states):
    row = lambda id_, seq, now, due: {"namespace": "n", "id": id_, "seq": seq, "at": at(now), "expires_at": None if due is None else at(due)}
    batches = [
        [row("a", 1, 0, 10), row("b", 1, 0, 10), row("c", 1, 0, None), row("d", 1, 0, 20), row("e", 1, 1, 30)],
        # b lives longer, d is deleted, e's second write comes before its third
        [row("b", 2, 5, 60), row("d", 2, 5, None), row("e", 3, 6, 40), row("e", 2, 6, 15)],
        [row("x", 1, 50, None)],
        [row("late", 1, 2, 3), row("y", 1, 90, None)],
    ]
    schema = "namespace string, id string, seq long, at timestamp, expires_at timestamp"
    got = run(spark, tmp_path, schema, timers.expiries, batches)
    assert got == [("n", "a", "2024-01-01 00:10:00"), ("n", "b", "2024-01-01 01:00:00"), ("n", "e", "2024-01-01 00:40:00")]


def test_attempts(spark, tmp_path, states):
    row = lambda q, now, found=False, revision=1: {"namespace": "n", "query": q, "revision": revision, "at": at(now), "found": found}
    batches = [
        [row("a", 0), row("a", 1), row("b", 0), row("b", 1), row("c", 0), row("d", 0)],
        # a third attempt of a; b finds something in between; c is too slow; d's namespace changes
        [row("a", 2), row("b", 2, True), row("b", 3), row("b", 4), row("c", 4), row("d", 3, revision=2), row("d", 4, revision=2)],
        [row("c", 10), row("c", 11), row("a", 5)],
    ]
    schema = "namespace string, query string, revision long, at timestamp, found boolean"
    assert run(spark, tmp_path, schema, timers.silenced, batches) == [("n", "a", "3", "2024-01-01 00:02:00")]
