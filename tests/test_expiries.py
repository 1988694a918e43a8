"""Expiries of many rows that share a part of the state."""

import pytest

from tesserine.streaming import timers

from .test_timers import at, run, states  # noqa: F401


@pytest.mark.parametrize("buckets", [1, 3])
def test_rows_of_a_bucket(spark, tmp_path, states, buckets):  # noqa: F811
    row = lambda id_, seq, now, due: {"namespace": "n", "id": id_, "seq": seq, "at": at(now), "expires_at": None if due is None else at(due)}
    batches = [
        # many rows of one time, one of the watermark's own time, one whose time has passed when it is written
        [*(row(f"m{i}", 1, 0, 10 + i % 3) for i in range(40)), row("edge", 1, 0, 20), row("past", 1, 20, 5)],
        [row("m0", 2, 21, 30), row("m1", 2, 21, None), row("edge", 2, 21, 60)],
        # a row that was told lives again, with the same time as before and with another
        [row("m2", 2, 40, 12), row("m3", 2, 40, 45), row("x", 1, 50, None)],
        [row("y", 1, 90, None)],
    ]
    schema = "namespace string, id string, seq long, at timestamp, expires_at timestamp"
    got = run(spark, tmp_path, schema, lambda w: timers.expiries(w, buckets=buckets), batches)
    m = lambda i, t: ("n", f"m{i}", f"2024-01-01 00:{t}:00")
    told = [m(i, 10 + i % 3) for i in range(40)] + [m(0, 30), m(2, 12), m(3, 45), ("n", "edge", "2024-01-01 00:20:00"), ("n", "past", "2024-01-01 00:05:00"), ("n", "edge", "2024-01-01 01:00:00")]
    assert got == sorted(told)


def test_state_is_kept_by_bucket(spark, tmp_path, states):  # noqa: F811
    schema = "namespace string, id string, seq long, at timestamp, expires_at timestamp"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text("\n".join(f'{{"namespace": "n", "id": "{i}", "seq": 1, "at": "{at(0)}", "expires_at": "{at(9)}"}}' for i in range(500)))
    q = timers.expiries(spark.readStream.schema(schema).json(str(tmp_path / "in")), buckets=8).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    most = max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"])
    assert 8 <= most <= 24
