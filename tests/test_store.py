"""Commits of several tables, concurrent writers, reads that leave wide columns alone, and the change feed."""

import threading

import pytest
from pyspark.sql import functions as F

from tesserine.functions import hypervector as hv
from tesserine.memory import Memory
from tesserine.sources import schemas, tables

SCHEMA = schemas.ANALYTICS["associations"]
KEYS = ["src_id", "dst_id"]


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def read(store):
    return {(r.src_id, r.dst_id): r.strength for r in store.read("e", SCHEMA, KEYS).collect()}


def test_nothing_counts_before_the_commit_and_all_after(spark, tmp_path):
    s = tables.Store(spark, str(tmp_path / "s"))
    s.upsert("e", frame(spark, ("a", "b", 0.1), ("b", "c", 0.2)))
    with pytest.raises(ZeroDivisionError), s.commit() as c:
        c.delete("e", frame(spark, ("a", "b", None)))
        c.upsert("e", frame(spark, ("x", "y", 0.5)))
        assert read(s) == {("a", "b"): 0.1, ("b", "c"): 0.2}
        1 / 0
    assert read(s) == {("a", "b"): 0.1, ("b", "c"): 0.2} and s.state()["n"] == 1
    with s.commit() as c:
        c.delete("e", frame(spark, ("a", "b", None)))
        c.upsert("e", frame(spark, ("x", "y", 0.5), ("x", "y", 0.4)), KEYS)
        c.count("ns")
    assert read(s) == {("b", "c"): 0.2, ("x", "y"): 0.4} and s.counter("ns") == 1 and s.revision("e") == 2


def test_writers_at_once_lose_no_count(spark, tmp_path):
    def run(k):
        own = tables.Store(spark, str(tmp_path / "s"))
        for i in range(6):
            with own.commit() as c:
                c.count("ns")
                if i == k:
                    c.upsert("e", frame(spark, (f"{k}", f"{i}", 1.0)))

    threads = [threading.Thread(target=run, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    s = tables.Store(spark, str(tmp_path / "s"))
    assert s.counter("ns") == 24 == s.state()["n"] and len(read(s)) == 4


def test_a_change_in_between_is_told(spark, tmp_path):
    s = tables.Store(spark, str(tmp_path / "s"))
    s.upsert("e", frame(spark, ("a", "b", 0.1)))
    n = s.state()["n"]
    s.upsert("e", frame(spark, ("c", "d", 0.1)))
    with pytest.raises(tables.ConcurrentWrite), s.commit(read_at=n) as c:
        c.upsert("e", frame(spark, ("a", "b", 0.9)))
    assert read(s) == {("a", "b"): 0.1, ("c", "d"): 0.1}


def test_a_claim_whose_writer_is_gone(spark, tmp_path):
    s = tables.Store(spark, str(tmp_path / "s"), claim_seconds=0.2)
    s.upsert("e", frame(spark, ("a", "b", 0.1)))
    (tmp_path / "s/commits/2.claim0").touch()
    assert s.upsert("e", frame(spark, ("a", "b", 0.2))) == 2 and read(s) == {("a", "b"): 0.2}


def test_sums_merges_and_bases(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables.Store, "STATE_EVERY", 8)
    s = tables.Store(spark, str(tmp_path / "s"))
    s.upsert("e", frame(spark, *[(f"n{i:03d}", "x", 0.0) for i in range(100)]))
    s.compact("e", SCHEMA, KEYS)
    for i in range(20):
        s.upsert("e", frame(spark, (f"n{i % 10:03d}", "x", float(i))))
        s.tidy("e", SCHEMA, KEYS)
    s.delete("e", frame(spark, ("n050", "x", None)))
    own = s.state()["tables"]["e"]
    assert own["base"][1] == 100 and len(own["logs"]) < s.MOST_LOGS  # logs were merged, the base was left alone
    expected = {(f"n{i:03d}", "x"): float(10 + i) if i < 10 else 0.0 for i in range(100) if i != 50}
    assert read(s) == expected
    assert len(s._names("commits")) < 4 * 8
    fresh = tables.Store(spark, s.root)
    assert read(fresh) == expected and fresh.revision("e") == s.revision("e")
    s.compact("e", SCHEMA, KEYS)
    before = len(s._names("e"))
    s.vacuum("e")
    assert read(s) == expected and len(s._names("e")) == 1 < before
    s.upsert("e", frame(spark, ("late", "x", 1.0)))
    old = s.state()
    s.compact("e", SCHEMA, KEYS)
    with pytest.raises(tables.ConcurrentWrite):  # made from what another writer has merged meanwhile
        s._merge("e", SCHEMA, KEYS, old, "base")
    assert read(s)[("late", "x")] == 1.0


def test_reads_shuffle_no_vector(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"), now=1)
    rows = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("id"), hv.seeded(F.col("id")).alias("vector"), F.lit("{}").alias("metadata"))
    m.upsert(rows(0, 50))
    m.store.compact("concepts", m.SCHEMAS["concepts"], m.KEYS["concepts"])
    m.upsert(rows(45, 60))
    m.delete("3", "55")
    plan = m.concepts._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan.splitlines() if "Exchange" in x]
    assert lines and "SortMergeJoin" not in plan
    whole = m.concepts.select("id", "vector").orderBy("id").collect()
    assert len(whole) == 58
    # what is dealt out are keys and numbers
    for node in plan.split("Exchange")[1:]:
        assert "vector" not in node.split("Scan")[0]


def test_small_writes_keep_reads_bounded(spark, tmp_path):
    s = tables.Store(spark, str(tmp_path / "s"))
    for i in range(60):
        s.upsert("e", frame(spark, (f"{i % 7}", "x", float(i))))
        s.tidy("e", SCHEMA, KEYS)
    own = s.state()["tables"]["e"]
    assert len(own["logs"]) + bool(own["base"]) <= s.MOST_LOGS and len(read(s)) == 7
    assert len(s.read("e", SCHEMA, KEYS).inputFiles()) <= 2 * s.MOST_LOGS


def drained(spark, stream, folder, out):
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", folder).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def test_change_feed_once_over_a_restart(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"), now=7)
    ones = lambda *ids: spark.createDataFrame([(i, [1], "{}") for i in ids], "id string, vector array<long>, metadata string")
    m.upsert(ones("a", "b", "c"))
    m.associate([("a", "b", 0.5)])
    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    assert drained(spark, m.changes(), state, out).count() == 4
    m.upsert(ones("b", "d"))
    m.disassociate("a", "b")
    m.delete("c")
    # a writer that was lost after its commit: its events show with the next commit
    with m.store.commit() as c:
        c.events(m._events(ones("e"), "ConceptInjected", "id"))
        real, m.store.release = m.store.release, lambda: None
    m.store.release = real
    # and one that was lost before it: never
    m.store.written("staged", m._events(ones("never"), "ConceptInjected", "id"))
    m.upsert(ones("f"))
    rows = drained(spark, m.changes(), state, out)
    got = [(r.kind, r.id, r.other_id, r.score, r.at) for r in rows.orderBy("commit", "id").collect()]
    assert got == [
        ("ConceptInjected", "a", None, None, 7), ("ConceptInjected", "b", None, None, 7), ("ConceptInjected", "c", None, None, 7), ("Associated", "a", "b", 0.5, 7),
        ("ConceptUpdated", "b", None, None, 7), ("ConceptInjected", "d", None, None, 7), ("Disassociated", "a", "b", None, 7), ("ConceptDeleted", "c", None, None, 7),
        ("ConceptInjected", "e", None, None, 7), ("ConceptInjected", "f", None, None, 7),
    ]
