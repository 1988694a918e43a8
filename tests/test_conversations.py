import json

from pyspark.sql import functions as F

from tesserine.functions import text as tx
from tesserine.memory import Memory
from tesserine.plans import harness
from tesserine.streaming import changes


def test_ways_to_ask(spark, tmp_path):
    turns = harness.sessions(spark, 7, 3)
    told = harness.Conversations(Memory(spark, str(tmp_path / "c"), now=10))
    told.ingest(turns)
    assert told.memory.concepts.count() == 9 and told.memory.edges.count() >= 12
    ids = lambda rows: [r.id for r in rows.collect()]
    hits = ids(told.query("What is my home city", 3))
    assert hits and all(":home_city:" in i for i in hits)
    own = ids(told.query_in_session("What is my home city", "session-0001", 3))
    assert own[0] == "session-0001:home_city:v2" and all(i.startswith("session-0001:") for i in own)
    assert ids(told.query_in_session_association("What is my pet name", "session-0002", 2))[0] == "session-0002:pet_name:v2"
    assert ids(told.query_bm25("pet name", "session-0000", 2))[0] == "session-0000:pet_name:v2" and len(ids(told.query_bm25("pet name", None, 3))) == 3
    assert ids(told.query_bm25("zyzzyva", None, 3)) == [] == ids(told.query("zyzzyva quokka", 3))
    assert ids(told.query_bridge("My pet name", "session-0001", 2)) and told.query_history("session-0001:pet_name:v2", 5).count() == 1
    assert ids(told.query_hybrid("home city", None, 2)) == ids(told.query_association("home city", 2))
    harness.write_results(turns.limit(2).select("memory_id"), str(tmp_path / "out"))
    assert sum(len(f.read_text().splitlines()) for f in (tmp_path / "out").glob("*.json")) == 2


def test_a_small_session_is_not_crowded_out(spark, tmp_path):
    rows = [("big", f"big:t{i}:v1", "my home city is Oslo") for i in range(200)] + [("small", "small:t:v1", "the home city of mine")]
    told = harness.Conversations(Memory(spark, str(tmp_path / "s"), now=10))
    frame = spark.createDataFrame(rows, "session_id string, id string, searchable_text string")
    told.memory.upsert(frame.select("id", tx.encoder()(F.col("searchable_text")).alias("vector"), F.to_json(F.struct("searchable_text", "session_id")).alias("metadata")))
    for ask in (told.query_in_session, told.query_bm25):
        assert [r.id for r in ask("home city", "small", 2).collect()] == ["small:t:v1"]
    assert len(told.query_in_session("home city", "big", 3).collect()) == 3


def test_late_events_are_left_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = lambda *ts: "\n".join(json.dumps({"ts": t, "kind": "a"}) for t in ts)
    stream = spark.readStream.schema("ts timestamp, kind string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = str(tmp_path / "rows")
    kept = changes.counted(stream, late="10 minutes", width="1 hour").select(F.col("window.start").alias("at"), "n")

    def run():
        q = kept.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    (tmp_path / "in" / "1.json").write_text(lines("2024-01-01T00:10:00Z", "2024-01-01T00:50:00Z", "2024-01-01T03:00:00Z"))
    run()
    # the first hour is closed: what comes for it now is late
    (tmp_path / "in" / "2.json").write_text(lines("2024-01-01T00:20:00Z", "2024-01-01T03:10:00Z", "2024-01-01T09:00:00Z"))
    run()
    assert sorted((str(r.at), r.n) for r in spark.read.parquet(out).collect()) == [("2024-01-01 00:00:00", 2), ("2024-01-01 03:00:00", 2)]


def test_emitters(spark):
    from tesserine.sources import schemas

    rows = spark.createDataFrame([("Associated", "n", str(i), "b", 0.5, 10) for i in range(5)], schemas.EVENTS)
    seen = []
    changes.Emitter()(rows, 0)
    changes.LogEmitter(seen.append)(rows, 0)
    assert len(seen) == 5 and json.loads(seen[0])["specversion"] == "1.0"

    def post(texts):
        if len(texts) > 2:
            raise ValueError("too many")

    changes.PostEmitter(post, batch=2)(rows, 0)
