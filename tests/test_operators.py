import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.functions import hypervector as hv
from tesserine.operators import analytics, bridge, filters, fusion, graph, keyword, lifecycle, search
from tesserine.sources import readers, schemas, tables, writers
from tesserine.streaming import changes, reservoir


def test_filters(spark):
    rows = spark.createDataFrame([(1, '{"a": 1, "b.c": null}'), (2, '{"a": "1"}'), (3, "{}"), (4, None), (5, '{"a": [1, {"y": 2, "x": 1}]}')], "id int, metadata string")
    ids = lambda f: sorted(r.id for r in rows.where(f.column(F.col("metadata"))).collect())
    assert ids(filters.eq("a", 1)) == [1]
    assert ids(filters.eq("a", "1")) == [2]
    assert ids(filters.eq("b.c", None)) == [1] and ids(filters.exists("b.c")) == [1]
    assert ids(filters.not_(filters.eq("a", 1))) == [2, 3, 4, 5]
    assert ids(filters.eq("a", [1, {"x": 1, "y": 2}])) == [5]
    assert ids(filters.and_()) == [1, 2, 3, 4, 5] and ids(filters.or_()) == []
    assert ids(filters.from_json('{"Or": [{"In": ["a", ["1", 7]]}, {"Not": {"Exists": "a"}}]}')) == [2, 3, 4]
    deep = filters.exists("a")
    for _ in range(32):
        deep = filters.not_(deep)
    with pytest.raises(ValueError, match="deep"):
        deep.validate()


def test_lsh_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2, (20, 256), np.uint8)
    bits = np.concatenate([centres ^ (rng.random((20, 256)) < 0.04) for _ in range(20)]).astype(np.uint8)
    words = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
    rows = spark.createDataFrame([(i, [int(w) for w in v]) for i, v in enumerate(words)], "id long, vector array<long>")
    index = search.LshIndex(tables=16, hash_bits=10, bits=256)
    keys = index.keys(rows).cache()
    found = total = 0
    for q in range(0, 400, 80):
        query = [int(w) for w in words[q]]
        exact = {r.id for r in search.probe(rows, query, 10).collect()}
        found += len(exact & {r.id for r in index.search(rows, keys, query, 10).collect()})
        total += 10
    assert found / total >= 0.9


def test_lsh_filtered_exactly_where_buckets_hold_enough(spark):
    # a table of one bit: the nearest rows differ in that bit, the farther ones share the bucket
    index = search.LshIndex(tables=1, hash_bits=1, bits=64)
    place = index.places[0][0]
    near = 1 << place
    far = sum(1 << p for p in [p for p in range(62) if p != place][:5])
    signed = lambda w: w - (1 << 64) if w >> 63 else w
    rows = spark.createDataFrame([(i, [signed(near if i % 2 else far)], '{"a": 1}') for i in range(20)], "id long, vector array<long>, metadata string")
    ids = lambda exact: [r.id for r in index.search_filtered(rows, index.keys(rows), [0], 4, filters.eq("a", 1), exact).collect()]
    assert ids(False) == [0, 2, 4, 6] and ids(True) == [1, 3, 5, 7]


def test_lsh_recall_of_the_registered_index(spark, sf):
    from tesserine.plans import memory

    rows = memory.sketches(spark, sf).cache()
    keys = memory._LSH.keys(rows).cache()
    words = {r.id: list(r.vector) for r in rows.collect()}
    found = total = 0
    for q in range(0, 500, 50):
        exact = {r.id for r in search.probe(rows, words[q], 10).collect()}
        found += len(exact & {r.id for r in memory._LSH.search(rows, keys, words[q], 10, flips=1).collect()})
        total += 10
    assert found / total >= 0.9


def test_bucket_widths_and_presets():
    assert search.bucket_width(2, 200_000, 1000) == 8 and search.bucket_width(12, 10, 1000) == 12 and search.bucket_width(1, 1 << 40, 1) == 16
    assert search.filter_strategy(10, 9) == "Pre" and search.filter_strategy(100, 50) == "BucketPost" and search.filter_strategy(100, 90) == "ScanPost"
    assert search.preset(2) != search.preset(9)


def test_bm25_changes(spark):
    docs = spark.createDataFrame([("a", ["x", "y", "x"]), ("b", ["y"]), ("c", [])], "id string, tokens array<string>")
    index = keyword.Bm25.build(docs, F.col("tokens"))
    assert [r.id for r in index.search(["x", "x"], 5).collect()] == ["a"]
    more = index.add(spark.createDataFrame([("b", ["x", "z"])], "id string, tokens array<string>"), F.col("tokens"))
    assert {r.id for r in more.search(["x"], 5).collect()} == {"a", "b"}
    assert [r.id for r in more.remove(spark.createDataFrame([("a",)], "id string")).search(["x"], 5).collect()] == ["b"]
    assert not index.overlaps(["q"]) and index.overlaps(["y"]) and index.clear().search(["x"], 5).count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([("x", 3.0), ("y", 1.0)], "id string, score double")
    b = spark.createDataFrame([("y", 5.0), ("z", 5.0)], "id string, score double")
    got = {r.id: r.score for r in fusion.merge(a, b, (0.5, 0.5), 10).collect()}
    assert got == {"x": 0.5, "y": 0.5, "z": 0.5}
    assert fusion.merge(a, b, (0.5, 0.5), 0).count() == 0
    assert [fusion.weights(n) for n in (0, 1, 4, 8, 9)] == [(0.2, 0.8), (0.9, 0.1), (0.7, 0.3), (0.4, 0.6), (0.2, 0.8)]
    for bad in ("mmr:2", "recency:30", "other"):
        with pytest.raises(ValueError, match="reranker"):
            fusion.parse_rerankers(bad)
    assert len(fusion.parse_rerankers("mmr:0.5, recency:30d:0.4")) == 2


def test_mmr_prefers_what_is_different(spark):
    rows = spark.createDataFrame([("a", 0.9, [0]), ("b", 0.89, [0]), ("c", 0.5, [-1])], "id string, score double, vector array<long>")
    assert [r.id for r in fusion.mmr(rows, 0.5, 3).orderBy("rank").collect()] == ["a", "c", "b"]
    assert [r.id for r in fusion.mmr(rows, 1.0, 2).orderBy("rank").collect()] == ["a", "b"]


EDGES = [("a", "b", 0.9), ("b", "c", 0.9), ("a", "c", 0.5), ("c", "a", 0.4), ("c", "d", 0.0), ("x", "y", 1.0)]


@pytest.fixture
def edges(spark):
    return spark.createDataFrame([(*e, 0) for e in EDGES], "from_id string, to_id string, strength double, created_at long")


def test_graph(edges):
    reach = lambda **k: {r.id: r.depth for r in graph.bfs(edges, "a", graph.Traversal(**k)).collect()}
    assert reach() == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert reach(min_strength=0.6) == {"a": 0, "b": 1, "c": 2}
    assert reach(max_depth=0) == {"a": 0}
    assert graph.shortest_path(edges, "a", "c").first().path == ["a", "b", "c"]
    assert graph.shortest_path_hops(edges, "a", "c").first().path == ["a", "c"]
    assert graph.shortest_path(edges, "a", "c", graph.Traversal(max_depth=1)).first().path == ["a", "c"]
    assert graph.shortest_path(edges, "a", "y").count() == 0
    assert graph.shortest_path(edges, "a", "a").first().path == ["a"]


def test_graph_rag(spark, edges):
    similar = spark.createDataFrame([("a", 1.0), ("b", 0.2), ("c", 0.1), ("d", 0.9)], "id string, score double")
    got = {r.id: r for r in graph.graph_rag(similar, edges, anchors=1, hops=2, least=0.1, k=10).collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["a"].hop_distance == 0 and got["b"].score == pytest.approx(0.6 * 0.2 + 0.4 * 0.9 / 2)
    assert got["c"].score == pytest.approx(max(0.06 + 0.4 * 0.5 / 2, 0.06 + 0.4 * 0.9 / 3))


def test_lifecycle(spark, edges):
    ids = spark.createDataFrame([(i,) for i in "abcd"], "id string")
    good, bad = lifecycle.associated(edges.limit(0), spark.createDataFrame([("a", "b", 0.5), ("a", "q", 0.5), ("a", "c", 1.5), ("a", "d", None)], "from_id string, to_id string, strength double"), ids, 9)
    assert good.count() == 1 and bad.count() == 3
    v = spark.createDataFrame([("a", n, [n], json.dumps({"k": n, "s": 1} if n == 1 else {"k": n, "t": 2}), 5) for n in (1, 2)], "concept_id string, version long, vector array<long>, metadata string, modified_at long")
    d = lifecycle.diff(v, "a", 1, 2, 1).first()
    assert dict(d.added) == {"t": "2"} and dict(d.removed) == {"s": "1"} and list(d.changed) == ["k"] and d.vector_cosine_distance == pytest.approx(2 / 32)
    assert lifecycle.rolled_back(v, "a", 1, 77).where("version = 3").first().modified_at == 77
    assert lifecycle.retained(v, 1).first().version == 2
    c, e, w = lifecycle.deleted(ids, edges, v, spark.createDataFrame([("a",)], "id string"))
    assert c.count() == 3 and e.count() == 3 and w.count() == 0


def test_absences(spark):
    from datetime import datetime, timedelta

    now = datetime(2024, 1, 1, 12)
    row = lambda n, rev, best: ("q", "Q", "q", n, 0.5, best, now, now, "ns", rev)
    frame = lambda *rows: spark.createDataFrame(list(rows), schemas.ABSENCES)
    merged = lifecycle.absences_merged(frame(row(2, 7, 0.3)), frame(row(1, 7, 0.2)))
    assert merged.first().attempt_count == 3 and merged.first().best_score_ever == 0.3
    assert lifecycle.absences_merged(frame(row(2, 7, 0.3)), frame(row(1, 8, 0.2))).first().attempt_count == 1
    at = lambda s: F.lit(now + timedelta(seconds=s))
    assert lifecycle.short_circuits(merged, "ns", 7, at(299)).count() == 1
    assert lifecycle.short_circuits(merged, "ns", 7, at(300)).count() == 0 and lifecycle.short_circuits(merged, "ns", 8, at(1)).count() == 0


def test_read_only(spark):
    assert analytics.read_only(spark, " WITH a AS (SELECT 1 AS x) SELECT x FROM a;").first().x == 1
    assert analytics.read_only(spark, "select ';' as x").first().x == ";"
    for sql in ("DROP TABLE x", "SELECT 1; DROP TABLE x", "", "insert into t select 1"):
        with pytest.raises(ValueError, match="SELECT"):
            analytics.read_only(spark, sql)


def test_index_percentile(spark):
    got = spark.range(1).select(analytics.index_percentile(F.array(*[F.lit(i) for i in range(10)]), 0.95).alias("p")).first().p
    assert got == 8


def test_packet_skips_what_is_too_long(spark):
    hits = spark.createDataFrame([("a", 0.9), ("b", 0.8), ("c", 0.7), ("d", 0.6)], "id string, final_score double")
    facts = spark.createDataFrame([("a", "one two three"), ("b", "w " * 50), ("c", "one two three"), ("d", "four")], "id string, text string")
    p = bridge.packet(hits, facts, budget=8).first()
    assert p.facts == ["one two three", "four"] and p.tokens == 6
    assert p.confidence == pytest.approx((0.9 + 0.8 + 0.6) / 3)


def test_store(spark, tmp_path):
    s = tables.Store(spark, str(tmp_path / "store"))
    schema = schemas.ANALYTICS["associations"]
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    read = lambda st=s: {(r.src_id, r.dst_id): r.strength for r in st.read("associations", schema, ["src_id", "dst_id"]).collect()}
    assert read() == {} and s.revision("associations") == 0
    s.upsert("associations", frame(("a", "b", 0.1), ("b", "c", 0.2)))
    s.upsert("associations", frame(("a", "b", 0.9)))
    s.delete("associations", frame(("b", "c", None)))
    assert read() == {("a", "b"): 0.9} and s.revision("associations") == 3
    s.backup(str(tmp_path / "copy"))
    s.compact("associations", schema, ["src_id", "dst_id"])
    assert read() == {("a", "b"): 0.9}
    s.drop("associations")
    assert read() == {}
    s.restore(str(tmp_path / "copy"))
    assert read() == {("a", "b"): 0.9}


def test_readers(spark, tmp_path):
    (tmp_path / "export.json").write_text(json.dumps({"version": "1", "exported_at": 1, "concepts": [{"id": "a", "text": "old", "created_at": 3}, {"id": "a", "metadata": '{"text": "new"}', "created_at": 4}], "associations": [["a", "b", 0.25]]}))
    concepts, edges = readers.load_export(spark, str(tmp_path / "export.json"))
    assert [(r.text, r.namespace, r.updated_at_us) for r in concepts.collect()] == [("new", "default", 4)]
    assert edges.first().strength == 0.25
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs/suite1.jsonl").write_text('{"query_id": "q1", "latency_ms": 1.5}\n\n')
    assert [(r.suite, r.name, r.p50_us) for r in readers.load_benchmarks(spark, str(tmp_path / "runs")).collect()] == [("suite1", "q1", 1500.0)]
    assert readers.load_benchmarks(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "lines.jsonl").write_text('{"text": "hello", "k": "id9", "t": "a, b,"}\nbad\n')
    kept, skipped = readers.index_lines(readers.read_lines(spark, str(tmp_path / "lines.jsonl")), id_field="k", tag_field="t")
    assert [(r.id, r.line, r.tags) for r in kept.collect()] == [("id9", 1, ["a", "b"])] and skipped.first().skipped == 1
    db = sqlite3.connect(tmp_path / "old.db")
    db.execute("create table concepts (id text, metadata text, created_at int, modified_at int, expires_at int)")
    db.execute("create table associations (from_id text, to_id text, strength real)")
    db.executemany("insert into concepts values (?, '{\"text\": \"t\"}', 1, 2, null)", [("a",), ("b",)])
    db.execute("insert into associations values ('a', 'b', 0.5)")
    db.commit()
    c, e = readers.attach_sqlite(spark, str(tmp_path / "old.db"))
    assert {(r.id, r.text, r.namespace) for r in c.collect()} == {("a", "t", "default"), ("b", "t", "default")} and e.first().strength == 0.5


def test_chunks(spark):
    md = "intro\n# Top\ntext\n## One\n\nbody 1\nmore\n## Empty\n\n### Deep\nx\n#nothing\n"
    got = readers.chunks_by_heading(spark.createDataFrame([("f.md", md)], "path string, value string")).collect()
    assert [(r.level, r.heading, r.content) for r in got] == [(2, "One", "body 1\nmore"), (3, "Deep", "x\n#nothing")]


def test_writers(spark, tmp_path):
    t = {"associations": spark.createDataFrame([("b", "c", 0.5), ("a", "c", 0.1)], schemas.ANALYTICS["associations"])}
    text = json.loads(writers.export_all(t, str(tmp_path)))
    assert text["files"]["associations"]["rows"] == 2 and len(text["files"]["associations"]["sha256"]) == 64
    with pytest.raises(ValueError, match="column"):
        writers.export_parquet(t["associations"], "associations", str(tmp_path / "x"), partition_by="a; drop")
    assert writers.unpack_binary(writers.pack_binary([{"id": "a"}])) == [{"id": "a"}]
    for bad in ("../x", "a'b"):
        with pytest.raises(ValueError, match="not allowed"):
            schemas.validate_analytics_path(bad)


def test_change_feed(spark, tmp_path):
    rows = spark.createDataFrame([("Associated", "n", "a", "b", 0.5, 10), ("ConceptDeleted", "n", "a", None, None, 11)], schemas.EVENTS)
    rows.write.parquet(str(tmp_path / "log"))
    seen = []
    q = changes.watch(changes.subscribe(spark, str(tmp_path / "log")), lambda df, _: seen.extend(changes.cloud_events(df, "here").collect()), str(tmp_path / "cp"), "Associated")
    q.awaitTermination()
    event = json.loads(seen[0].event)
    assert len(seen) == 1 and event["type"] == "memory.associated" and event["specversion"] == "1.0" and event["data"]["other_id"] == "b"
    with pytest.raises(ValueError, match="kind"):
        changes.of_kind("x")


def test_reservoir(spark):
    r = reservoir.Reservoir(2, 1024, seed=1)
    assert r.radius() == pytest.approx(0.95, rel=0.2)
    a = r.run(np.ones((40, 2)))[-1].copy()
    r.reset()
    assert (r.run(np.ones((40, 2)))[-1] == a).all()
    with pytest.raises(ValueError, match="too small"):
        r.words()
    rows = spark.createDataFrame([(k, i, [float(k), 1.0]) for k in (1, 2) for i in range(5)], "k int, i int, f array<double>")
    got = {x.k: x for x in reservoir.encode_series(rows, "k", "i", "f", 2).collect()}
    assert got[1].steps == 5 and got[1].vector != got[2].vector and len(got[1].vector) == hv.WORDS


def test_long_series_are_stepped_whole(spark, tmp_path):
    from tesserine.plans import memory

    # one user with a third of all rows, more than the default limit and than a batch of Arrow
    n = 12_000
    at = F.timestamp_seconds(F.col("id") * 7919 % (3 * n))
    events = spark.range(3 * n).select(F.col("id").alias("event_id"), at.alias("ts"), F.when(F.col("id") < n, -1).otherwise(F.col("id") % 400).cast("long").alias("user_id"), (F.col("id") % 97).cast("double").alias("value"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = {r.user_id: r for r in memory.QUERIES["e8_reservoir_sequence"](spark, str(tmp_path)).collect()}
    assert len(got) == 401 and got[-1].steps == n and sum(r.steps for r in got.values()) == 3 * n
    own = events.where("user_id = -1").orderBy("ts", "event_id").collect()
    r = reservoir.Reservoir(1)
    settled = sum(r.step(np.array([x.value / 100])) < reservoir.SETTLED for x in own)
    assert (got[-1].weight, got[-1].settled) == (int(np.bitwise_count(r.words().view(np.uint64)).sum()), settled)
    rows = spark.createDataFrame([(k, i, [1.0]) for k in (1, None) for i in range(5)], "k int, i int, f array<double>")
    assert {(x.k, x.steps) for x in reservoir.encode_series(rows, "k", "i", "f", 1, longest=5).collect()} == {(1, 5), (None, 5)}
    with pytest.raises(Exception, match="at most 4 steps"):
        reservoir.encode_series(rows, "k", "i", "f", 1, longest=4).collect()


def test_states_of_long_series_stay_finite():
    series = [np.array([(i * 7919 % 97) / 100]) for i in range(5000)]
    r, wide = reservoir.Reservoir(1), reservoir.Reservoir(1)
    # the same steps in numbers of a wider range
    wide.state = wide.state.astype(np.longdouble)
    for v in series:
        assert not np.isnan(r.step(v))
    assert np.isfinite(r.state).all() and r.shift > 0
    for v in series:
        i = np.arange(wide.phase, wide.size, reservoir.STRIDE)
        drive = (wide.in_weight[i] * v[wide.in_at[i]]).sum(axis=1) + (wide.weight[i] * wide.state[wide.at[i]]).sum(axis=1)
        new = wide.state.copy()
        new[i] = reservoir.LEAK * reservoir.squash(drive) + (1 - reservoir.LEAK) * wide.state[i]
        wide.state, wide.phase = new, (wide.phase + 1) % reservoir.STRIDE
    assert ((wide.state > 0) == (r.state > 0)).mean() > 0.999
