import base64
import json

import pytest
from pyspark.sql import functions as F

from tesserine.functions import hypervector as hv
from tesserine.functions import text as tx
from tesserine.memory import Memory, execute_tool, main, parse_vector, read_resource, run_analytics
from tesserine.operators import filters, hnsw, lifecycle, retrieval


def words(text):
    return [int(w) for w in tx.encode_text(text)]


@pytest.fixture(scope="module")
def memory(spark, tmp_path_factory):
    m = Memory(spark, str(tmp_path_factory.mktemp("m") / "store"), now=1000)
    names = ["color", "hue", "cat", "dog", "bird"]
    rows = spark.createDataFrame([(n, f"the {n} text", json.dumps({"searchable_text": f"the {n} text", "kind": "animal" if i > 1 else "word"})) for i, n in enumerate(names)], "id string, text string, metadata string")
    m.upsert(rows.select("id", tx.encoder()(F.col("text")).alias("vector"), "metadata"))
    m.associate([("cat", "dog", 0.9), ("dog", "bird", 0.5)])
    return m


def test_updates(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "u"), now=5)
    m.inject_text("a", "one two", {"x": 1})
    assert m.namespace_revision() == 1
    m.update_metadata("a", {"y": 2})
    assert json.loads(m.get("a")["metadata"]) == {"y": 2}
    m.update("a", metadata={"z": [1, "q"], "y": 3}, merge=True)
    assert json.loads(m.get("a")["metadata"]) == {"y": 3, "z": [1, "q"]}
    m.update_vector("a", words("three"))
    assert m.get("a")["vector"] == [w - (1 << 64) if w >= 1 << 63 else w for w in words("three")]
    assert m.namespace_revision() == 4 and m.version("a", 2)["metadata"] == '{"y": 2}' and m.version("a", 9) is None
    with pytest.raises(KeyError):
        m.update("nobody", metadata={})
    assert m.associate_batch([("a", "a", 0.5), ("a", "nobody", 0.5), ("a", "a", 7.0)]) == {"created": 1, "failed": 2}
    assert execute_tool(m, "memory_associations", {"id": "a"}) == [{"to_id": "a", "strength": 0.5}]
    m.clear_associations("a")
    assert m.edges.count() == 0
    with pytest.raises(ValueError, match="confirmed"):
        execute_tool(m, "memory_rollback", {"id": "a", "version": 1})


def test_namespaces_and_imports(spark, tmp_path, memory, monkeypatch):
    # paths are allowed below the working folder
    monkeypatch.chdir(tmp_path)
    folder = tmp_path
    memory.export_json(str(folder / "all.json"))
    memory.export_binary(str(folder / "all.bin"))
    for name in ("all.json", "all.bin"):
        m = Memory(spark, str(folder / name.replace(".", "_")), now=7)
        assert m.import_file(str(folder / name)) == 5
        assert m.edges.count() == 2 and m.probe(words("the cat text"), 1).first().id == "cat"
        assert m.get("cat")["created_at"] == 1000
    only = spark.createDataFrame([("cat", [1] * hv.WORDS, "{}"), ("new", [2] * hv.WORDS, "{}")], "id string, vector array<long>, metadata string")
    ways = spark.createDataFrame([("new", "dog", 0.5)], "from_id string, to_id string, strength double")
    with pytest.raises(ValueError, match="dangling"):
        m.replace_namespace(only, ways)
    assert m.concepts.count() == 5
    m.merge_namespace(only, ways)
    assert m.concepts.count() == 6 and m.edges.count() == 3 and m.get("cat")["created_at"] == 1000 and m.get("new")["created_at"] == 7
    m.replace_namespace(only, ways.limit(0))
    assert {r.id for r in m.concepts.collect()} == {"cat", "new"} and m.edges.count() == 0
    other = Memory(spark, m.store.root, "other", now=7)
    other.inject_text("x", "y")
    m.load_merge(memory)
    assert m.concepts.count() == 6 and m.get("cat")["vector"] == [1] * hv.WORDS
    before = m.namespace_revision()
    assert m.delete_namespace() == 6 and m.concepts.count() == 0 and m.namespace_revision() == before + 1 and other.concepts.count() == 1
    m.clear_all()
    assert other.concepts.count() == 0
    with pytest.raises(FileNotFoundError):
        m.import_json(str(folder / "none.json"))
    (folder / "bad.bin").write_bytes(b"nothing")
    with pytest.raises(ValueError, match="payload"):
        m.import_binary(str(folder / "bad.bin"))


def test_cascade_cache_and_metrics(spark, memory):
    exact = [(r.id, r.score) for r in memory.probe(words("the cat text"), 3).collect()]
    assert memory.probe_cached(words("the cat text"), 3) == exact and memory.stats_of_last.source == "exact"
    assert memory.probe_cached(words("the cat text"), 3) == exact and memory.stats_of_last.source == "cache"
    assert memory.probe_batch_cached([words("the cat text"), words("dog")], 3)[0] == exact
    memory.clear_similarity_cache()
    memory.config = retrieval.Config(graph=True, graph_depth=2, graph_fanout=5)
    # those that links reach from the nearest one, however near others are
    reached = [(r.id, r.score) for r in memory.probe(words("the cat text"), 5).collect() if r.id in ("cat", "dog", "bird")]
    assert memory.probe_cached(words("the cat text"), 3) == reached and memory.stats_of_last.source == "graph"
    assert memory.probe_cached(words("the cat text"), 5)[0][0] == "cat" and memory.stats_of_last.fell_back_to_exact
    memory.config = retrieval.Config()
    seen = memory.metrics_snapshot()
    assert seen["cache_hits_total"] == 2 and seen["concepts_injected_total"] == 5 and seen["avg_probes_latency_ms"] > 0
    hits, stats = retrieval.with_stats(memory.concepts, memory.get("cat")["vector"], 2, filters.eq("kind", "animal"))
    assert hits.first().id == "cat" and stats.selectivity == 0.6 and stats.strategy == "Pre"
    assert memory.storage()["concepts"] == 5 and memory.storage()["bytes"] > 0
    small = retrieval.Cache(1)
    small.put(("a",), []), small.put(("b",), [])
    assert small.evictions == 1 and small.get(("a",)) is None


@pytest.mark.parametrize("kind", ["hnsw", "lsh"])
def test_indices(spark, memory, kind):
    memory.set_backend(kind, **({"m": 4} if kind == "hnsw" else {"tables": 24, "hash_bits": 2}))
    exact = [r.id for r in memory.probe(words("the cat text"), 3).collect()]
    assert [r.id for r in memory.index_search(words("the cat text"), 3).collect()] == exact
    assert memory.load_replace() and memory.index_stats()["count"] == 5
    assert [r.id for r in memory.index_search(words("the cat text"), 2, filters.eq("kind", "word")).collect()] == [r.id for r in memory.probe(words("the cat text"), 2, filters.eq("kind", "word")).collect()]
    assert memory.probe_cached(words("the bird text"), 1)[0][0] == "bird" and memory.stats_of_last.source == "index"
    memory.update_metadata("hue", {"kind": "word", "searchable_text": "the hue text"})
    assert not memory.load_replace()
    memory.set_backend("brute_force")
    assert memory.index_stats()["backend"] == "brute_force"


def test_hnsw_recall_over_shards(spark, monkeypatch, sf):
    from tesserine.plans import memory as plans

    monkeypatch.setattr(hnsw, "SHARD_ROWS", 128)
    rows = plans.sketches(spark, sf)
    own, built = {r.id: list(r.vector) for r in rows.collect()}, hnsw.HnswIndex(m=8)
    index = built.build(rows).cache()
    assert index.count() > 1 and index.agg(F.sum(F.size("ids"))).first()[0] == len(own)
    hit = total = 0
    for q in range(0, 500, 50):
        exact = [bin((own[q][0] ^ v[0]) & (1 << 64) - 1).count("1") for v in own.values()]
        edge = sorted(exact)[9]
        hit, total = hit + sum(r.distance <= edge for r in built.search(index, own[q], 10).collect()), total + 10
    assert hit / total >= 0.9
    gone = spark.createDataFrame([(0,)], "id long")
    assert 0 not in {r.id for r in built.search(index, own[0], 5, gone).collect()}
    kept = hnsw.encode_snapshots(index, 3, built.fingerprint)
    assert hnsw.usable(kept, 3, built.fingerprint) and not hnsw.usable(kept, 4, built.fingerprint) and not hnsw.usable(kept, 3, "x")
    assert not hnsw.usable(kept.withColumn("graph", F.concat("graph", F.unhex(F.lit("00")))), 3, built.fingerprint)
    blob = hnsw.encode_snapshot(b"data", 5, "f")
    assert hnsw.decode_snapshot(blob) == (b"data", 5, "f") and hnsw.decode_snapshot(b"old") is None
    with pytest.raises(ValueError, match="checksum"):
        hnsw.decode_snapshot(blob[:-1] + b"x")


def test_absences_are_on_record_until_the_namespace_changes(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "a"), now=1000)
    assert [m.probe_text_semantic("Nothing here ") for _ in range(3)] == [None] * 3 and m.stats_of_last.source != "absence"
    assert m.probe_text_semantic("nothing here") is None and m.stats_of_last.source == "absence"
    id_ = m.absences.id_of("nothing here", "semantic")
    assert m.absences.get(id_)["attempt_count"] == 3 and m.gaps().count() == 1
    m.inject_text("x", "nothing here")
    assert m.probe_text_semantic("nothing here", 1) == [("x", 1.0)] and m.absences.get(id_) is None
    assert m.probe_text_semantic("else", 1, least=0.99) is None


def test_bridge(spark, memory, tmp_path):
    memory.save_ontology(spark.createDataFrame([("c1", 1, ["color"], ["c2"]), ("c2", 1, ["hue"], []), ("gone", 1, ["x"], [])], "id string, version int, labels array<string>, related array<string>"))
    memory.delete_canonical("gone")
    memory.save_canonical("c3", ["cat"])
    assert {r.id for r in memory.ontology.collect()} == {"c1", "c2", "c3"}
    memory.write_ontology(str(tmp_path / "onto"))
    assert len([x for f in (tmp_path / "onto").glob("*.json") for x in f.read_text().splitlines()]) == 3
    hits, best = memory.bridge_with_best_score("what color", 3)
    rows = hits.orderBy(F.desc("final_score")).collect()
    assert best == rows[0].final_score and {"color", "hue"} <= {r.id for r in rows} and any("concept" in r.evidence for r in rows)
    up = lambda df: df.withColumn("semantic", (F.col("id") == "hue").cast("double"))
    raised = {r.id: r.final_score for r in memory.bridge_hits("what color", 3, up).collect()}
    assert raised["hue"] == pytest.approx({r.id: r.final_score for r in rows}["hue"] + 0.1)
    assert memory.probe_bridge_text("what color", 3) == [(r.id, r.final_score) for r in rows]
    assert [r.id for r in memory.probe_bridge_text_filtered("what color", 2, filters.eq("kind", "animal")).collect()] == []
    assert "the hue text" in memory.memory_packet("what color", 3)["facts"]


def test_vectors_resources_and_commands(spark, memory, tmp_path, capsys, monkeypatch):
    own = memory.get("cat")["vector"]
    data = base64.b64encode(b"".join((w & (1 << 64) - 1).to_bytes(8, "little") for w in own)).decode()
    halves = [x & (1 << 64) - 1 for i in range(0, 160, 2) for x in (own[i + 1], own[i])]
    assert parse_vector(data) == own == parse_vector(halves)
    for bad in ("", [1], 5, [2**64] * 160):
        with pytest.raises(ValueError, match="vector"):
            parse_vector(bad)
    assert execute_tool(memory, "memory_probe", {"vector": data, "k": 1})[0]["id"] == "cat"
    assert read_resource(memory, "concept://cat")["id"] == "cat" and read_resource(memory, "health://current") == {"status": "healthy"} and read_resource(memory, "stats://current")["associations"] == 2
    for bad in ("concept://nobody", "else://"):
        with pytest.raises(KeyError):
            read_resource(memory, bad)
    alone = memory.bundle(["cat"])
    assert alone == own
    with pytest.raises(KeyError):
        memory.bundle(["cat", "nobody"])
    assert run_analytics(memory, "inspect", {})["associations"] == 2
    assert run_analytics(memory, "query", {"sql": "SELECT count(*) AS n FROM concepts"}) == [{"n": 5}]
    assert run_analytics(memory, "export", {"folder": str(tmp_path / "out")})["files"]["concepts"]["rows"] == 5
    main([memory.store.root, "memory_get", '{"id": "dog"}'])
    assert '"dog"' in capsys.readouterr().out
    assert memory.probe_with_rerankers(own, 2, "mmr:1.0").first().id == "cat"
    assert memory.probe_vector_graph(own, 3, anchors=1).first().id == "cat"
    assert hv.retracted(hv.bit_counts(spark.createDataFrame([(1, [1], 1), (1, [1], -1)], "g int, v array<long>, s int"), ["g"], "v", 1, "s")).first().n == 0
    with pytest.raises(Exception, match="nothing is left"):
        hv.retracted(hv.bit_counts(spark.createDataFrame([(1, [1], -1)], "g int, v array<long>, s int"), ["g"], "v", 1, "s")).collect()
    assert spark.range(3).select(hv.random(2).alias("v")).distinct().count() == 3


def test_index_dir(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "d"), now=1)
    (tmp_path / "doc.md").write_text("# T\n## One\nfirst text\n## Two\nsecond text\n")
    assert m.index_dir(str(tmp_path / "*.md")) == {"indexed": 2, "replaced": 0, "skipped": 0, "deleted": 0}
    assert "One" in m.probe_text("first text", 1).join(m.concepts, "id").first().metadata
    (tmp_path / "doc.md").write_text("# T\n## One\nfirst text\n## Two\nother\n")
    assert m.index_dir(str(tmp_path / "*.md"), sync=True) == {"indexed": 0, "replaced": 1, "skipped": 1, "deleted": 0}
    (tmp_path / "doc.md").write_text("# T\n## One\nfirst text\n")
    assert m.index_dir(str(tmp_path / "*.md"), sync=True)["deleted"] == 1 and m.concepts.count() == 1


def test_metadata_merge(spark):
    row = spark.createDataFrame([('{"a": 1, "b": {"c": [1, null]}}', '{"b": 2, "d": "x"}'), (None, "{}")], "o string, n string")
    got = [json.loads(r.m) for r in row.select(lifecycle.metadata_merged(F.col("o"), F.col("n")).alias("m")).collect()]
    assert got == [{"a": 1, "b": 2, "d": "x"}, {}]
