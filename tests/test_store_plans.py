"""Writes and reads of a store that deal out keys, not whole rows."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.sources.tables import Store

SCHEMA = T.StructType().add("ns", "string").add("id", "long").add("text", "string")
KEYS = ["ns", "id"]


def rows(spark, ids, text):
    return spark.createDataFrame([("a", i, f"{text} {i}") for i in ids], SCHEMA)


def test_only_rows_of_repeated_keys_are_dealt_out(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    given = rows(spark, range(50), "z").unionByName(rows(spark, [3, 7, 7], "y")).unionByName(spark.createDataFrame([("a", None, "q"), (None, 1, "p"), ("a", None, "o"), (None, 1, "r")], SCHEMA))
    store.upsert("t", given, KEYS)
    got = {(r.ns, r.id): r.text for r in store.read("t", SCHEMA, KEYS).collect()}
    assert store.read("t", SCHEMA, KEYS).count() == 52 == len(got)
    assert got[("a", 3)] == "y 3" and got[("a", 7)] == "y 7" and got[("a", 8)] == "z 8" and got[("a", None)] == "o" and got[(None, 1)] == "p"


def test_writing_unique_keys_sorts_no_rows(spark, tmp_path, monkeypatch):
    store, written = Store(spark, str(tmp_path)), []
    monkeypatch.setattr(store, "written", lambda table, df: written.append(df) or ("f" * 32, 0))
    store.upsert("t", rows(spark, range(9), "z"), KEYS)
    plan = written[0]._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan


def test_many_rows_of_which_few_are_outdone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Store, "BROADCAST_ROWS", 30)
    monkeypatch.setattr(Store, "SORTED_BYTES", 256)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        store = Store(spark, str(tmp_path))
        store.upsert("t", rows(spark, range(100), "old"), KEYS)
        one = store.read("t", SCHEMA, KEYS)
        assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
        store.upsert("t", rows(spark, range(90, 105), "new"), KEYS)
        store.delete("t", spark.createDataFrame([("a", 1), ("a", 1), ("a", 95)], "ns string, id long"))
        for _ in range(2):
            both = store.read("t", SCHEMA, KEYS)
            assert "SortMergeJoin" not in both._jdf.queryExecution().executedPlan().toString()
            got = {r.id: r.text for r in both.collect()}
            assert both.count() == len(got) == 103 and got[89] == "old 89" and got[90] == "new 90" and got[104] == "new 104" and 1 not in got and 95 not in got
            store.tidy("t", SCHEMA, KEYS)
        base = store.state()["tables"]["t"]["base"]
        assert base[1] == 103 and len(list((tmp_path / "t" / base[0]).glob("part-*.parquet"))) > 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_large_first_log_is_the_base_without_a_copy(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Store, "BROADCAST_ROWS", 30)
    store, own = Store(spark, str(tmp_path)), lambda: store.state()["tables"]["t"]
    store.upsert("t", rows(spark, range(100), "old"), KEYS)
    first, since = own()["logs"][0][0], store.revision("t")
    store.tidy("t", SCHEMA, KEYS)
    assert own()["base"][:2] == [first, 100] and not own()["logs"]
    store.upsert("t", rows(spark, range(90, 105), "new"), KEYS)
    store.tidy("t", SCHEMA, KEYS)
    store.delete("t", spark.createDataFrame([("a", 1), ("a", 95)], "ns string, id long"))
    store.tidy("t", SCHEMA, KEYS)
    assert own()["base"][0] == first and len(list((tmp_path / "t").iterdir())) == 3
    got = {r.id: r.text for r in store.read("t", SCHEMA, KEYS).collect()}
    assert len(got) == 103 and got[89] == "old 89" and got[90] == "new 90" and 1 not in got and 95 not in got
    assert sorted(r.id for r in store.changed("t", SCHEMA, KEYS, since, store.state()).collect()) == [1, *range(90, 105)]
    store.compact("t", SCHEMA, KEYS)
    assert own()["base"][0] != first and own()["base"][1:2] == [103] and not own()["base"][3:]
    # tombstones are no base
    store.delete("u", spark.createDataFrame([("a", i) for i in range(40)], "ns string, id long"))
    store.tidy("u", SCHEMA, KEYS)
    assert store.state()["tables"]["u"]["base"] is None


def test_an_adopted_base_can_be_clustered(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Store, "BROADCAST_ROWS", 30)
    store = Store(spark, str(tmp_path))
    store.upsert("t", rows(spark, range(100), "old"), KEYS)
    store.tidy("t", SCHEMA, KEYS)
    store.compact("t", SCHEMA, KEYS)
    assert store.state()["tables"]["t"]["base"][1:2] == [100] and not store.state()["tables"]["t"]["base"][3:] and store.read("t", SCHEMA, KEYS).count() == 100


def test_writes_and_an_index_leave_no_copy_of_texts_behind(spark, tmp_path):
    from tesserine.memory import Memory
    from tesserine.sources import tables

    steps = lambda: set(tables.names(spark, f"{tables.checkpoint_dir(spark)}/steps"))
    before, m = steps(), Memory(spark, str(tmp_path / "store"), now=1)
    m.upsert(spark.createDataFrame([("a", [1], '{"searchable_text": "red fox"}'), ("b", [2], '{"searchable_text": "red hen"}')], "id string, vector array<long>, metadata string"))
    assert steps() == before
    assert {r.id for r in m.text_index().scores(["fox"]).collect()} == {"a"}
    kinds = {p.name: spark.read.parquet(str(p)).columns for p in (tmp_path / "store").rglob("*") if p.name in ("lengths", "postings", "words") and p.is_dir()}
    assert sorted(kinds) == ["lengths", "postings"] and kinds["lengths"] == ["id", "dl"]
