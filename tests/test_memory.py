import pytest

from tesserine.functions import text as tx
from tesserine.memory import Memory, execute_tool


def test_session(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"), now=1000)
    m.inject_text("cat", "the cat sat on the mat", {"session_id": "s1"})
    m.inject_text("dog", "the dog ran in the park", {"session_id": "s2"})
    m.inject_text("old", "the cat of yesterday", ttl=10)
    m.associate([("cat", "dog", 0.8)])
    assert m.stats() == {"concepts": 3, "associations": 1, "revision": 3}
    vector = [int(w) for w in tx.encode_text("the cat sat on the mat")]
    assert m.probe(vector, 1).first().id == "cat"
    assert m.probe_text("cat mat", 2).first().id == "cat"
    assert [r.id for r in m.probe_in_session("the", "s2", 5).collect()] == ["dog"]
    assert execute_tool(m, "memory_shortest_path", {"from": "cat", "to": "dog"}) == ["cat", "dog"]
    assert [r["id"] for r in execute_tool(m, "memory_traverse", {"start": "cat"})] == ["cat", "dog"]
    with pytest.raises(ValueError, match="association"):
        m.associate([("cat", "nobody", 0.5)])
    m.inject_text("cat", "the cat left", {"session_id": "s1", "x": 1})
    assert [r.version for r in m.history("cat").collect()] == [2, 1]
    assert dict(m.diff("cat", 1, 2)["added"]) == {"x": "1"}
    m.rollback("cat", 1)
    assert "sat on" in m.get("cat")["metadata"] and m.history("cat").count() == 3
    later = Memory(spark, str(tmp_path / "m"), now=2000)
    assert "old" not in {r.id for r in later.probe(vector, 10).collect()}
    assert later.purge_expired() == 1 and later.get("old") is None
    assert later.sql("SELECT count(*) AS n FROM concepts").first().n == 2
    later.set_namespace("other")
    assert later.stats()["concepts"] == 0 and later.namespaces() == ["_default"]
    later.set_namespace("_default")
    later.delete("cat")
    assert later.stats()["associations"] == 0 and '"dog"' in later.export()
