"""A keyword index that follows writes by small segments, against one that is built anew."""

import random

from pyspark.sql import functions as F

from tesserine.memory import Memory
from tesserine.operators import keyword


def docs(spark, rows):
    return spark.createDataFrame(sorted(rows.items()), "id string, text string")


def words(c="text"):
    return F.filter(F.split(F.col(c), " "), lambda w: w != "")


def scores(index, query):
    return {r.id: round(r.score, 9) for r in index.scores(query).collect()}


def test_updates_build_one_small_segment_each(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword.Segments, "MOST", 3)
    rng, rows = random.Random(1), {}
    text = lambda: " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 12)))
    rows.update({f"d{i}": text() for i in range(200)})
    index = keyword.Segments(spark, str(tmp_path / "i"))
    index.refresh(1, docs(spark, rows), words())
    for revision in range(2, 8):
        changed = {f"d{rng.randrange(220)}" for _ in range(4)}
        for i in changed:
            if rng.random() < 0.3:
                rows.pop(i, None)
            else:
                rows[i] = text()
        before = {n for n, _ in index.state()["segments"]}
        made = index.refresh(revision, docs(spark, rows), words(), spark.createDataFrame([(i,) for i in changed], "id string"))
        new = [x for x in index.state()["segments"] if x[0] not in before]
        assert len(new) == 1 and new[0][1] < 50 and len(index.state()["segments"]) <= 3  # the first segment is left alone
        whole = keyword.Bm25.build(docs(spark, rows), words())
        assert scores(made, ["a", "c", "zz"]) == scores(whole, ["a", "c", "zz"])
        assert made.totals[0] == len(rows) and abs(made.totals[1] - whole.size().first().avg_doc_length) < 1e-9
    index.vacuum()
    assert scores(index.view(), ["b"]) == scores(whole, ["b"])
    # nothing changed: the same segments at a later revision
    own = index.state()["segments"]
    index.refresh(9, docs(spark, rows), words(), spark.createDataFrame([], "id string"))
    assert index.state()["segments"] == own and index.state()["revision"] == 9
    # another session that was first with an older revision
    fresh = keyword.Segments(spark, index.folder)
    assert scores(fresh.refresh(9, docs(spark, {}), words()), ["b"]) == scores(whole, ["b"])


def test_session_follows_writes_and_bases(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"), now=1)
    put = lambda **texts: m.upsert(spark.createDataFrame([(i, [1], f'{{"searchable_text": "{t}"}}') for i, t in texts.items()], "id string, vector array<long>, metadata string"))
    ids = lambda q: sorted(scores(m.text_index(), [q]))
    put(**{f"x{i}": "red sky" for i in range(12)})
    assert len(ids("red")) == 12
    put(x1="blue sky", y="red")
    m.delete("x2")
    assert ids("red") == sorted({f"x{i}" for i in range(12)} - {"x1", "x2"} | {"y"}) and ids("blue") == ["x1"]
    own = keyword.Segments(spark, f"{m._index_folder()}/text-0")
    assert [n for _, n in own.state()["segments"]] == [12, 3]
    put(z="red")
    m.store.compact("concepts", m.SCHEMAS["concepts"], m.KEYS["concepts"])
    assert "z" in ids("red") and len(own.state()["segments"]) == 1  # a new base hides what changed: built anew
    other = Memory(spark, m.store.root, "other", now=1)
    other.inject_text("q", "red")
    assert "q" not in ids("red")
