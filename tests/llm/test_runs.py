"""Periodic runs against a search of all periods."""

import hashlib
import random
import zlib

from tesserine.llm import queries, runs
from tests.compare import same


def brute(words, least=6, times=4):
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            end = j + q
            if end - i >= max(least, times * q) and not any(all(words[k] == words[k + p] for k in range(i, end - p)) for p in range(1, q)):
                out.append((i, end - i, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        letters = "abcdefgh"[: rng.choice([1, 2, 2, 3, 5])]
        words = [rng.choice(letters) for _ in range(rng.randint(0, 60))]
        if words and rng.random() < 0.5:
            words += words[: rng.randint(1, 6)] * rng.randint(2, 8) + words[:5]
        yield words


def test_slices_against_all_periods():
    for seed in range(60):
        docs = list(texts(seed, 5))
        for least, times in ((6, 4), (2, 2)):
            found = runs._columns([" ".join(w).encode() for w in docs], least, times)[5].to_pylist()
            assert [[(r["start"], r["length"], r["period"]) for r in f] for f in found] == [brute(w, least, times) for w in docs]


def test_columns_nulls_and_clashing_names(spark):
    rows = [(1, None, 5), (2, "", 5), (3, " \t\n", 5), (4, "a b a b a b a b c", 5), (4, "a b a b a b a b c", 5), (5, "x " * 3000, 5), (6, "é é é é é é", None), (7, "a b " * 5, 1)]
    got = runs.find(spark.createDataFrame(rows, "id long, text string, n_runs int")).orderBy("id").collect()
    assert [(r.id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.collapsed) for r in got] == [
        (1, 0, None, None, None, None, ""), (2, 0, None, None, None, None, ""), (3, 0, None, None, None, None, ""), (4, 1, 0, 8, 2, 4000, "a b c"), (4, 1, 0, 8, 2, 4000, "a b c"),
        (5, 1, 0, 3000, 1, 3000000, "x"), (6, 1, 0, 6, 1, 6000, "é"), (7, 0, None, None, None, None, " ".join(["a b"] * 5)),
    ]
    assert got[3].text == rows[3][1]
    assert runs.find(spark.createDataFrame([], "id long, text string")).collect() == []


def test_best_of_several():
    words = "p q r s " * 4 + "x " + "a " * 20 + "y " + "b " * 20
    cols = runs._columns([words.encode()], 6, 4)
    assert [c[0].as_py() for c in cols[:5]] == [3, 17, 20, 1, 20000]


def test_against_sql(spark, sf):
    same(spark, sf, queries.QUERIES["op13_periodic_runs"], queries.ORACLE_SQL["op13_periodic_runs"])


def test_planted_texts_without_words(spark, tmp_path):
    """An empty text whose number asks for a periodic end has no word to begin it at."""
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    spark.createDataFrame(list(zip(ids, ["", None, " \t\n", "a"], strict=True)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert [got[i].n_runs for i in ids] == [0] * 4 and all(got[i].start is None for i in ids)
    assert [got[i].collapsed_sha256 for i in ids] == [empty] * 3 + [hashlib.sha256(b"a").hexdigest()]
