"""Multi-index hashing against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tesserine.operators import multi_index
from tesserine.operators.multi_index import MultiIndex
from tesserine.sources import tables


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def made(words, n=300):
    """Centres, rows near them, copies, and one vector that a third of all rows share."""
    rng = random.Random(words)
    centres = [[rng.getrandbits(64) for _ in range(words)] for _ in range(6)]
    rows = {}
    for i in range(n):
        v = list(rng.choice(centres))
        if i % 3:
            for _ in range(rng.randint(0, 24)):
                v[rng.randrange(words)] ^= 1 << rng.randrange(64)
        else:
            v = centres[0]
        rows[i] = v
    return rows


def apart(a, b):
    return sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True))


def frame(spark, rows, name="id"):
    return spark.createDataFrame([(i, [signed(x) for x in v]) for i, v in rows.items()], f"{name} long, vector array<long>")


@pytest.mark.parametrize(("words", "parts"), [(1, 4), (1, 5), (2, 3)])
def test_results_equal_a_scan(spark, words, parts, monkeypatch):
    rows = made(words)
    index, asked = MultiIndex(parts, words, most=400), {i: v for i, v in rows.items() if i % 20 == 0}
    corpus = frame(spark, rows).unionByName(spark.createDataFrame([(None, [0] * words), (9999, None)], "id long, vector array<long>"))
    table = tables.cut(index.build(corpus))
    queries = frame(spark, asked, "query_id").unionByName(spark.createDataFrame([(-1, None)], "query_id long, vector array<long>"))
    for radius in (0, 7, 15):
        expected = sorted((q, i, apart(v, w)) for q, v in asked.items() for i, w in rows.items() if apart(v, w) <= radius)
        assert sorted(map(tuple, index.within(table, queries, radius).collect())) == expected
    for k, cost in ((1, 64), (1, 1), (7, 1), (150, 1)):
        # 64: the scan answers at once; 1: steps first
        monkeypatch.setattr(multi_index, "LOOKUP_COST", cost)
        expected = sorted((q, i, d, r + 1) for q, v in asked.items() for r, (d, i) in enumerate(sorted((apart(v, w), i) for i, w in rows.items())[:k]))
        got = index.nearest(table, queries, k).select("query_id", "id", "distance", "rank")
        assert sorted(map(tuple, got.collect())) == expected


def test_rows_read_are_few_and_classes_are_whole(spark):
    rows = made(1)
    index = MultiIndex(4, most=5)
    table = tables.cut(index.build(frame(spark, rows)))
    queries = frame(spark, {i: v for i, v in rows.items() if i < 4}, "query_id")
    part = lambda v, p: (v >> 16 * p) & 0xFFFF
    different = {v[0] for v in rows.values()}
    expected = {q: sum((part(rows[q][0], p) ^ part(v, p)).bit_count() <= 1 for p in range(4) for v in different) for q in range(4)}
    assert {r.query_id: r.opened for r in index.opened(table, queries, 1).collect()} == expected
    # a class with more rows than the index keeps: no part of it is passed off as the whole
    with pytest.raises(Exception, match="larger"):
        index.within(table, queries, 7).collect()
    assert index.classes(table, queries, 7).where("distance = 0").count() == len({tuple(rows[q]) for q in range(4)})
    with pytest.raises(ValueError, match="at most 5"):
        index.nearest(table, queries, 6)
    empty = index.build(frame(spark, rows).where("false"))
    assert index.nearest(empty, queries, 3).count() == 0 and index.within(empty, queries, 3).count() == 0


def test_the_bound():
    index = MultiIndex(4)
    assert [index.steps(r) for r in (0, 3, 4, 7, 8, 11)] == [0, 0, 1, 1, 2, 2]
    assert all(index.reach(index.steps(r)) >= r for r in range(64))
    assert index.lookups(2) == 4 * 120


def test_no_scan_of_other_buckets_and_no_distinct(spark):
    index = MultiIndex(4)
    corpus = spark.range(10).select("id", F.array(F.col("id")).alias("vector"))
    asked = corpus.select(F.col("id").alias("query_id"), "vector")
    plan = index.met(tables.cut(index.build(corpus)), asked.select(F.col("vector").alias("asked")), 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join Inner" in plan
