"""Graphs of many shards: made side by side, with walks that meet what a plain walk meets."""

import heapq

import numpy as np
from pyspark.sql import functions as F

from tesserine.operators import hnsw, search


def plain(graph, q, k, ef):
    """A best-first walk of the bottom layer with pairs and sets."""
    d = lambda j: int(np.bitwise_count(graph.v[j] ^ q).sum())
    at = graph.entry
    for layer in range(graph.height, 0, -1):
        while graph.layers[layer][at] and d(best := min(graph.layers[layer][at], key=d)) < d(at):
            at = best
    seen, open_, found = {at}, [(d(at), at)], [(-d(at), at)]
    while open_:
        c, i = heapq.heappop(open_)
        if len(found) >= ef and c > -found[0][0]:
            break
        for j in (j for j in graph.layers[0][i] if j not in seen):
            seen.add(j)
            if len(found) < ef or d(j) < -found[0][0]:
                heapq.heappush(open_, (d(j), j))
                heapq.heappush(found, (-d(j), j))
                if len(found) > ef:
                    heapq.heappop(found)
    return sorted((-c, i) for c, i in found)[:k]


def test_walks():
    draw = np.random.default_rng(3)
    for vectors in (draw.integers(0, 2**63, (300, 3), dtype=np.uint64), draw.integers(0, 64, (300, 1), dtype=np.uint64)):
        made = hnsw.Graph.load(hnsw.Graph(vectors, 4, 16, 42).dump())
        for q in vectors[:40] ^ np.uint64(9):
            assert made.search(q, 10, 16) == plain(made, q, 10, 16)


def test_shards_are_built_in_different_tasks(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 64)
    rows = spark.range(1000).select("id", F.array(F.xxhash64("id")).alias("vector"))
    built = hnsw.HnswIndex(m=4, ef_build=16, ef=16).build(rows).select("shard", F.size("ids").alias("n"), F.spark_partition_id().alias("task")).collect()
    assert len(built) == 16 and sum(r.n for r in built) == 1000
    assert len({r.task for r in built}) > 4


def test_ties_of_exact_batches(spark):
    rows = spark.range(500).select((F.lit(499) - F.col("id")).alias("id"), F.array(F.col("id") % 7).alias("vector"))
    got = search.probe_batch(rows, rows.where("id < 3").select(F.col("id").alias("query_id"), "vector"), 9).collect()
    own = {r.id: r.vector[0] for r in rows.collect()}
    for q in range(3):
        best = sorted((bin(own[q] ^ v).count("1"), i) for i, v in own.items())[:9]
        assert [(r.distance, r.id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == best
