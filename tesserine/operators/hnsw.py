"""Navigable small-world graphs in shards, and snapshots of indices.

A corpus is dealt into shards of bounded size by a hash of the id. A task builds the
layered graph of its shard, and a shard is one row of the index table. A search walks
the graph of every shard and the shards' best are ranked together, so the index grows
in rows and not in the size of any of them. Distances are exact Hamming distances.
"""

from __future__ import annotations

import heapq
import io
import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fnv1a
from ..sources.schemas import check_k
from .filters import Filter
from .search import QUERY_BLOCK, probe, top_k

#: Rows of one shard.
SHARD_ROWS = 4096


def _numbers(vectors: np.ndarray) -> list[int]:
    """Each vector's bits as one number."""
    return [int.from_bytes(v.tobytes(), "little") for v in np.ascontiguousarray(vectors)]


class Graph:
    """One shard: vectors, and for each layer the neighbours of its nodes.

    Walks go over lists and whole numbers: a step meets some 30 nodes, for which calls of NumPy would cost many times the distances.
    """

    def __init__(self, vectors: np.ndarray, m: int, ef: int, seed: int) -> None:
        self.v, self.m, self.numbers = vectors, m, _numbers(vectors)
        n = len(vectors)
        draw = np.random.default_rng(seed)
        top = np.minimum((-np.log(np.maximum(draw.random(n), 1e-12)) / np.log(max(2, m))).astype(int), 12).tolist()
        self.layers: list[list[list[int]]] = [[[] for _ in range(n)] for _ in range(max(top, default=0) + 1)]
        self.entry, self.height = 0, top[0] if n else 0
        for i in range(1, n):
            at, q = self.entry, self.numbers[i]
            for k in range(self.height, top[i], -1):
                at = self._descend(q, at, k)
            near = [at]
            for k in range(min(top[i], self.height), -1, -1):
                found = self._walk(q, near, ef, k)
                for _, j in found[:m]:
                    self._link(i, j, k)
                    self._link(j, i, k)
                near = [j for _, j in found]
            if top[i] > self.height:
                self.entry, self.height = i, top[i]

    def _width(self, layer: int) -> int:
        return self.m if layer else 2 * self.m

    def _link(self, i: int, j: int, layer: int) -> None:
        row = self.layers[layer][i]
        if j in row:
            return
        row.append(j)
        if len(row) > self._width(layer):
            # the nearest stay
            q, number = self.numbers[i], self.numbers
            row.sort(key=lambda x: (q ^ number[x]).bit_count())
            row.pop()

    def _descend(self, q: int, at: int, layer: int) -> int:
        rows, number = self.layers[layer], self.numbers
        here = (q ^ number[at]).bit_count()
        while rows[at]:
            near = min(rows[at], key=lambda j: (q ^ number[j]).bit_count())
            d = (q ^ number[near]).bit_count()
            if d >= here:
                break
            at, here = near, d
        return at

    def _walk(self, q: int, starts: list[int], ef: int, layer: int) -> list[tuple[int, int]]:
        """The ``ef`` nearest that a best-first walk meets: distance and node, the nearest first."""
        rows, number = self.layers[layer], self.numbers
        seen = bytearray(len(number))
        for i in starts:
            seen[i] = 1
        # a distance and a node are one number, which sorts as the pair does
        open_ = [((q ^ number[i]).bit_count() << 32) + i for i in starts]
        best = [i - (c - i) for c, i in zip(open_, starts, strict=True)]
        heapq.heapify(open_), heapq.heapify(best)
        full = len(best) >= ef
        worst = -(best[0] >> 32)
        while open_:
            c = heapq.heappop(open_)
            if full and c >> 32 > worst:
                break
            for j in rows[c & 0xFFFFFFFF]:
                if seen[j]:
                    continue
                seen[j] = 1
                d = (q ^ number[j]).bit_count()
                if full:
                    if d >= worst:
                        continue
                    heapq.heapreplace(best, (-d << 32) + j)
                else:
                    heapq.heappush(best, (-d << 32) + j)
                    full = len(best) >= ef
                heapq.heappush(open_, (d << 32) + j)
                worst = -(best[0] >> 32)
        return sorted((-(c >> 32), c & 0xFFFFFFFF) for c in best)

    def search(self, q: np.ndarray, k: int, ef: int) -> list[tuple[int, int]]:
        if not len(self.v):
            return []
        at, number = self.entry, int.from_bytes(q.tobytes(), "little")
        for layer in range(self.height, 0, -1):
            at = self._descend(number, at, layer)
        return self._walk(number, [at], max(ef, k), 0)[:k]

    def dump(self) -> bytes:
        """As arrays: a layer is a row for each node, which -1 fills."""
        out, filled = io.BytesIO(), {}
        for k, rows in enumerate(self.layers):
            filled[f"l{k}"] = np.array([row + [-1] * (self._width(k) - len(row)) for row in rows], np.int32).reshape(len(rows), self._width(k))
        np.savez(out, v=self.v, at=np.array([self.m, self.entry, self.height]), **filled)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Graph:
        made, own = cls.__new__(cls), np.load(io.BytesIO(data), allow_pickle=False)
        made.v, (made.m, made.entry, made.height) = own["v"], own["at"].tolist()
        made.numbers = _numbers(made.v)
        made.layers = [[[j for j in row if j >= 0] for row in own[f"l{k}"].tolist()] for k in range(len(own.files) - 2)]
        return made


class HnswIndex:
    """``m`` neighbours a node (twice that at the bottom), ``ef_build`` and ``ef`` candidates while building and searching."""

    def __init__(self, m: int = 16, ef_build: int = 64, ef: int = 64, seed: int = 42) -> None:
        if not 1 <= m <= 256 or ef < 1 or ef_build < 1:
            raise ValueError("m is 1 to 256, and ef at least 1")
        self.m, self.ef_build, self.ef, self.seed = m, ef_build, ef, seed

    @property
    def fingerprint(self) -> str:
        return f"hnsw:m={self.m}:build={self.ef_build}:shard={SHARD_ROWS}"

    def build(self, corpus: DataFrame, id_: str = "id", vector: str = "vector") -> DataFrame:
        """The index table: ``shard``, ``ids`` and ``graph``. Every row is indexed; rows without a vector are left out."""
        dtype = dict(corpus.dtypes)[id_]
        rows = corpus.select(F.col(id_).alias("id"), F.col(vector).alias("vector")).where("vector is not null and id is not null")
        shards = max(1, -(-rows.count() // SHARD_ROWS))
        m, ef, seed = self.m, self.ef_build, self.seed

        def make(group: pa.Table) -> pa.Table:
            group = group.sort_by("id")
            n = len(group)
            v = group.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(n, -1)
            shard = group.column("shard").slice(0, 1)
            ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), group.column("id").combine_chunks())
            return pa.table([shard, ids, pa.array([Graph(v, m, ef, seed + shard[0].as_py()).dump()], pa.binary())], ["shard", "ids", "graph"])

        # by number, or a plan that adapts puts these small rows, and so all graphs, into one task
        dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).repartition(shards, "shard")
        return dealt.groupBy("shard").applyInArrow(make, f"shard int, ids array<{dtype}>, graph binary")

    def search(self, index: DataFrame, query: list[int], k: int, without: DataFrame | None = None) -> DataFrame:
        """``id``, ``distance`` and ``score`` of the best ``k`` that the walks meet. Ids in ``without`` (deleted since the
        build) are left out; so many more are fetched from each shard."""
        check_k(k)
        more, words, ef = k + (without.count() if without is not None else 0), len(query), self.ef
        matrix = np.array(query, np.int64).view(np.uint64)
        dtype = index.schema["ids"].dataType.elementType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    found = Graph.load(batch.column(1)[i].as_py()).search(matrix, more, ef)
                    ids = batch.column(0).slice(i, 1).flatten().take(pa.array([j for _, j in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([d for d, _ in found], pa.int32())], ["id", "distance"])

        hits = index.select("ids", "graph").mapInArrow(run, f"id {dtype}, distance int")
        if without is not None:
            hits = hits.join(without.select("id"), "id", "left_anti")
        return top_k(hits.withColumn("score", 1 - F.col("distance") / (32.0 * words)), k)

    def search_batch(self, index: DataFrame, queries: DataFrame, k: int, query_id: str = "query_id", vector: str = "vector") -> DataFrame:
        """The best ``k`` of each query: ``query_id``, ``id``, ``distance``, ``score``, ``rank``. Queries come to the driver
        block by block; a shard is opened once for a block, and gives ``k`` rows a query."""
        check_k(k)
        ef, dtype = self.ef, index.schema["ids"].dataType.elementType.simpleString()
        kind = dict(queries.dtypes)[query_id]
        parts, words = [], 1

        def best(block: list[tuple]) -> DataFrame:
            keys, matrix = [b[0] for b in block], np.array([b[1] for b in block], np.int64).view(np.uint64)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for i in range(batch.num_rows):
                        graph, ids = Graph.load(batch.column(1)[i].as_py()), batch.column(0).slice(i, 1).flatten()
                        rows = [(q, j, d) for q in range(len(keys)) for d, j in graph.search(matrix[q], k, ef)]
                        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), ids.take(pa.array([r[1] for r in rows], pa.int64())), pa.array([r[2] for r in rows], pa.int32())], ["q", "id", "distance"])

            names = index.sparkSession.createDataFrame(list(enumerate(keys)), f"q int, query_id {kind}")
            return index.select("ids", "graph").mapInArrow(run, f"q int, id {dtype}, distance int").join(F.broadcast(names), "q").select("query_id", "id", "distance")

        block: list[tuple] = []
        for row in queries.select(query_id, vector).toLocalIterator():
            block.append((row[0], list(row[1])))
            words = len(row[1])
            if len(block) == QUERY_BLOCK:
                parts.append(best(block))
                block = []
        if block or not parts:
            parts.append(best(block))
        hits = reduce(DataFrame.unionByName, parts)
        ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= k)
        return ranked.select("query_id", "id", "distance", (1 - F.col("distance") / (32.0 * words)).alias("score"), "rank")

    def search_filtered(self, corpus: DataFrame, index: DataFrame, query: list[int], k: int, filter_: Filter) -> DataFrame:
        """Five times ``k`` rows, filtered; an exact filtered scan where fewer than ``k`` are left."""
        keep = corpus.where(filter_.on(corpus))
        near = top_k(self.search(index, query, 5 * k).join(keep.select("id"), "id", "left_semi"), k)
        return near if near.count() >= k else probe(keep, query, k)


#: Head of a snapshot: magic, version, revision, bytes of the fingerprint and of the data, checksum of the data.
MAGIC = b"TESSIDX1"
_HEAD = struct.Struct("<8sIQIQQ")


def encode_snapshot(data: bytes, revision: int, fingerprint: str) -> bytes:
    """An index's bytes in an envelope that tells what they were made of."""
    name = fingerprint.encode()
    return _HEAD.pack(MAGIC, 1, revision, len(name), len(data), fnv1a(data)) + name + data


def decode_snapshot(blob: bytes) -> tuple[bytes, int, str] | None:
    """Data, revision and fingerprint; None without the magic (older, to be built again). Damage is an error."""
    if blob[:8] != MAGIC or len(blob) < _HEAD.size:
        return None
    _, version, revision, n, size, checksum = _HEAD.unpack_from(blob)
    if version != 1:
        raise ValueError(f"snapshot version {version} is not supported")
    data = blob[_HEAD.size + n :]
    if len(data) != size or fnv1a(data) != checksum:
        raise ValueError("a snapshot's checksum differs")
    return data, revision, blob[_HEAD.size : _HEAD.size + n].decode()


def encode_snapshots(index: DataFrame, revision: int, fingerprint: str) -> DataFrame:
    """The rows of an index table with the envelope's columns beside their bytes, checksums made where the rows are."""
    return index.select("*", F.lit(revision).cast("long").alias("revision"), F.lit(fingerprint).alias("fingerprint"), F.crc32("graph").alias("checksum"))


def usable(snapshot: DataFrame, revision: int, fingerprint: str) -> bool:
    """Is every row of a stored index whole, of this revision and made this way? Otherwise it is built again."""
    bad = (F.col("revision") != revision) | (F.col("fingerprint") != fingerprint) | (F.crc32("graph") != F.col("checksum"))
    return snapshot.where(F.coalesce(bad, F.lit(True))).isEmpty() and not snapshot.isEmpty()


def memory_bytes(words: int, rows: int, m: int = 16) -> int:
    """What a graph over so many rows takes: vectors and neighbours."""
    return rows * (8 * words + 4 * 2 * m)


