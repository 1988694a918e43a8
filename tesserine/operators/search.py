"""Top-k search by hypervector similarity: exact, filtered, batched, by buckets, graph and LSH.

Ties in score go to the smaller id everywhere. A query vector is a literal or a row
of a query table. Query tables are the small side by contract: they are split into
blocks of bounded size, and each block is scored against all rows.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hypervector as hv
from ..sources.schemas import check_k
from .filters import Filter, live

#: Query vectors scored in one pass over the corpus.
QUERY_BLOCK = 256
PATTERN_THRESHOLD = 0.9


def literal(vector: list[int]) -> Column:
    return F.array(*[F.lit(w).cast("long") for w in vector])


def scored(corpus: DataFrame, query: list[int], id_: str = "id", vector: str = "vector") -> DataFrame:
    """``id``, ``distance`` and ``score`` of each row. The query is folded into the expression."""
    few = reduce(lambda a, b: a + b, [F.bit_count(F.col(vector)[i].bitwiseXOR(F.lit(w).cast("long"))) for i, w in enumerate(query)]) if len(query) <= 4 else None
    d = hv.hamming(F.col(vector), literal(query)) if few is None else few
    return corpus.select(F.col(id_).alias("id"), d.cast("int").alias("distance")).withColumn("score", 1 - F.col("distance") / (32.0 * len(query)))


def _nearest(corpus: DataFrame, query: list[int], k: int, id_: str, vector: str) -> DataFrame:
    """Rows in the running for the best ``k``: each Arrow batch gives its own best, ties by id."""
    matrix, dtype = np.array(query, np.int64).view(np.uint64), dict(corpus.dtypes)[id_]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(n, -1)
            d = np.bitwise_count(rows ^ matrix).sum(axis=1, dtype=np.int32)
            edge = np.partition(d, k - 1)[k - 1] if k < n else d.max()
            at = pa.array(np.flatnonzero(d <= edge))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(d).take(at)], ["id", "distance"])

    hits = corpus.select(F.col(id_).alias("id"), F.col(vector)).mapInArrow(run, f"id {dtype}, distance int")
    return hits.withColumn("score", 1 - F.col("distance") / (32.0 * len(query)))


def top_k(rows: DataFrame, k: int) -> DataFrame:
    return rows.orderBy(F.desc("score"), "id").limit(check_k(k))


def probe(corpus: DataFrame, query: list[int], k: int, now: int | None = None, filter_: Filter | None = None, id_: str = "id", vector: str = "vector") -> DataFrame:
    """The ``k`` live rows most like ``query`` that pass the filter. Nothing is cut by score."""
    if now is not None:
        corpus = corpus.where(live(now))
    if filter_ is not None:
        corpus = corpus.where(filter_.on(corpus))
    # wide vectors are compared in matrix form; words of a sketch in the expression
    wide = len(query) > 4
    return top_k(_nearest(corpus, query, check_k(k), id_, vector) if wide else scored(corpus, query, id_, vector), k)


def patterns(hits: DataFrame, threshold: float = PATTERN_THRESHOLD) -> DataFrame:
    """Events for hits at or above the threshold; they filter nothing."""
    return hits.where(F.col("score") >= threshold).select(F.lit("PatternRecognized").alias("kind"), "id", "score")


def best_score(hits: DataFrame) -> DataFrame:
    return hits.agg(F.max("score").alias("best_score"))


def probe_self(corpus: DataFrame, id_: str, k: int, threshold: float | None = None) -> DataFrame:
    """Search by a stored row; the row itself is dropped after the top ``k``, so fewer may come back."""
    row = corpus.where(F.col("id") == id_).select("vector").first()
    if row is None:
        raise KeyError(id_)
    hits = probe(corpus, list(row[0]), k).where(F.col("id") != id_)
    return hits if threshold is None else hits.where(F.col("score") >= threshold)


def probe_batch(corpus: DataFrame, queries: DataFrame, k: int, query_id: str = "query_id", query_vector: str = "vector", id_: str = "id", vector: str = "vector") -> DataFrame:
    """Top ``k`` of each query: ``query_id``, ``id``, ``distance``, ``score``, ``rank``.

    Queries come to the driver block by block. Each block is scored in matrix form against Arrow batches of the
    corpus, and only the best ``k`` of a batch leave it; the shuffle then carries ``k`` rows a query and batch.
    """
    check_k(k)
    parts, block = [], []
    dtype = dict(corpus.dtypes)[id_]
    spark = corpus.sparkSession

    def best(block: list[tuple]) -> DataFrame:
        keys = [b[0] for b in block]
        matrix = np.array([b[1] for b in block], np.int64).view(np.uint64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(n, -1)
                ids, out = batch.column(0), []
                order = np.argsort(np.array(ids.to_pylist(), dtype=object if dtype == "string" else None), kind="stable")
                rows = rows[order]
                # numbers of 16 bits are sorted in a time that follows their count
                narrow = np.uint16 if 64 * rows.shape[1] < 1 << 16 else np.int64
                for q in range(len(keys)):
                    d = np.bitwise_count(rows ^ matrix[q]).sum(axis=1, dtype=narrow)
                    at = np.argsort(d, kind="stable")[:k]
                    out.append((np.full(len(at), q), order[at], d[at]))
                q, at, d = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), ids.take(pa.array(at)), pa.array(d, pa.int32())], ["q", "id", "distance"])

        hits = corpus.select(id_, vector).mapInArrow(run, f"q int, id {dtype}, distance int")
        rank = Window.partitionBy("q").orderBy("distance", "id")
        hits = hits.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, key) for i, key in enumerate(keys)], f"q int, query_id {dict(queries.dtypes)[query_id]}")
        width = 32.0 * matrix.shape[1]
        return hits.join(F.broadcast(names), "q").select("query_id", "id", "distance", (1 - F.col("distance") / width).alias("score"), "rank")

    for row in queries.select(query_id, query_vector).toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == QUERY_BLOCK:
            parts.append(best(block))
            block = []
    if block:
        parts.append(best(block))
    if not parts:
        return spark.createDataFrame([], f"query_id {dict(queries.dtypes)[query_id]}, id {dtype}, distance int, score double, rank int")
    return reduce(DataFrame.unionByName, parts)


def score_candidates(corpus: DataFrame, query: list[int], ids: list[str]) -> DataFrame:
    """Scores of given ids in the order given, with their place; unknown ids are left out."""
    spark = corpus.sparkSession
    wanted = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "position int, id string")
    return scored(corpus, query).join(wanted, "id").orderBy("position").select("position", "id", "score")


def filter_strategy(total: int, matching: int) -> str:
    """The label that statistics carry: fewer than 20 rows, or shares of the rows that match."""
    share = matching / total if total else 0.0
    if total < 20 or share < 0.3:
        return "Pre"
    return "BucketPost" if share <= 0.8 else "ScanPost"


# Presets of retrieval by the number of query tokens.
PRESETS = {
    "short": {"max_candidates": 200, "graph_depth": 1, "graph_fanout": 5, "bucket_width": 2, "graph": False, "buckets": True, "abort_without_overlap": True, "fallback_ratio": 0.5},
    "medium": {"max_candidates": 500, "graph_depth": 1, "graph_fanout": 10, "bucket_width": 2, "graph": True, "buckets": True, "abort_without_overlap": True, "fallback_ratio": 0.5},
    "long": {"max_candidates": 1000, "graph_depth": 2, "graph_fanout": 10, "bucket_width": 2, "graph": True, "buckets": True, "abort_without_overlap": False, "fallback_ratio": 0.5},
}


def preset(tokens: int) -> dict[str, float]:
    return PRESETS["short" if tokens <= 2 else "medium" if tokens <= 8 else "long"]


def bucket_width(configured: int, rows: int, budget: int) -> int:
    """Bits of a bucket: enough that a bucket holds about ``budget`` rows, 16 at most."""
    need = max(1, -(-rows // max(1, budget)))
    return min(16, max(configured, (need - 1).bit_length()))


def bucket_candidates(corpus: DataFrame, query: list[int], width: int, id_: str = "id", vector: str = "vector") -> DataFrame:
    """Rows whose lowest ``width`` bits differ from the query's in at most one."""
    mask = (1 << width) - 1
    low = F.col(vector)[0].bitwiseAND(F.lit(mask))
    return corpus.where(F.bit_count(low.bitwiseXOR(F.lit(query[0] & mask))) <= 1)


def probe_buckets(corpus: DataFrame, query: list[int], k: int, width: int, max_candidates: int, id_: str = "id", vector: str = "vector") -> DataFrame:
    """Exact re-ranking of bucket candidates; an exact scan where there are over twice ``max_candidates``."""
    near = bucket_candidates(corpus, query, width, id_, vector)
    many = near.limit(2 * max_candidates + 1).count() > 2 * max_candidates
    return top_k(scored(corpus if many else near, query, id_, vector), k)


def graph_candidates(corpus: DataFrame, edges: DataFrame, query: list[int], fanout: int, depth: int) -> DataFrame:
    """Ids reached from the row most like the query over the ``fanout`` strongest links of each node."""
    strongest = Window.partitionBy("from_id").orderBy(F.desc("strength"), "to_id")
    ways = edges.withColumn("r", F.row_number().over(strongest)).where(F.col("r") <= fanout).select(F.col("from_id").alias("id"), "to_id")
    seen = front = probe(corpus, query, 1).select("id")
    for _ in range(depth):
        front = front.join(ways, "id").select(F.col("to_id").alias("id")).distinct().join(seen, "id", "left_anti")
        seen = seen.unionByName(front)
    return seen


class LshIndex:
    """Bit-sampling LSH: each table's key is a sample of the vector's bits, drawn from one seed."""

    #: Rows of a table whose buckets are taken as one part.
    BUCKET_ROWS = 1 << 20

    def __init__(self, tables: int = 16, hash_bits: int = 12, bits: int = hv.BITS, seed: int = 42) -> None:
        if not 1 <= tables <= 1000 or not 1 <= hash_bits <= 64:
            raise ValueError("an index has 1 to 1000 tables of 1 to 64 bits")
        self.tables, self.hash_bits, self.bits = tables, hash_bits, bits
        draw = random.Random(seed)
        self.places = [sorted(draw.sample(range(bits), min(hash_bits, bits))) for _ in range(tables)]

    @property
    def fingerprint(self) -> str:
        return f"lsh:tables={self.tables}:bits={self.hash_bits}"

    def _key(self, vector: Column, table: int) -> Column:
        bit = lambda p: F.shiftrightunsigned(vector[p // 64], p % 64).bitwiseAND(F.lit(1).cast("long"))
        parts = [F.shiftleft(bit(p), i) for i, p in enumerate(self.places[table])]
        return reduce(lambda a, b: a.bitwiseOR(b), parts)

    def keys(self, corpus: DataFrame, id_: str = "id", vector: str = "vector", with_vectors: bool = False) -> DataFrame:
        """The index table: ``table``, ``key`` and ``id``, one row a table; vectors of few words can stand in it too."""
        every = F.array(*[F.struct(F.lit(t).alias("table"), self._key(F.col(vector), t).alias("key")) for t in range(self.tables)])
        own = [F.col(vector).alias("vector")] if with_vectors else []
        return corpus.select(F.col(id_).alias("id"), *own, F.explode(every).alias("k")).select("k.table", "k.key", "id", *(["vector"] if with_vectors else []))

    def candidates(self, index: DataFrame, query: list[int], flips: int = 0) -> DataFrame:
        """Ids that share a bucket with the query, or with ``flips`` its buckets and those up to so many bits beside them."""
        unsigned = [w & ((1 << 64) - 1) for w in query]
        wanted = []
        for t, places in enumerate(self.places):
            key = sum(((unsigned[p // 64] >> (p % 64)) & 1) << i for i, p in enumerate(places))
            wanted.append((t, key - (1 << 64) if key >= 1 << 63 else key))
        near = lambda k: F.bit_count(F.col("key").bitwiseXOR(F.lit(k).cast("long"))) <= flips if flips else F.col("key") == k
        hit = reduce(lambda a, b: a | b, [(F.col("table") == t) & near(k) for t, k in wanted])
        if flips and self.hash_bits <= 16:
            # the buckets by name, so that an index clustered by table and key is pruned
            beside = lambda k: [k ^ sum(1 << b for b in bits) for n in range(flips + 1) for bits in combinations(range(self.hash_bits), n)]
            hit = reduce(lambda a, b: a | b, [(F.col("table") == t) & F.col("key").isin(beside(k)) for t, k in wanted])
        found = index.where(hit)
        return found.dropDuplicates(["id"]).select("id", "vector") if "vector" in index.columns else found.select("id").distinct()

    def search(self, corpus: DataFrame, index: DataFrame, query: list[int], k: int, id_: str = "id", vector: str = "vector", flips: int = 0) -> DataFrame:
        """Exact re-ranking of the candidates. May give fewer than ``k`` rows, and miss near ones; ``flips`` looks into more buckets."""
        near = self.candidates(index, query, flips)
        if "vector" in near.columns:
            return top_k(scored(near, query), k)
        near = corpus.withColumnRenamed(id_, "id").join(near, "id", "left_semi")
        return top_k(scored(near, query, "id", vector), k)

    def search_batch(self, index: DataFrame, queries: DataFrame, k: int, flips: int = 0, query_id: str = "query_id", vector: str = "vector") -> DataFrame:
        """The best ``k`` of each query among the rows of its buckets, and of those up to ``flips`` bits beside them:
        ``query_id``, ``id``, ``distance``, ``score``, ``rank``. The index holds vectors.

        Buckets, in parts of some ``BUCKET_ROWS`` rows, meet the queries that look into them. A part gives each query its best
        ``k`` of the rows that no bucket of an earlier table shows it, so no pair of query and row is ever shuffled.
        """
        check_k(k)
        beside = [sum(1 << b for b in bits) for n in range(flips + 1) for bits in combinations(range(self.hash_bits), n)]
        types = dict(index.dtypes)["id"], dict(queries.dtypes)[query_id]
        parts = max(1, -(-index.where(F.col("table") == 0).count() // self.BUCKET_ROWS))
        rows = index.select("table", "key", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), "id", "vector")
        own = self.keys(queries, query_id, vector, with_vectors=True).withColumnRenamed("id", "query_id")
        wanted = own.select("table", F.explode(F.array(*[F.col("key").bitwiseXOR(F.lit(b).cast("long")) for b in beside])).alias("key"), "query_id", F.col("vector").alias("asked"))
        wanted = wanted.select("table", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), "query_id", "asked")
        masks = np.zeros((self.tables, self.bits // 64), np.uint64)
        for t, places in enumerate(self.places):
            for p in places:
                masks[t, p // 64] |= np.uint64(1 << p % 64)

        def words(column: pa.ChunkedArray, n: int) -> np.ndarray:
            return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(n, -1)

        def best(bucket: pa.Table, looking: pa.Table) -> pa.Table:
            found = [(np.empty(0, np.int64),) * 3]
            if len(bucket) and len(looking):
                bucket = bucket.sort_by("id")
                rows, table = words(bucket.column("vector"), len(bucket)), bucket.column("table")[0].as_py()
                for q, asked in enumerate(words(looking.column("asked"), len(looking))):
                    apart = rows ^ asked
                    new = np.ones(len(rows), bool)
                    for mask in masks[:table]:
                        new &= np.bitwise_count(apart & mask).sum(axis=1) > flips
                    at = np.flatnonzero(new)
                    d = np.bitwise_count(apart[at]).sum(axis=1, dtype=np.int64)
                    if len(d) > k:
                        near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                        near = near[np.argsort(d[near], kind="stable")[:k]]
                        at, d = at[near], d[near]
                    found.append((np.full(len(at), q), at, d))
            q, at, d = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.table([looking.column("query_id").take(pa.array(q)), bucket.column("id").take(pa.array(at)), pa.array(d, pa.int32())], ["query_id", "id", "distance"])

        met = rows.groupBy("table", "key", "part").cogroup(wanted.groupBy("table", "key", "part"))
        hits = met.applyInArrow(best, f"query_id {types[1]}, id {types[0]}, distance int")
        order = Window.partitionBy("query_id").orderBy("distance", "id")
        ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.select("query_id", "id", "distance", (1 - F.col("distance") / float(self.bits / 2)).alias("score"), "rank")

    def search_filtered(self, corpus: DataFrame, index: DataFrame, query: list[int], k: int, filter_: Filter, exact: bool = False) -> DataFrame:
        """With a filter; an exact filtered scan where fewer than ``k`` rows come back. With ``exact`` the buckets give only a
        bound: the best ``k`` are no further than the last hit, and the rows up to there are ranked, in whatever bucket."""
        corpus = corpus.where(filter_.on(corpus))
        near = self.search(corpus, index, query, k)
        if not exact:
            return near if near.count() >= k else probe(corpus, query, k)
        n, edge = near.agg(F.count(F.lit(1)), F.max("distance")).first()
        return top_k(scored(corpus, query).where(F.col("distance") <= edge), k) if n >= k else probe(corpus, query, k)


def backend(kind: str, **options: int) -> LshIndex | None:
    """``brute_force`` has no index. ``hnsw`` is served by LSH with exact re-ranking."""
    if kind == "brute_force":
        return None
    if kind in ("lsh", "hnsw"):
        return LshIndex(**options)
    raise ValueError(f"unknown index {kind}")


def reusable(snapshot: dict, revision: int, fingerprint: str) -> bool:
    """An index table may be used again if revision and fingerprint agree; otherwise it is derived again."""
    return snapshot.get("revision") == revision and snapshot.get("fingerprint") == fingerprint


def rerank_chain(hits: DataFrame, rerankers: list[Callable[[DataFrame], DataFrame]], k: int) -> DataFrame:
    """Rerankers one after another over an initial list, then the best ``k``."""
    for r in rerankers:
        hits = r(hits)
    return top_k(hits, k)
