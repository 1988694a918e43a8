"""Exact search in Hamming space without a scan: multi-index hashing.

A vector is cut into disjoint parts, and the index has one row for each part of each different vector, clustered by part
and value. Two vectors at a distance below ``parts * (r + 1)`` have a part in which they differ in at most ``r`` bits
(pigeonhole), so looking up each part's value and all values up to ``r`` bits beside it misses none of them. A search by
radius looks up that many; a search for the nearest lets ``r`` grow until the bound says that no nearer row can be left,
and turns to a scan where another step's lookups would cost more than that (``LOOKUP_COST``). Results equal those of a scan.

Rows with equal vectors are one class, of which the smallest ``most`` ids are kept, so a vector that a third of all rows
share is looked up once and no answer loses a row: ``k`` is at most ``most``. Rows without a vector or an id are left out.
Repeated queries are asked once. Ties go to the smaller id.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.schemas import check_k
from ..sources.tables import cut
from . import search


#: Vectors that a scan compares in the time of one lookup, which is a row of a shuffle.
LOOKUP_COST = 64


class MultiIndex:
    """``parts`` of each 64-bit word (1 to 16), for vectors of ``words`` words; ``most`` is the largest ``k`` served."""

    def __init__(self, parts: int = 4, words: int = 1, most: int = 100) -> None:
        if not 1 <= parts <= 16 or words < 1 or most < 1:
            raise ValueError("a word has 1 to 16 parts, and an index at least one word and one row to give")
        self.words, self.most = words, most
        edges = [64 * i // parts for i in range(parts + 1)]
        #: Word, first bit and number of bits of each part.
        self.places = [(w, a, b - a) for w in range(words) for a, b in zip(edges, edges[1:], strict=False)]

    @property
    def fingerprint(self) -> str:
        return f"multi:parts={len(self.places)}:words={self.words}:most={self.most}"

    def _part(self, vector: Column, part: int) -> Column:
        word, first, bits = self.places[part]
        value = F.shiftrightunsigned(vector[word], first)
        return value if bits == 64 else value.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))

    def build(self, corpus: DataFrame, id_: str = "id", vector: str = "vector") -> DataFrame:
        """The index table: ``part``, ``key``, ``vector`` and ``ids``; keep it clustered by ``part`` and ``key``."""
        rows = corpus.select(F.col(id_).alias("id"), F.col(vector).alias("vector")).where("vector is not null and id is not null")
        first = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
        few = rows.withColumn("_r", first).where(F.col("_r") <= self.most)
        classes = few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
        every = F.array(*[F.struct(F.lit(p).alias("part"), self._part(F.col("vector"), p).alias("key")) for p in range(len(self.places))])
        return classes.select(F.explode(every).alias("k"), "vector", "ids").select("k.part", "k.key", "vector", "ids")

    # -- steps

    def steps(self, radius: int) -> int:
        """Bits beside each part's value that a search by radius must look at."""
        return max(0, -(-(radius + 1) // len(self.places)) - 1)

    def reach(self, step: int) -> int:
        """The distance up to which every row has been met after a step."""
        return len(self.places) * (step + 1) - 1

    def lookups(self, step: int) -> int:
        """Values that one step looks up for a query."""
        return sum(comb(bits, step) for _, _, bits in self.places)

    def wanted(self, asked: DataFrame, step: int) -> DataFrame:
        """``part``, ``key`` and ``asked`` for the values that differ from the query's in exactly ``step`` bits."""
        beside = {bits: [sum(1 << b for b in at) for at in combinations(range(bits), step)] for bits in {b for _, _, b in self.places}}
        # masks are written as signed words
        masks = {bits: F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in found]) for bits, found in beside.items() if found}
        own = [self._beside(p, masks[bits]) for p, (_, _, bits) in enumerate(self.places) if bits in masks]
        return asked.select("asked", F.explode(F.flatten(F.array(*own))).alias("k")).select("asked", "k.part", "k.key")

    def _beside(self, part: int, masks: Column) -> Column:
        value = self._part(F.col("asked"), part)
        return F.transform(masks, lambda m: F.struct(F.lit(part).alias("part"), value.bitwiseXOR(m).alias("key")))

    def met(self, index: DataFrame, asked: DataFrame, step: int) -> DataFrame:
        """``asked``, ``vector``, ``ids`` and ``distance`` of the classes that a step meets and no step before it met.

        A class is met in every part that differs in ``step`` bits; it counts in the first of these only, which is seen from
        the two vectors, so nothing has to be made distinct.
        """
        hits = index.join(self.wanted(asked, step), ["part", "key"])
        apart = [F.bit_count(self._part(F.col("vector"), p).bitwiseXOR(self._part(F.col("asked"), p))) for p in range(len(self.places))]
        first = F.lit(True)
        for p, d in enumerate(apart):
            first = first & F.when(F.col("part") > p, d > step).otherwise(d >= step)
        distance = reduce(lambda a, b: a + b, [F.bit_count(F.col("vector")[w].bitwiseXOR(F.col("asked")[w])) for w in range(self.words)])
        return hits.where(first).select("asked", "vector", "ids", distance.cast("int").alias("distance"))

    # -- searches

    def opened(self, index: DataFrame, queries: DataFrame, step: int, query_id: str = "query_id", vector: str = "vector") -> DataFrame:
        """``query_id`` and ``opened``: rows of the index that a query's lookups up to ``step`` read. From counts of values."""
        sizes = index.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"))
        asked = _different(queries, vector)
        read = [sizes.join(self.wanted(asked, s), ["part", "key"]).groupBy("asked").agg(F.sum("n").alias("n")) for s in range(step + 1)]
        total = reduce(DataFrame.unionByName, read).groupBy("asked").agg(F.sum("n").alias("opened"))
        own = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("asked")).where("asked is not null")
        return own.join(total, "asked", "left").select("query_id", F.coalesce("opened", F.lit(0)).alias("opened"))

    def classes(self, index: DataFrame, queries: DataFrame, radius: int, vector: str = "vector") -> DataFrame:
        """Different vectors at most ``radius`` from each different query: ``asked``, ``ids``, ``distance``."""
        asked = _different(queries, vector)
        found = [self.met(index, asked, step) for step in range(self.steps(radius) + 1)]
        return reduce(DataFrame.unionByName, found).where(F.col("distance") <= radius).select("asked", "ids", "distance")

    def within(self, index: DataFrame, queries: DataFrame, radius: int, query_id: str = "query_id", vector: str = "vector") -> DataFrame:
        """All rows at most ``radius`` from each query: ``query_id``, ``id``, ``distance``.

        Needs every id of a class: one that has ``most`` ids or more is an error when it is met.
        """
        said = f"a vector has {self.most} rows or more: build the index with a larger `most`, or use classes()"
        whole = F.when(F.size("ids") < self.most, F.col("ids")).otherwise(F.raise_error(F.lit(said)))
        rows = self.classes(index, queries, radius, vector).select("asked", F.explode(whole).alias("id"), "distance")
        return self._named(rows, queries, query_id, vector).select("query_id", "id", "distance")

    def nearest(self, index: DataFrame, queries: DataFrame, k: int, query_id: str = "query_id", vector: str = "vector") -> DataFrame:
        """The exact best ``k`` of each query: ``query_id``, ``id``, ``distance``, ``score``, ``rank``."""
        if check_k(k) > self.most:
            raise ValueError(f"this index gives at most {self.most} rows a query")
        left, done, best = cut(_different(queries, vector)), [], None
        vectors = index.where("part = 0").count()
        step = 0
        while step <= max(bits for _, _, bits in self.places) and LOOKUP_COST * self.lookups(step) <= vectors and not left.isEmpty():
            # the best k rows lie in the k best classes by distance and smallest id
            hits = self._best(self.met(index, left, step), k, F.col("ids")[0]).select("asked", F.explode("ids").alias("id"), "distance")
            hits = hits if best is None else hits.unionByName(best.join(left, "asked", "left_semi"))
            best = cut(self._best(hits, k, F.col("id")))
            sure = best.where(F.col("distance") <= self.reach(step)).groupBy("asked").count().where(F.col("count") >= k).select("asked")
            done.append(best.join(sure, "asked", "left_semi").select("asked", "id", "distance"))
            left = cut(left.join(sure, "asked", "left_anti"))
            step += 1
        rows = index.where("part = 0").select("vector", F.explode(F.slice("ids", 1, k)).alias("id"))
        scanned = search.probe_batch(rows, left.select(F.col("asked").alias("query_id"), F.col("asked").alias("vector")), k)
        found = scanned.select(F.col("query_id").alias("asked"), "id", "distance")
        found = reduce(DataFrame.unionByName, done, found)
        rank = F.row_number().over(Window.partitionBy("asked").orderBy("distance", "id"))
        ranked = self._named(found.withColumn("rank", rank), queries, query_id, vector)
        return ranked.select("query_id", "id", "distance", (1 - F.col("distance") / (32.0 * self.words)).alias("score"), "rank")

    @staticmethod
    def _best(hits: DataFrame, k: int, tie: Column) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("asked").orderBy("distance", tie))
        return hits.withColumn("_r", place).where(F.col("_r") <= k).drop("_r")

    @staticmethod
    def _named(found: DataFrame, queries: DataFrame, query_id: str, vector: str) -> DataFrame:
        return queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("asked")).join(found, "asked")


def _different(queries: DataFrame, vector: str) -> DataFrame:
    return queries.select(F.col(vector).alias("asked")).where("asked is not null").distinct()
