"""Best-fit-decreasing packing of token pieces into sequences of a fixed capacity.

Only lengths decide a best-fit-decreasing packing, and there are at most
``capacity`` different ones. So the corpus is tokenised once into a table, its
lengths are counted in Spark, and the whole packing runs over the counts: equal
bins are kept as intervals of bin numbers under their remaining capacity, and a
segment tree over remaining capacities finds the tightest open bin for each run
of equal documents in logarithmic time. The outcome is that of one global
best-fit-decreasing pass over every document, at a cost that does not grow with
their number. Each piece then finds its place by its rank among pieces of its
length: its rank within its task, known as it is made, and the pieces of that length
of the tasks before, one row of numbers for each task. Ids are written once and only
read after that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel, tokens
from .common import carried, stored

CAPACITY = 4096
END_ID = 1
#: Bytes of the tasks' rows that are sent to every executor; more are joined by a shuffle of the pieces.
BROADCAST_BYTES = 64 << 20
#: Runs that are sent to every executor, about 50 MB. Their number depends on the lengths that occur, not on how often.
BROADCAST_RUNS = 1_000_000


class CapacityTree:
    """Segment tree over remaining capacities: which of them have an open bin."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << max(1, capacity + 1).bit_length()
        self.any = bytearray(2 * self.leaves)

    def set(self, remaining: int, there: bool) -> None:
        at = remaining + self.leaves
        self.any[at] = there
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        """Smallest remaining capacity of at least ``length`` that an open bin has."""
        at = length + self.leaves
        if self.any[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


@dataclass(frozen=True)
class Run:
    """Pieces ``rank .. rank + n`` of one length: ``each`` go into every bin from ``bin`` on, from ``fill``."""

    length: int
    rank: int
    n: int
    bin: int
    each: int
    fill: int


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Best-fit-decreasing over ``counts[length]`` pieces of each length, equal pieces taken together."""
    tree, bins = CapacityTree(capacity), {}
    runs, made = [], 0

    def open_(remaining: int, start: int, n: int) -> None:
        if n and remaining:
            bins.setdefault(remaining, []).append((start, n))
            tree.set(remaining, True)

    for length in sorted(counts, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit {capacity}")
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, start, n = capacity, made, -(-left // (capacity // length))
                made += n
            else:
                start, n = bins[room].pop()
                if not bins[room]:
                    tree.set(room, False)
            # best fit puts the next equal piece into the bin just used while it fits
            each = room // length
            whole = min(n, left // each)
            if whole:
                runs.append(Run(length, rank, whole * each, start, each, capacity - room))
                open_(room - each * length, start, whole)
                rank, left, start, n = rank + whole * each, left - whole * each, start + whole, n - whole
            if left and n:
                runs.append(Run(length, rank, left, start, left, capacity - room))
                open_(room - left * length, start, 1)
                rank, left, start, n = rank + left, 0, start + 1, n - 1
            if n and room < capacity:
                open_(room, start, n)
    return runs


def pieces(docs: DataFrame, text: str, capacity: int, path: str, end_id: int) -> DataFrame:
    """Token pieces of whole texts, each document ended by ``end_id``; longer documents alone are cut.

    ``_part`` and ``_rank`` number the pieces of one length within a task, for :func:`pack`.
    """
    packed, _ = carried(docs, ["piece", "start", "length", "ids", "sequence_id", "offset", text])
    packed = packed.select("_row", F.col(text).cast("string").alias("_text"))
    fields = [("piece", T.IntegerType(), pa.int32()), ("start", T.LongType(), pa.int64()), ("length", T.LongType(), pa.int64()), ("ids", T.BinaryType(), pa.binary()), ("_part", T.LongType(), pa.int64()), ("_rank", T.LongType(), pa.int64())]
    schema = T.StructType([packed.schema["_row"], *[T.StructField(n, k) for n, k, _ in fields]])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, used, encode = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), tokens.encoder(path).encode
        for batch, texts in kernel.slices(batches, "_text"):
            rows: list[tuple] = []
            for i, ids in enumerate(encode([(t or b"").decode() for t in texts])):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    rows.append((i, k, at // 4, n, own, part, used[n]))
                    used[n] += 1
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0])), *[pa.array(c, a) for c, (_, _, a) in zip(cols[1:], fields, strict=True)]], ["_row", *[n for n, _, _ in fields]])

    return packed.mapInArrow(run, schema)


def _offsets(made: DataFrame, capacity: int) -> DataFrame:
    """For each task (``_part``) how many pieces of each length the tasks before it have, by length."""
    groups = made.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = groups.select("_part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def dense(rows: pa.Table) -> pa.Table:
        out = np.zeros(capacity + 1, np.int64)
        out[rows.column("length").to_numpy()] = rows.column("first").to_numpy()
        return pa.table([rows.column("_part").slice(0, 1), pa.array([out], pa.list_(pa.int64()))], ["_part", "offsets"])

    return first.groupBy("_part").applyInArrow(dense, "_part long, offsets array<long>")


#: A task writes its pieces to a file of its number.
_FILE = re.compile(r"/part-(\d+)-[^/]*$")
_RUN = "length long, lo long, hi long, bin long, each long, fill long"


def pack(docs: DataFrame, text: str = "text", capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document with their place: the columns of ``docs`` without ``text``, ``piece`` (from 0),
    ``start`` (the document's ids before it), ``length``, ``ids`` (little-endian unsigned 32-bit), ``sequence_id``
    and ``offset`` (gapless from 0 in each sequence).

    Input columns of those names are replaced. A null or empty text is the end id alone. Repeated rows are packed
    each. An empty table gives an empty result. No text is cut but into whole pieces of ``capacity``.
    """
    made = stored(pieces(docs, text, capacity, path or tokens.vocabulary_path(), end_id), "pieces")
    counts = {r.length: r.n for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets = stored(_offsets(made, capacity), "offsets")
    runs = best_fit_decreasing(counts, capacity)
    rows = made.sparkSession.createDataFrame([(r.length, r.rank, r.rank + r.n, r.bin, r.each, r.fill) for r in runs], _RUN)
    # some runs for each length, however many pieces there are
    rows = F.broadcast(rows) if len(runs) <= BROADCAST_RUNS else rows
    if offsets.count() * 8 * (capacity + 1) <= BROADCAST_BYTES:
        return _placed(made, offsets, rows)
    # more tasks than that: as many at a time as their offsets may be sent, from the files that they wrote; ids never move
    groups: dict[int, list[str]] = {}
    width = max(1, BROADCAST_BYTES // (8 * (capacity + 1)))
    for file in made.inputFiles():
        groups.setdefault(int(_FILE.search(file)[1]) // width, []).append(file)
    read = made.sparkSession.read.schema(made.schema)
    parts = [stored(_placed(read.parquet(*files), offsets.where((F.col("_part") >= g * width) & (F.col("_part") < (g + 1) * width)), rows), "placed") for g, files in sorted(groups.items())]
    return reduce(DataFrame.unionByName, parts)


def _placed(made: DataFrame, offsets: DataFrame, rows: DataFrame) -> DataFrame:
    """Pieces with the places that the runs ``rows`` give them; ``offsets`` are those of the tasks that made them."""
    m, p = made.join(F.broadcast(offsets), "_part").withColumn("_at", F.col("_rank") + F.get("offsets", F.col("length").cast("int"))).drop("offsets").alias("m"), rows.alias("p")
    joined = m.join(p, (F.col("m.length") == F.col("p.length")) & (F.col("m._at") >= F.col("p.lo")) & (F.col("m._at") < F.col("p.hi")))
    step = F.col("m._at") - F.col("p.lo")
    rest = [c for c in made.schema["_row"].dataType.names if c != "_none"]
    return joined.select(
        *[F.col("m._row")[c].alias(c) for c in rest],
        *[F.col(f"m.{c}") for c in ("piece", "start", "length", "ids")],
        (F.col("p.bin") + F.floor(step / F.col("p.each"))).cast("long").alias("sequence_id"),
        (F.col("p.fill") + (step % F.col("p.each")) * F.col("m.length")).cast("long").alias("offset"),
    )
