"""Corpus-wide counts of hashed keys that come back to the texts they stem from.

Documents are dealt into chunks by a hash, and the deal is one shuffle that all
passes read. A pass sends the distinct keys of a chunk to buckets of a hash range,
packed as arrays with their counts in the chunk, so that a key that fills a third
of the corpus arrives once from each chunk. A bucket adds the counts up and
answers each chunk with one code for each key it sent, in the same order, so that
an answer carries no keys.

Chunks and buckets grow in number, not in size. Up to ``2 ** COARSE`` buckets a chunk sends to each of them. Beyond, rows
would grow as chunks times buckets and hold ever fewer keys; so a chunk sends to ``2 ** COARSE`` coarse buckets, and relays, each
for one of these and ``SPAN`` chunks, add up what is alike, send it on to the buckets, and hand the codes back. Every row
then holds some hundred keys, however large the corpus is, and a key arrives once from each relay.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import partitions, stored

#: Bytes of text, and rows, that a chunk holds on average.
CHUNK_BYTES, CHUNK_ROWS = 2 << 20, 20_000
#: Rows of one key may hold so many chunks before they are numbered to be dealt apart.
REPEATED_CHUNKS = 4
#: Keys that a bucket holds on average.
BUCKET_KEYS = 1_500_000
#: Bits of the buckets that a chunk sends to, and chunks that a relay takes from.
COARSE, SPAN = 12, 16_384

SENT = "_bucket long, _chunk long, _keys binary, _counts binary"
CODES = "_chunk long, _stage int, _bucket long, _codes binary"


@dataclass(frozen=True)
class Chunks:
    """Dealt rows (``_chunk``, ``_row``, ``_text``), the number of buckets for their keys as a power of two, and bytes of text."""

    rows: DataFrame
    bits: int
    size: int = 0
    coarse: int = COARSE
    span: int = SPAN


@dataclass(frozen=True)
class Distinct:
    """Distinct keys of a chunk in ascending order, where each occurrence is among them, and their counts."""

    keys: tuple[np.ndarray, ...]
    where: np.ndarray
    counts: np.ndarray
    bits: int


def deal(packed: DataFrame, key: Column) -> Chunks:
    """``packed`` has ``_row`` and ``_text``; rows are dealt by a hash of ``key`` and text.

    Rows that repeat both meet in one chunk. Where rows of one key hold more than a few chunks' bytes, rows are
    numbered, written once so that every pass sees the same numbers, and dealt by their number too.
    """
    size = F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long")
    keyed = packed.groupBy(F.xxhash64(key).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size"))
    n, size, most, rows = (x or 0 for x in keyed.agg(F.sum("n"), F.sum("size"), F.max(F.when(F.col("n") > 1, F.col("size"))), F.max("n")).first())
    chunks = max(1, -(-size // CHUNK_BYTES), -(-n // CHUNK_ROWS))
    bits = max(4, int(np.ceil(np.log2(max(1.0, size / 6 / BUCKET_KEYS)))))
    by = [key, F.col("_text")]
    if most > REPEATED_CHUNKS * CHUNK_BYTES or rows > REPEATED_CHUNKS * CHUNK_ROWS:
        packed = stored(packed.withColumn("_number", F.monotonically_increasing_id()), "numbered")
        by.append(F.col("_number"))
    dealt = packed.withColumn("_chunk", F.pmod(F.xxhash64(*by), F.lit(chunks))).drop("_number")
    return Chunks(dealt.repartition(partitions(packed.sparkSession), "_chunk"), bits, size)


def narrow(h: np.ndarray, bits: int) -> Distinct:
    """Keys of the bucket's bits and 32 more. Different keys may meet; a key never splits."""
    cut = np.uint64(64 - bits - 32)
    kept, where, counts = np.unique(h >> cut, return_inverse=True, return_counts=True)
    return Distinct((kept << cut,), where, counts, bits)


def wide(a: np.ndarray, b: np.ndarray, bits: int) -> Distinct:
    """Keys of 128 bits."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    where = np.empty(len(x), np.int64)
    where[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return Distinct((x[first], y[first]), where, np.diff(np.append(first, len(x))), bits)


def _rows(d: Distinct, chunk: int, bits: int, whole: bool) -> pa.Table:
    """Keys and counts by bucket (the first ``bits`` of a key). One lane alone leaves out the bucket's bits, unless ``whole``."""
    bucket = (d.keys[0] >> np.uint64(64 - bits)).astype(np.int64)
    edge = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(edge[1:], len(bucket))[: len(edge)]
    counts = np.minimum(d.counts, 65535).astype("<u2")
    if len(d.keys) == 1 and not whole:
        low = ((d.keys[0] << np.uint64(bits)) >> np.uint64(32)).astype("<u4")
        blobs = [low[a:b].tobytes() for a, b in zip(edge, ends, strict=True)]
    else:
        blobs = [b"".join(k[a:b].astype("<u8").tobytes() for k in d.keys) for a, b in zip(edge, ends, strict=True)]
    return pa.table(
        [pa.array(bucket[edge], pa.int64()), pa.array(np.full(len(edge), chunk), pa.int64()), pa.array(blobs, pa.binary()), pa.array([counts[a:b].tobytes() for a, b in zip(edge, ends, strict=True)], pa.binary())],
        ["_bucket", "_chunk", "_keys", "_counts"],
    )


def sent(chunk: int, d: Distinct, coarse: int) -> pa.Table:
    """What a chunk sends: to the buckets, or to the coarse ones if there are more than ``2 ** coarse``."""
    return _rows(d, chunk, min(d.bits, coarse), d.bits > coarse)


def added(keys: list[np.ndarray], counts: np.ndarray) -> np.ndarray:
    """For each entry the sum of the counts of all entries with its key."""
    order = np.lexsort(tuple(keys)) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    total = np.add.reduceat(counts[order], np.flatnonzero(new)) if len(order) else counts
    out = np.empty(len(order), np.int64)
    out[order] = total[np.cumsum(new) - 1]
    return out


Judge = Callable[[list[np.ndarray], np.ndarray, np.ndarray], np.ndarray]


def _entries(group: pa.Table, lanes: int, width: int) -> tuple[list[np.ndarray], np.ndarray, list[int]]:
    """Keys and counts of all rows of a group, and how many each row has. Rows hold one lane after another."""
    blobs, sizes = group.column("_keys").to_pylist(), []
    parts: list[list[np.ndarray]] = [[] for _ in range(lanes)]
    for blob in blobs:
        n = len(blob) // (width * lanes)
        sizes.append(n)
        for k in range(lanes):
            parts[k].append(np.frombuffer(blob, f"<u{width}", n, width * n * k))
    return [np.concatenate(p) for p in parts], np.frombuffer(b"".join(group.column("_counts").to_pylist()), "<u2").astype(np.int64), sizes


def _coded(group: pa.Table, code: np.ndarray, sizes: list[int], stage: int) -> pa.Table:
    code, ends = code.astype(np.uint8).tobytes(), np.cumsum(sizes).tolist()
    return pa.table(
        [group.column("_chunk"), pa.array(np.full(len(sizes), stage), pa.int32()), group.column("_bucket"), pa.array([code[e - n : e] for e, n in zip(ends, sizes, strict=True)], pa.binary())],
        ["_chunk", "_stage", "_bucket", "_codes"],
    )


def codes(group: pa.Table, judge: Judge, stage: int, lanes: int) -> pa.Table:
    """What ``judge`` makes of the keys, counts and chunks of a bucket's entries, as unsigned bytes for each chunk."""
    keys, counts, sizes = _entries(group, lanes, 4 if lanes == 1 else 8)
    return _coded(group, judge(keys, counts, np.repeat(group.column("_chunk").to_numpy(), sizes)), sizes, stage)


def _merged(group: pa.Table, lanes: int, bits: int, flag: int) -> tuple[Distinct, np.ndarray, list[int]]:
    """The different keys of a relay with their counts, the order of entries by key and chunk, and entries of each row."""
    keys, counts, sizes = _entries(group, lanes, 8)
    order = np.lexsort((np.repeat(group.column("_chunk").to_numpy(), sizes), *keys[::-1]))
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    first = np.flatnonzero(new)
    total = np.minimum(np.add.reduceat(counts[order] & ~flag, first), (flag or 1 << 16) - 1) | np.maximum.reduceat(counts[order] & flag, first)
    where = np.empty(len(order), np.int64)
    where[order] = np.cumsum(new) - 1
    return Distinct(tuple(k[order][first] for k in keys), where, total, bits), order[first], sizes


def judged(asked: DataFrame, judge: Judge, stage: int, lanes: int, dealt: Chunks, flag: int = 0, once: int = 0) -> DataFrame:
    """Codes by chunk and bucket of what chunks of ``dealt`` asked, through relays if there are more than ``2 ** coarse`` buckets.

    ``flag`` is a bit of counts that entries of one key share, not add up; ``once`` are bits of codes that only one entry
    of a key may get.
    """
    bits, span = dealt.bits, dealt.span
    settle = lambda rows: rows.groupBy("_bucket").applyInArrow(lambda group: codes(group, judge, stage, lanes), CODES)
    if bits <= dealt.coarse:
        return settle(asked)

    def forward(group: pa.Table) -> pa.Table:
        return _rows(_merged(group, lanes, bits, flag)[0], group.column("_relay")[0].as_py(), bits, False)

    def back(group: pa.Table, answers: pa.Table) -> pa.Table:
        d, first, sizes = _merged(group, lanes, bits, flag)
        code = codes_of(answers, stage)[d.where]
        if once:
            rest = np.ones(len(code), bool)
            rest[first] = False
            code = np.where(rest, code & (255 - once), code)
        return _coded(group, code, sizes, stage)

    relayed = asked.withColumn("_relay", F.shiftleft("_bucket", 40) + F.floor(F.col("_chunk") / span))
    answers = settle(relayed.groupBy("_relay").applyInArrow(forward, SENT)).withColumnRenamed("_chunk", "_relay")
    return relayed.groupBy("_relay").cogroup(answers.groupBy("_relay")).applyInArrow(back, CODES)


def answered(asked: DataFrame, code: Callable[[np.ndarray], np.ndarray], stage: int, lanes: int, dealt: Chunks) -> DataFrame:
    """Codes of the corpus-wide counts, by chunk and bucket."""
    return judged(asked, lambda keys, counts, _: code(added(keys, counts)), stage, lanes, dealt)


def ask(chunks: Chunks, keys: Callable[[list[bytes | None]], Distinct]) -> DataFrame:
    """First pass: what ``keys`` finds in the texts of each chunk."""

    coarse = chunks.coarse

    def emit(group: pa.Table) -> pa.Table:
        out = sent(group.column("_chunk")[0].as_py(), keys(kernel.binaries(group.column("_text"))), coarse)
        kernel.release()
        return out

    return chunks.rows.groupBy("_chunk").applyInArrow(emit, SENT)


def codes_of(answers: pa.Table, stage: int) -> np.ndarray:
    """Codes of the chunk's distinct keys, in their order."""
    rows = sorted((b, c) for s, b, c in zip(answers.column("_stage").to_pylist(), answers.column("_bucket").to_pylist(), answers.column("_codes").to_pylist(), strict=True) if s == stage)
    return np.frombuffer(b"".join(c for _, c in rows), np.uint8)


def again(chunks: Chunks, answers: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: object) -> DataFrame:
    """A later pass: ``run`` gets the rows of a chunk and the answers to it."""

    def both(rows: pa.Table, codes: pa.Table) -> pa.Table:
        out = run(rows, codes)
        kernel.release()
        return out

    return chunks.rows.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(both, schema)


def sending(chunks: Chunks, answers: DataFrame, keys: Callable[[list[bytes | None], pa.Table], Distinct]) -> DataFrame:
    """A later pass that asks again, about keys that answers so far leave open."""

    coarse = chunks.coarse

    def emit(rows: pa.Table, codes: pa.Table) -> pa.Table:
        if not len(rows):
            return pa.table({"_bucket": pa.array([], pa.int64()), "_chunk": pa.array([], pa.int64()), "_keys": pa.array([], pa.binary()), "_counts": pa.array([], pa.binary())})
        return sent(rows.column("_chunk")[0].as_py(), keys(kernel.binaries(rows.column("_text")), codes), coarse)

    return again(chunks, answers, emit, SENT)
