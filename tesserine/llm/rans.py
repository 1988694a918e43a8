"""Binary token files by static range asymmetric numeral systems (rANS).

A segment holds the ids of consecutive documents and is decoded by itself. Its
ids share one frequency table and are cut into blocks of ``BLOCK`` ids. A block is
coded apart from all others by ``LANES`` interleaved states of 64 bits, so blocks
can be decoded in any order and in parallel. The block index is the checkpoints:
where a block's words begin, its first id, and a checksum of its ids.

Segment layout, little-endian::

    magic "TRS1" | u32 n_docs | u64 n_tokens | u32 n_symbols | u32 n_blocks
    | u32 bytes of the zlib-packed table | u32 bytes of the zlib-packed directory
    table      n_symbols x u32 symbol, n_symbols x u32 frequency (sum 2**scale)
    directory  n_docs x u64 ids of each document
    index      n_blocks x (u64 first word, u64 first id, u32 ids, u32 crc32 of the ids)
    states     n_blocks x LANES x u64
    words      u32 each
    u32 crc32 of all before it

The scale is ``SCALE``, or as much more as twice the number of symbols needs.

Segments are rows of a Parquet table (order, documents, bytes), which any store
that Spark writes can hold.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel, tokens
from .common import partitions, stored

SCALE = 20
LANES = 32
BLOCK = 1 << 16
#: A segment ends with the document that brings it to so many ids.
SEGMENT = 1 << 22
#: Characters of a text by which rows of one key are dealt apart.
TIE = 64
#: Segments whose first ids are sent to every executor; those of more are joined by a shuffle.
BROADCAST_SEGMENTS = 1_000_000

_MAGIC = b"TRS1"
_HEAD = struct.Struct("<4sIQIIII")
_INDEX = np.dtype([("word", "<u8"), ("first", "<u8"), ("n", "<u4"), ("crc", "<u4")])
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)


def scale_for(symbols: int) -> int:
    """Bits of a table in which every symbol can have a share and most of it is left for the frequent ones."""
    return max(SCALE, symbols.bit_length() + 1)


def frequency_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that occur and their shares of the table's whole, each at least 1."""
    count = np.bincount(ids)
    symbols = np.flatnonzero(count)
    if not len(symbols):
        return symbols, count
    count, whole = count[symbols], 1 << scale_for(len(symbols))
    freq = np.maximum(1, count * whole // count.sum())
    over = int(freq.sum()) - whole
    if over < 0:
        freq[np.argmax(freq)] -= over
    for at in np.argsort(-freq) if over > 0 else ():
        take = min(over, int(freq[at]) // 2)
        freq[at] -= take
        over -= take
        if not over:
            break
    return symbols, freq


def _encode_blocks(index: np.ndarray, freq: np.ndarray, cum: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """States and words of blocks of equal length: ``index[block, id]`` are symbol numbers."""
    blocks, n = index.shape
    scale = np.uint64(scale_for(len(freq)))
    x = np.full((blocks, LANES), _LOW)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range((n - 1) // LANES * LANES, -1, -LANES):
        s = index[:, at : at + LANES]
        m = s.shape[1]
        f, y = freq[s], x[:, :m]
        full = y >= (f << (np.uint64(63) - scale))
        b, _ = np.nonzero(full)
        if len(b):
            out.append((b, (y[full] & np.uint64(0xFFFFFFFF)).astype("<u4")))
            y = np.where(full, y >> _32, y)
        q = y // f
        x[:, :m] = (q << scale) + (y - q * f) + cum[s]
    if not out:
        return x, [np.empty(0, "<u4")] * blocks
    out.reverse()  # the decoder reads forwards
    owner = np.concatenate([b for b, _ in out])
    words = np.concatenate([w for _, w in out])[np.argsort(owner, kind="stable")]
    return x, np.split(words, np.cumsum(np.bincount(owner, minlength=blocks))[:-1])


def encode(docs: list[bytes]) -> bytes:
    """One segment from the ids (little-endian unsigned 32-bit) of some documents."""
    ids = np.frombuffer(b"".join(docs), "<u4")
    symbols, freq = frequency_table(ids)
    number = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 1, np.int64)
    number[symbols] = np.arange(len(symbols))
    index, f = number[ids], freq.astype(np.uint64)
    cum = np.concatenate([[0], np.cumsum(f)])[:-1].astype(np.uint64)
    whole = len(ids) // BLOCK
    parts = [index[: whole * BLOCK].reshape(whole, BLOCK)] if whole else []
    if len(ids) % BLOCK:
        parts.append(index[whole * BLOCK :].reshape(1, -1))
    coded = [_encode_blocks(p, f, cum) for p in parts]
    words = [w for _, ws in coded for w in ws]
    table = np.zeros(len(words), _INDEX)
    table["word"] = np.concatenate([[0], np.cumsum([len(w) for w in words])])[:-1] if words else []
    table["first"] = np.arange(len(words)) * BLOCK
    table["n"] = [min(BLOCK, len(ids) - k * BLOCK) for k in range(len(words))]
    table["crc"] = [zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].tobytes()) for k in range(len(words))]
    packed = zlib.compress(symbols.astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 6)
    sizes = zlib.compress(np.array([len(d) // 4 for d in docs], "<u8").tobytes(), 6)
    head = _HEAD.pack(_MAGIC, len(docs), len(ids), len(symbols), len(words), len(packed), len(sizes))
    body = b"".join([head, packed, sizes, table.tobytes(), *[x.astype("<u8").tobytes() for x, _ in coded], *[w.tobytes() for w in words]])
    return body + struct.pack("<I", zlib.crc32(body))


class Segment:
    """A segment opened for decoding. ``checked`` compares the checksum of the whole first."""

    def __init__(self, data: bytes, checked: bool = True) -> None:
        if checked and zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a segment's checksum differs")
        magic, self.n_docs, self.n_tokens, n, blocks, a, b = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a segment")
        at = _HEAD.size
        table = np.frombuffer(zlib.decompress(data[at : at + a]), "<u4")
        self.symbols, self.freq = table[:n], table[n:].astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)])[:-1].astype(np.uint64)
        self.slots = np.repeat(np.arange(n, dtype=np.int32), table[n:])
        at += a
        self.sizes = np.frombuffer(zlib.decompress(data[at : at + b]), "<u8").astype(np.int64)
        at += b
        self.index = np.frombuffer(data, _INDEX, blocks, at)
        at += self.index.nbytes
        self.states = np.frombuffer(data, "<u8", blocks * LANES, at).reshape(blocks, LANES)
        at += self.states.nbytes
        self.words = np.frombuffer(data, "<u4", (len(data) - 4 - at) // 4, at)

    def _decode(self, which: np.ndarray, n: int) -> np.ndarray:
        x, next_ = self.states[which].astype(np.uint64), self.index["word"][which].astype(np.int64)
        out = np.empty((len(which), n), "<u4")
        scale = np.uint64(scale_for(len(self.symbols)))
        low = (np.uint64(1) << scale) - np.uint64(1)
        for at in range(0, n, LANES):
            y = x[:, : min(LANES, n - at)]
            slot = y & low
            s = self.slots[slot]
            out[:, at : at + LANES] = self.symbols[s]
            y = self.freq[s] * (y >> scale) + slot - self.cum[s]
            need = y < _LOW
            ahead = np.cumsum(need, axis=1)
            if ahead[:, -1].any():
                place = (next_[:, None] + ahead - 1)[need]
                y[need] = (y[need] << _32) | self.words[place]
                next_ += ahead[:, -1]
            x[:, : y.shape[1]] = y
        return out

    def block(self, k: int) -> np.ndarray:
        """Ids of block ``k`` alone, from its checkpoint."""
        own = self._decode(np.array([k]), int(self.index["n"][k]))[0]
        if zlib.crc32(own.tobytes()) != self.index["crc"][k]:
            raise ValueError(f"block {k}'s checksum differs")
        return own

    def ids(self) -> np.ndarray:
        whole = int(self.n_tokens) // BLOCK
        parts = [self._decode(np.arange(whole), BLOCK).reshape(-1)] if whole else []
        if whole < len(self.index):
            parts.append(self._decode(np.array([whole]), int(self.index["n"][whole]))[0])
        out = np.concatenate(parts) if parts else np.empty(0, "<u4")
        for k, row in enumerate(self.index):
            if zlib.crc32(out[k * BLOCK : k * BLOCK + int(row["n"])].tobytes()) != row["crc"]:
                raise ValueError(f"block {k}'s checksum differs")
        return out

    def documents(self) -> Iterator[bytes]:
        ids, at = self.ids(), 0
        for n in self.sizes.tolist():
            yield ids[at : at + n].tobytes()
            at += n


_SEGMENTS = "part long, segment long, n_tokens long, keys array<long>, data binary"


def write_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 1) -> DataFrame:
    """Encode every whole text of ``docs``, in ascending ``key`` order (nulls first, ties by text), and write the segments.

    Returns the written table: ``part``, ``segment`` (together the order), ``n_tokens``, ``keys`` of the documents and
    ``data``. Null and empty texts are the end id alone. Repeated rows are kept. An empty table writes no segment.
    """
    spark = docs.sparkSession
    vocabulary, end = path or tokens.vocabulary_path(), np.array([end_id], "<u4").tobytes()
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("_text"))
    # rows of one key, or of none, are dealt by how their text begins, which keeps the order by text
    tie = F.substring("_text", 1, TIE)
    rows = rows.repartitionByRange(partitions(spark), F.col("_key").asc_nulls_first(), tie.asc_nulls_first()).sortWithinPartitions(F.col("_key").asc_nulls_first(), "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, keys, own, size = TaskContext.get().partitionId(), 0, [], [], 0
        encode_ = tokens.encoder(vocabulary).encode

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([segment], pa.int64()), pa.array([size], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([encode(own)], pa.binary())],
                ["part", "segment", "n_tokens", "keys", "data"],
            )

        for batch, texts in kernel.slices(batches, "_text"):
            for k, ids in zip(batch.column(0).to_pylist(), encode_([(t or b"").decode() for t in texts]), strict=True):
                keys.append(k)
                own.append(ids + end)
                size += len(own[-1]) // 4
                if size >= SEGMENT:
                    yield done()
                    segment, keys, own, size = segment + 1, [], [], 0
        if keys:
            yield done()

    return stored(rows.mapInArrow(run, _SEGMENTS), "tokens")


def read_tokens(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents of written segments: ``key``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row["data"])
                n = segment.sizes
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(n), pa.int64()), pa.array([row["segment"]] * len(n), pa.int64()), pa.array(row["keys"], pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n), pa.array(segment.documents(), pa.binary())],
                    ["_part", "_segment", "_key", "_before", "n_tokens", "ids"],
                )

    docs = segments.select("part", "segment", "keys", "data").mapInArrow(run, "_part long, _segment long, _key long, _before long, n_tokens long, ids binary")
    # one row for each few million ids: the running sum over all of them is small
    order = Window.orderBy("part", "segment").rowsBetween(Window.unboundedPreceding, -1)
    first = segments.select(F.col("part").alias("_part"), F.col("segment").alias("_segment"), F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("_first"))
    if segments.select("part").count() <= BROADCAST_SEGMENTS:
        first = F.broadcast(first)
    return docs.join(first, ["_part", "_segment"]).select(F.col("_key").alias(key), (F.col("_first") + F.col("_before")).alias("start"), "n_tokens", "ids")


def round_trip(docs: DataFrame, **kind: object) -> DataFrame:
    """What :func:`read_tokens` gives back of :func:`write_tokens`."""
    return read_tokens(write_tokens(docs, **kind), str(kind.get("key", "doc_id")))
