"""Removal of byte strings that stand more than once in the corpus, by induced suffix sorting of what may repeat.

1. Each string of ``length`` bytes (a window) has a key that its bytes alone decide: the least hash of the strings of half
   that length in it. Equal windows have equal keys. Neighbouring windows mostly share their key; the bytes under such windows
   are a segment, and the corpus is a hundredth as many segments as bytes.
2. Spark counts keys and segments. All windows of a segment that occurs twice repeat. A key with one segment alone is unique.
   Of the others each different segment goes once, from one chunk, to a shard of its key.
3. A shard sorts the suffixes of its segments (:mod:`induced`) and finds the windows that stand in it twice.
4. A key with a great many different segments (a phrase that many texts share) is no matter for one shard. Its windows
   are counted one by one, by 128 bits, over all executors.

Nothing but hashes, counts and segments that are neither unique nor alike leaves a chunk.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chunks, induced, kernel
from .common import carried, partitions

LENGTH = 400
#: Different segments of one key that a shard takes.
FEW = 128
#: Bytes that a shard sorts on average.
SHARD_BYTES = 8 << 20

#: What the counts say about a segment: it stands there twice or more; segments of its key must be sorted; this chunk sends
#: it; its key has too many.
_TWICE, _SORTED, _SENDER, _MANY = 1, 2, 4, 8
_SELF = 1 << 15

_MADE = f"{chunks.SENT}, _key long, _segment long"
_MADE_NAMES = [c.split()[0] for c in _MADE.split(", ")]
_FOUND = np.dtype([("key", "<i8"), ("segment", "<i8"), ("first", "<u4"), ("n", "<u4")])


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by running least values of blocks from both sides."""
    n = len(h) - width + 1
    full = np.full(-(-len(h) // width) * width, np.iinfo(h.dtype).max, h.dtype)
    full[: len(h)] = h
    block = full.reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class _Segments:
    """Segments of a chunk's texts: ``first`` window (a place in the joined texts), ``n`` windows, and the keys of both."""

    def __init__(self, texts: list[bytes | None], length: int) -> None:
        kernel.HELD.clear()
        self.length, self.texts = length, [t or b"" for t in texts]
        self.size = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        self.offsets = np.concatenate([[0], np.cumsum(self.size)])
        self.buf = np.frombuffer(b"".join(self.texts), np.uint8)
        core = length // 2
        width = length - core + 1
        empty = np.empty(0, np.int64)
        self.first = self.n = empty
        self.keys = (empty.astype(np.uint64), empty.astype(np.uint64))
        self.alone = np.empty(0, bool)
        if len(self.buf) < length:
            return
        h = kernel.window_hashes(self.buf.astype(np.uint64) + np.uint64(1), core)
        least = _least(h, width)
        whole = np.zeros(len(least) + 1, bool)  # windows that stay in one text
        for a, n in zip(self.offsets.tolist(), self.size.tolist(), strict=False):
            if n >= length:
                whole[a : a + n - length + 1] = True
        edge = np.flatnonzero(whole)
        new = np.ones(len(edge), bool)
        new[1:] = (edge[1:] != edge[:-1] + 1) | (least[edge[1:]] != least[edge[:-1]])
        # texts of exactly the next window's place begin a segment of their own
        new |= np.isin(edge, self.offsets)
        at = np.flatnonzero(new)
        self.first, self.n = edge[at], np.diff(np.append(at, len(edge)))
        key = least[self.first]
        segment = kernel.span_hashes(self.buf, self.first, self.first + self.n + length - 1)
        # windows of a segment in which the least string stands twice may repeat in it
        self.alone = ~self._twice_in(h, least, key, width)
        self.keys = (kernel.mix(key), segment)

    def _twice_in(self, h: np.ndarray, least: np.ndarray, key: np.ndarray, width: int) -> np.ndarray:
        """Whether a segment's least string stands twice or more in it."""
        # places that are least in some window are few
        wide = np.zeros(len(least) + 2 * (width - 1), np.uint64)
        wide[width - 1 : width - 1 + len(least)] = least
        at = np.flatnonzero(h == ~_least(~wide, width))
        lo, hi = np.searchsorted(at, self.first), np.searchsorted(at, self.first + self.n + width - 1)
        size = hi - lo
        total = np.concatenate([[0], np.cumsum(size)])
        hit = h[at[np.repeat(lo - total[:-1], size) + np.arange(total[-1])]] == np.repeat(key, size)
        seen = np.concatenate([[0], np.cumsum(hit)])
        return seen[total[1:]] - seen[total[:-1]] > 1

    def asked(self, bits: int) -> chunks.Distinct:
        """Keys and segments with counts; the top bit of a count marks one that may repeat in itself."""
        d = chunks.wide(*self.keys, bits)
        twice = np.zeros(len(d.counts), np.int64)
        twice[d.where[~self.alone]] = _SELF
        return chunks.Distinct(d.keys, d.where, np.minimum(d.counts, _SELF - 1) | twice, bits)

    def coded(self, answers: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """What the counts say about each segment, and where it is among the different ones."""
        where = self.asked(bits).where
        return chunks.codes_of(answers, 1)[where], where

    def windows(self, which: np.ndarray) -> np.ndarray:
        """Places of the windows of some segments."""
        n = self.n[which]
        return np.repeat(self.first[which] - np.cumsum(n) + n, n) + np.arange(n.sum())

    def of_many(self, code: np.ndarray, bits: int) -> tuple[np.ndarray, chunks.Distinct]:
        """Windows of segments whose keys have too many, but for copies that are sent from elsewhere, and their 128-bit keys."""
        own = np.flatnonzero((code & _MANY > 0) & ((code & _TWICE == 0) | (code & _SENDER > 0)))
        # a chunk sends a segment once, however often it has it
        own = own[np.sort(np.unique(self.keys[1][own] ^ self.keys[0][own], return_index=True)[1])]
        at = self.windows(own)
        if not len(at):
            return at, chunks.wide(np.empty(0, np.uint64), np.empty(0, np.uint64), bits)
        base = self.buf.astype(np.uint64) + np.uint64(1)
        return at, chunks.wide(*[kernel.window_hashes(base, self.length, lane)[at] for lane in (0, 1)], bits)


def _judge(keys: list[np.ndarray], counts: np.ndarray, chunk: np.ndarray, few: int) -> np.ndarray:
    if not len(counts):
        return counts
    key, segment = keys
    order = np.lexsort((chunk, segment, key))
    new_key = np.append(True, key[order][1:] != key[order][:-1])
    new = new_key | np.append(True, segment[order][1:] != segment[order][:-1])
    first = np.flatnonzero(new)
    total = np.add.reduceat(counts[order] & (_SELF - 1), first)
    inside = np.maximum.reduceat(counts[order] & _SELF, first) > 0
    of_key = np.cumsum(new_key[first]) - 1
    different = np.bincount(of_key)[of_key]
    code = np.where(total > 1, _TWICE, 0) | np.where((different > 1) | (inside & (total < 2)), _SORTED, 0) | np.where(different > few, _MANY, 0)
    out = np.empty(len(counts), np.int64)
    out[order] = code[np.cumsum(new) - 1] | np.where(new, _SENDER, 0)
    return out


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of consecutive numbers."""
    first = np.flatnonzero(np.append(True, np.diff(at) != 1)) if len(at) else np.empty(0, np.int64)
    return at[first], np.diff(np.append(first, len(at)))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, few: int = FEW) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` and ``removed`` (array of first byte and number of bytes of each
    maximal removed run), and ``kept``: the bytes that stay, as binary, since a cut may fall into a character.

    A byte goes if a string of ``length`` bytes covers it that also starts anywhere else, in the same text or another.
    Strings are judged on the input. Input columns of those names are replaced, others stay, the text included. A null text
    counts as empty. Shorter texts lose nothing. Rows that repeat are each other's repeats. An empty table gives an empty result.
    A key with more than ``few`` different segments is counted window by window, not sorted; the outcome is the same.
    """
    added = ["n_bytes", "n_removed", "n_spans", "removed", "kept"]
    packed, rest = carried(docs, [*added, text])
    packed = packed.select("_row", F.col(f"`{text}`").cast("string").alias("_text"), F.col(f"`{key}`").alias("_key"))
    dealt = chunks.deal(packed, F.col("_key"))
    bits = max(4, dealt.bits - 4)  # there are some 16 times fewer keys than words
    dealt = replace(dealt, rows=dealt.rows.drop("_key"), bits=bits)
    # a third of the bytes are sent, at the most that was seen
    shards = max(partitions(docs.sparkSession), dealt.size // (3 * SHARD_BYTES))
    first = chunks.judged(chunks.ask(dealt, lambda texts: _Segments(texts, length).asked(bits)), lambda keys, counts, chunk: _judge(keys, counts, chunk, few), 1, 2, dealt, _SELF, _SENDER)

    def send(rows: pa.Table, codes: pa.Table) -> pa.Table:
        """Windows of many to their buckets (from 0 up), segments to their shards (from -1 down)."""
        if not len(rows):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())], _MADE_NAMES)
        chunk, own = rows.column("_chunk")[0].as_py(), _Segments(kernel.binaries(rows.column("_text")), length)
        code, where = own.coded(codes, bits)
        asked = chunks.sent(chunk, own.of_many(code, bits)[1], coarse=64)
        for c in _MADE_NAMES[4:]:
            asked = asked.append_column(c, pa.nulls(len(asked), pa.int64()))
        which = np.flatnonzero((code & _SORTED > 0) & (code & _SENDER > 0) & (code & _MANY == 0))
        which = which[np.sort(np.unique(where[which], return_index=True)[1])]
        data, a, b = memoryview(own.buf), own.first[which], own.first[which] + own.n[which] + length - 1
        shard = -1 - (own.keys[0][which] % np.uint64(shards)).astype(np.int64)
        bytes_ = pa.array([bytes(data[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())
        key, segment = (pa.array(k[which].view(np.int64)) for k in own.keys)
        segments = pa.table([pa.array(shard), pa.array(np.full(len(which), chunk), pa.int64()), bytes_, pa.nulls(len(which), pa.binary()), key, segment], _MADE_NAMES)
        return pa.concat_tables([asked, segments])

    def settle(group: pa.Table) -> pa.Table:
        bucket = group.column("_bucket")[0].as_py()
        if bucket >= 0:
            return chunks.codes(group, lambda keys, counts, _: chunks.added(keys, counts) > 1, 2, 2)
        found, by = induced.repeated(group.column("_keys").to_pylist(), length), {}
        for chunk, k, s, at in zip(*[group.column(c).to_pylist() for c in ("_chunk", "_key", "_segment")], found, strict=True):
            start, n = _runs(at)
            if len(n):
                out = np.empty(len(n), _FOUND)
                out["key"], out["segment"], out["first"], out["n"] = k, s, start, n
                by.setdefault(chunk, []).append(out.tobytes())
        kernel.release()
        return pa.table([pa.array(list(by), pa.int64()), pa.array([3] * len(by), pa.int32()), pa.array([bucket] * len(by), pa.int64()), pa.array([b"".join(x) for x in by.values()], pa.binary())], ["_chunk", "_stage", "_bucket", "_codes"])

    second = chunks.again(dealt, first, send, _MADE).groupBy("_bucket").applyInArrow(settle, chunks.CODES)

    def cut(rows: pa.Table, codes: pa.Table) -> pa.Table:
        texts = kernel.binaries(rows.column("_text"))
        own = _Segments(texts, length)
        step = np.zeros(len(own.buf) + 1, np.int64)
        if len(own.first):
            code, _ = own.coded(codes, bits)
            whole = np.flatnonzero(code & _TWICE)
            starts, ends = [own.first[whole]], [own.first[whole] + own.n[whole]]
            at, d = own.of_many(code, bits)
            if len(at):
                at = np.sort(at[chunks.codes_of(codes, 2)[d.where] > 0])
                a, n = _runs(at)
                starts.append(a)
                ends.append(a + n)
            told = np.frombuffer(b"".join(c for s, c in zip(codes.column("_stage").to_pylist(), codes.column("_codes").to_pylist(), strict=True) if s == 3), _FOUND)
            if len(told):
                open_ = np.flatnonzero((code & _SORTED > 0) & (code & (_TWICE | _MANY) == 0))
                place = {(k, s): x for k, s, x in zip(*[k[open_].view(np.int64).tolist() for k in own.keys], own.first[open_].tolist(), strict=True)}
                pairs = [(place[k, s] + f, n) for k, s, f, n in told.tolist() if (k, s) in place]
                starts.append(np.array([a for a, _ in pairs], np.int64))
                ends.append(np.array([a + n for a, n in pairs], np.int64))
            np.add.at(step, np.concatenate(starts), 1)
            np.add.at(step, np.concatenate(ends) + length - 1, -1)
        gone = np.cumsum(step)[:-1] > 0
        kept, spans, removed = [], [], []
        for i, raw in enumerate(own.texts):
            mine = gone[own.offsets[i] : own.offsets[i + 1]]
            n = int(mine.sum())
            removed.append(n)
            if n:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
                spans.append([{"first": int(x), "n": int(y - x)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
                kept.append(own.buf[own.offsets[i] : own.offsets[i + 1]][~mine].tobytes())
            else:
                spans.append([])
                kept.append(raw)
        span = pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))
        return pa.table(
            [rows.column("_row"), rows.column("_text"), pa.array(own.size, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
            ["_row", "_text", *added],
        )

    long = T.LongType()
    spans = T.ArrayType(T.StructType([T.StructField("first", long), T.StructField("n", long)]))
    schema = T.StructType([dealt.rows.schema["_row"], T.StructField("_text", T.StringType()), *[T.StructField(c, long) for c in added[:3]], T.StructField("removed", spans), T.StructField("kept", T.BinaryType())])
    answers = first.unionByName(second)
    out = chunks.again(dealt, answers, cut, schema)
    return out.select(*[F.col("_row")[c].alias(c) for c in rest], F.col("_text").alias(text), *added)
