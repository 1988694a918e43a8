"""Benchmark items that stand in documents, exactly or within an edit budget.

Texts are folded: A-Z and the Latin-1 capitals to small letters, every other ASCII
sign to a space, runs of spaces to one. An item of ``m`` folded bytes may differ
from its place in a text by ``k`` edits. By the q-gram lemma such a place shares at
least ``m - q + 1 - k q`` q-grams with the item, on diagonals (place in text minus
place in item) that differ by at most ``k``. So q-grams of the texts are looked up
in an index of the items, counted in overlapping bands of ``k + 1`` and again as
many diagonals, and only bands that reach the bound are aligned. The alignment is
banded, global in the item and free at both ends of the text. ``q`` is ``Q``, or the
largest number that keeps the bound positive for a short item. An item too short
for an edit (``k`` = 0 and under ``Q`` bytes) is, if it is wanted, found where it
stands as it is, between spaces or ends of the text.

Items are the stated query set. They come to the driver block by block, each block
of bounded bytes that goes to the executors as one broadcast, and a worker holds every
block against all rows it reads. It keeps the indices of a few blocks; with more
blocks it reads longer slices of text for each time that it builds them all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .common import SLICE_BYTES, carried

Q = 12
#: Edits allowed, as a share of an item's folded bytes.
EDIT_RATE = 0.06
#: Folded bytes of the items in one block.
BLOCK_BYTES = 4 << 20
#: Indices of blocks that a worker keeps.
KEPT_BLOCKS = 2
#: Bytes of text for which a worker goes through blocks that it can't keep.
LONG_SLICE = 16 << 20
#: Bands from which on those of one item are aligned together, and bytes of text that are aligned at once.
TOGETHER, ALIGNED_BYTES = 64, 1 << 20
#: Shared q-grams that are counted at once; more are counted in parts.
HITS = 1 << 21

_FOLD = np.frombuffer(bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)), np.uint8)
_PART = 1 << 20


def folded(raw: bytes, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes, and which bytes of ``raw`` they are. A run of spaces ends where one of ``starts`` begins a text."""
    buf = np.frombuffer(raw, np.uint8)
    out = _FOLD[buf]
    if len(buf) > 1:  # capitals from U+00C0 to U+00DE, but the sign U+00D7
        capital = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        out[1:][capital] += 0x20
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0x20) | (out[:-1] != 0x20)
    if starts is not None:
        keep[starts] = True
    return out[keep], np.flatnonzero(keep)


def _grams(buf: np.ndarray, q: int) -> np.ndarray:
    """Rolling hashes of all q-grams, in parts so that temporaries stay small."""
    n = len(buf) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    for at in range(0, n, _PART):
        out[at : at + _PART] = kernel.window_hashes(buf[at : at + _PART + q - 1].astype(np.uint64) + np.uint64(1), q)
    return out


@dataclass(frozen=True)
class Item:
    item: int
    text: bytes
    budget: int
    bound: int
    #: Length of the q-grams it is looked up by.
    q: int

    @property
    def whole(self) -> bool:
        """Is it found only as it stands, between spaces?"""
        return self.q == len(self.text) < Q


def prepare(item: int, text: str | None, q: int = Q, rate: float = EDIT_RATE, short: bool = False) -> Item | None:
    """An item with its edit budget, and q-grams short enough that the lemma's bound is positive; None without a letter or
    digit, and for items under ``q`` bytes unless they are wanted."""
    own = folded((text or "").encode())[0].tobytes().strip()
    m = len(own)
    if not m or m < q and not short:
        return None
    k = int(rate * m)
    q = min(q, m // (k + 1))
    return Item(item, own, k, m - q + 1 - k * q, q)


def align(item: bytes, region: bytes, width: int) -> tuple[int, int, int]:
    """Least edits of the whole ``item`` with a part of ``region`` inside of diagonals ``0 .. width``, and that part."""
    a, b = np.frombuffer(item, np.uint8), np.frombuffer(region, np.uint8)
    m, far = len(a), 1 << 20
    step = np.arange(width + 1)
    rows = np.full((m + 1, width + 1), far, np.int32)
    rows[0, step <= len(b)] = 0
    padded = np.concatenate([b, np.zeros(m + width + 1, np.uint8)])
    for r in range(1, m + 1):
        # column r + d of the text is its byte r + d - 1
        there = step + r <= len(b)
        cost = np.where(padded[r - 1 : r + width] == a[r - 1], 0, 1)
        best = np.where(there, rows[r - 1] + cost, far)
        best[:-1] = np.minimum(best[:-1], rows[r - 1, 1:] + 1)
        best = np.minimum.accumulate(best - step) + step
        rows[r] = np.where(there, best, far)
        rows[r, :-1] = np.minimum(rows[r, :-1], rows[r - 1, 1:] + 1)
    d = int(np.argmin(rows[m]))
    edits, r, end = int(rows[m, d]), m, m + d
    if edits >= far:  # the region ends before any diagonal reaches the item's end
        return edits, 0, 0
    while r:
        if r + d <= len(b) and r + d > 0 and rows[r, d] == rows[r - 1, d] + (padded[r + d - 1] != a[r - 1]):
            r -= 1
        elif d < width and rows[r, d] == rows[r - 1, d + 1] + 1:
            r, d = r - 1, d + 1
        else:
            d -= 1
    return edits, d, end


def least_edits(item: bytes, regions: np.ndarray, width: int) -> np.ndarray:
    """For each row of ``regions`` (bytes, zero where a text has none) the edits that :func:`align` finds, all rows together.

    A zero byte equals none of an item's, so it costs what leaving out the item's byte does.
    """
    step = np.arange(width + 1, dtype=np.int32)
    row = np.zeros((len(regions), width + 1), np.int32)
    for r, c in enumerate(item):
        best = row + (regions[:, r : r + width + 1] != c)
        best[:, :-1] = np.minimum(best[:, :-1], row[:, 1:] + 1)
        row = np.minimum.accumulate(best - step, axis=1) + step
    return row.min(axis=1)


class _Grams:
    """Q-grams of one length of some items of a block."""

    def __init__(self, numbers: list[int], items: list[Item], q: int) -> None:
        self.q = q
        grams = [_grams(np.frombuffer(items[k].text, np.uint8), q) for k in numbers]
        all_ = np.concatenate(grams)
        order = np.argsort(all_, kind="stable")
        self.item = np.repeat(np.array(numbers, np.int32), [len(g) for g in grams])[order]
        self.place = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams])[order]
        self.keys, self.first = np.unique(all_[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(all_)))
        self.bits = max(16, int(np.ceil(np.log2(max(2, 8 * len(self.keys))))))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(self.keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def places(self, buf: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in ``buf`` whose q-gram an item has and that one text holds, the q-gram's number, and the text's."""
        h = _grams(buf, self.q)
        at = np.flatnonzero(self.seen[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
        k = np.searchsorted(self.keys, h[at])
        k[k == len(self.keys)] = 0
        same = self.keys[k] == h[at]
        at, k = at[same], k[same]
        owner = np.searchsorted(edge, at, "right") - 1
        inside = at + self.q <= edge[owner + 1]
        return at[inside], k[inside], owner[inside]

    def parts(self, k: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of item numbers that have at most ``HITS`` hits for the q-grams ``k``, or hold one item."""
        if int(self.count[k].sum()) <= HITS:
            yield 0, int(self.item.max()) + 1
            return
        often = np.bincount(k, minlength=len(self.keys))
        hits = np.cumsum(np.bincount(self.item, weights=np.repeat(often, self.count)))
        lo = 0
        while lo < len(hits):
            before = hits[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(hits, before + HITS, "right")))
            yield lo, hi
            lo = hi

    def bands(self, at: np.ndarray, k: np.ndarray, owner: np.ndarray, budget: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Text, item and band of the shared q-grams with the items ``lo .. hi``, each band once, and how many it has.

        Each diagonal counts in two bands, so that any ``k + 1`` neighbours share one.
        """
        chosen = np.flatnonzero((self.item >= lo) & (self.item < hi)) if hi - lo <= self.item.max() else np.arange(len(self.item))
        key = np.repeat(np.arange(len(self.keys)), self.count)[chosen]
        item, place = self.item[chosen].astype(np.int64), self.place[chosen].astype(np.int64)
        count = np.bincount(key, minlength=len(self.keys))
        first = np.cumsum(count) - count
        made, a, upto = None, 0, np.cumsum(count[k])
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + HITS, "right")))
            n = count[k[a:b]]
            which = np.repeat(first[k[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            own, it = np.repeat(owner[a:b], n), item[which]
            low = (np.repeat(at[a:b], n) - place[which]) // (budget[it] + 1)
            a = b
            now = _counted(np.stack([np.tile(own, 2), np.tile(it, 2), np.concatenate([low, low - 1])]), np.ones(2 * len(own), np.int64))
            made = now if made is None else _counted(np.concatenate([made[0], now[0]], axis=1), np.concatenate([made[1], now[1]]))
        return made if made is not None else (np.empty((3, 0), np.int64), np.empty(0, np.int64))


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of ``keys`` in ascending order, with the sums of their counts."""
    if not keys.shape[1]:
        return keys, counts
    order = np.lexsort(keys[::-1])
    keys = keys[:, order]
    first = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
    return keys[:, first], np.add.reduceat(counts[order], first)


class _Index:
    """Q-grams of a block of items, by their length."""

    def __init__(self, items: list[Item]) -> None:
        kernel.HELD.clear()
        self.items = items
        by: dict[int, list[int]] = {}
        for k, item in enumerate(items):
            by.setdefault(item.q, []).append(k)
        self.grams = [_Grams(numbers, items, q) for q, numbers in sorted(by.items())]
        self.budget = np.array([i.budget for i in items], np.int64)
        self.bound = np.array([i.bound for i in items], np.int64)

    def search(self, texts: list[bytes | None]) -> dict[int, dict[int, tuple[int, int, int]]]:
        """By text number and item number: edits, and first and last byte of the best place in the text."""
        raw = [t or b"" for t in texts]
        joined = b"\n".join(raw) + b"\n"
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in raw])])
        buf, source = folded(joined, offsets[:-1])
        edge = np.searchsorted(source, offsets)
        found: dict[int, dict[int, tuple[int, int, int]]] = {}
        for grams in self.grams:
            at, k, owner = grams.places(buf, edge)
            for lo, hi in grams.parts(k) if len(at) else ():
                keys, count = grams.bands(at, k, owner, self.budget, lo, hi)
                near = self._near(keys[:, count >= self.bound[keys[1]]], buf, edge)
                for i, number, b in near.T.tolist():
                    self._verify(found.setdefault(i, {}), number, b, buf, source, int(edge[i]), int(edge[i + 1]), int(offsets[i]))
        return {i: v for i, v in found.items() if v}

    def _near(self, keys: np.ndarray, buf: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """The bands (text, item, band) in which the item stands within its budget. Bands of one item are aligned together."""
        if keys.shape[1] < TOGETHER:
            return keys
        keep, order = np.zeros(keys.shape[1], bool), np.argsort(keys[1], kind="stable")
        groups = np.flatnonzero(np.diff(keys[1][order], prepend=-1))
        for a, b in zip(groups, [*groups[1:], len(order)], strict=True):
            it = self.items[keys[1][order[a]]]
            if it.whole:
                keep[order[a:b]] = True
                continue
            width = 4 * it.budget + 2
            size = len(it.text) + width
            step = max(1, ALIGNED_BYTES // size)
            for at in range(a, b, step):
                some = order[at : min(at + step, b)]
                lo = keys[2][some] * (it.budget + 1) - it.budget
                place = lo[:, None] + np.arange(size)
                there = (place >= edge[keys[0][some]][:, None]) & (place < edge[keys[0][some] + 1][:, None])
                regions = np.where(there, buf[np.where(there, place, 0)], 0)
                alike, back = np.unique(regions, axis=0, return_inverse=True)
                keep[some] = least_edits(it.text, alike, width)[back.reshape(-1)] <= it.budget
        return keys[:, keep]

    def _verify(self, own: dict[int, tuple[int, int, int]], number: int, band: int, buf: np.ndarray, source: np.ndarray, first: int, last: int, offset: int) -> None:
        """Align an item in one band of a text, ``buf[first:last]``, and keep the place if it is the best yet."""
        it = self.items[number]
        if number in own and own[number][0] == 0:
            return
        # before its first shared q-gram and after its last one a place may lie up to the budget beside the band
        lo, width = band * (it.budget + 1) - it.budget, 4 * it.budget + 2
        start, stop = max(lo, first), min(lo + len(it.text) + width, last)
        # diagonals before the text are kept: a zero byte, which no folded text has, costs as much as the item's byte left out
        before = start - lo
        region = bytes(before) + buf[start:stop].tobytes()
        if it.whole:
            padded = (b" " if start == first else buf[start - 1 : start].tobytes()) + buf[start:stop].tobytes() + (b" " if stop == last else buf[stop : stop + 1].tobytes())
            x = padded.find(b" " + it.text + b" ")
            edits, x, y = (0, before + x, before + x + len(it.text)) if x >= 0 else (1, 0, 0)
        else:
            exact = region.find(it.text)
            edits, x, y = (0, exact, exact + len(it.text)) if exact >= 0 else align(it.text, region, width)
        x, y = max(x - before, 0), y - before
        if edits <= it.budget and y > x and (number not in own or edits < own[number][0]):
            own[number] = (edits, int(source[start + x] - offset), int(source[start + y - 1] - offset) + 1)


def _blocks(bench: DataFrame, item: str, text: str, q: int, rate: float, short: bool) -> Iterator[list[Item]]:
    block, size = [], 0
    for row in bench.select(F.col(item).cast("long"), F.col(text).cast("string")).toLocalIterator():
        own = prepare(row[0], row[1], q, rate, short)
        if own:
            block.append(own)
            size += len(own.text)
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


class _Blocks:
    """The blocks of a worker; it keeps the indices of the last few, and of no other block the items.

    A handle of a broadcast would keep what it has read; what it read from stays on the worker's disk.
    """

    def __init__(self, handles: list) -> None:
        self.handles, self.kept = handles, {}

    def __iter__(self) -> Iterator[_Index]:
        for k, handle in enumerate(self.handles):
            if k not in self.kept:
                if len(self.kept) >= KEPT_BLOCKS:
                    self.kept.pop(next(iter(self.kept)))
                self.kept[k] = _Index(handle.value)
                handle.__dict__.pop("_value", None)
            yield self.kept[k]


def screen(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", q: int = Q, rate: float = EDIT_RATE, short: bool = False) -> DataFrame:
    """``docs`` with ``leaks``: for each item that stands in the text, its id, ``edits``, and ``start`` and ``end`` (in
    characters) of the best place, the first of ties by diagonal. An input column ``leaks`` is replaced.

    A null or empty text has no leaks, and stays as it is. Items that fold to no letter or digit identify nothing and
    are never found. Items under ``q`` folded bytes are found with ``short``, and only as they stand between spaces.
    Repeated items are each reported. Without items every list is empty.
    """
    leak = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("edits", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
    packed, rest = carried(docs, ["leaks"])
    packed = packed.select("_row", F.col(text).cast("string").alias("_text"))
    schema = T.StructType([packed.schema["_row"], T.StructField("leaks", T.ArrayType(leak))])
    context = docs.sparkSession.sparkContext
    # one block at a time is in the driver's Python; executors fetch a block when a worker first needs it
    handles = [context.broadcast(block) for block in _blocks(bench, item, item_text, q, rate, short)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(handles)
        most = LONG_SLICE if len(handles) > KEPT_BLOCKS else SLICE_BYTES
        for batch, texts in kernel.slices(batches, "_text", most):
            lists: list[list[dict]] = [[] for _ in texts]
            for index in blocks:
                # a search looks at a slice's bytes; longer ones are cut where texts end
                for lo, part in _cut(texts):
                    for i, own in index.search(part).items():
                        chars = lambda n, t=part[i]: len(t[:n].decode(errors="ignore"))
                        lists[lo + i] += [{"item_id": index.items[k].item, "edits": e, "start": chars(a), "end": chars(b)} for k, (e, a, b) in own.items()]
            for own in lists:
                own.sort(key=lambda x: (x["item_id"] is None, x["item_id"] or 0, x["start"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, arrow)], ["_row", "leaks"])

    out = packed.mapInArrow(run, schema)
    return out.select(*[F.col("_row")[c].alias(c) for c in rest], "leaks")


def _cut(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes | None]]]:
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= SLICE_BYTES or i == len(texts) - 1:
            yield lo, texts[lo : i + 1]
            lo, size = i + 1, 0
