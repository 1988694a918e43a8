"""Suffix order and common prefixes of a text by induced sorting, in blocks that may lie on disk.

A suffix is of type S if it is smaller than the one that begins a byte later, else of type L; an S suffix after an L one is
S*. The stretches from one S* position to the next are named in their order, and the sequence of names is sorted in place of
the text, by doubling, up to the bytes that are asked for. All other suffixes follow: a suffix is its first byte and the
suffix after it, so in ascending order every suffix hands its predecessor on to the queue of that byte (L), and then, in
descending order, again (S). Queues are read from the least to the greatest byte, or back, and hold what belongs to a byte in
its order: priority queues in which only whole bytes are compared. With each position goes the prefix it shares with the one
before it, which is one byte more than the least such prefix between the two that handed them on.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes that the queues of one sort hold in memory; what exceeds them goes to an unnamed file of the task.
QUEUE_BYTES = 64 << 20
#: The mark that closes each stretch of a text. It is smaller than all bytes, and no two marks are alike.
MARK = 0


class Queues:
    """Positions with common prefixes by byte, in the order of arrival. Large ones lie in a file that vanishes with its handle."""

    def __init__(self, most: int = QUEUE_BYTES) -> None:
        self.most, self.held, self.file = most, 0, None
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray] | tuple[int, int]]] = {}

    def push(self, byte: int, at: np.ndarray, common: np.ndarray) -> None:
        if len(at):
            self.parts.setdefault(byte, []).append((at, common))
            self.held += at.nbytes + common.nbytes
            if self.held > self.most:
                self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile(prefix="tesserine-queue-")
        for parts in self.parts.values():
            for i, part in enumerate(parts):
                if isinstance(part[0], np.ndarray):
                    parts[i] = (self.file.seek(0, 2), len(part[0]))
                    self.file.write(part[0].astype("<i8").tobytes() + part[1].astype("<i2").tobytes())
        self.held = 0

    def take(self, byte: int) -> tuple[np.ndarray, np.ndarray]:
        at, common = [np.empty(0, np.int64)], [np.empty(0, np.int16)]
        for part in self.parts.pop(byte, []):
            if isinstance(part[0], np.ndarray):
                self.held -= part[0].nbytes + part[1].nbytes
                at.append(part[0])
                common.append(part[1])
            else:
                self.file.seek(part[0])
                at.append(np.frombuffer(self.file.read(8 * part[1]), "<i8"))
                common.append(np.frombuffer(self.file.read(2 * part[1]), "<i2"))
        return np.concatenate(at), np.concatenate(common)


def refine(order: np.ndarray, new: np.ndarray, rank: np.ndarray, slots: np.ndarray, then: np.ndarray) -> None:
    """Put the entries in ``slots`` of ``order``, whole groups of one rank, in the order of ``then`` within their groups.

    ``new`` marks the slots at which groups begin; a group's rank is its first slot.
    """
    at = order[slots]
    group = rank[at]
    top = int(then.max(initial=0)) + 1
    by = np.argsort(group * top + then, kind="stable") if top < (1 << 62) // len(order) else np.lexsort((then, group))
    at, group, then = at[by], group[by], then[by]
    order[slots] = at
    split = np.ones(len(at), bool)
    split[1:] = (group[1:] != group[:-1]) | (then[1:] != then[:-1])
    new[slots] = split
    first = np.flatnonzero(split)
    rank[at] = np.repeat(slots[first], np.diff(np.append(first, len(at))))


def shared(new: np.ndarray) -> np.ndarray:
    """Slots of groups with more than one entry."""
    return np.flatnonzero(~(new & np.append(new[1:], True)))


def _types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is of type S, and how often its first byte stands from there on."""
    last = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    size = np.diff(np.append(-1, last))
    up = np.append(text[last[:-1] + 1] > text[last[:-1]], True)
    up[text[last] == MARK] = True
    return np.repeat(up, size), np.repeat(last + 1, size) - np.arange(len(text))


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at ``a`` and ``b`` share, up to ``most``, where they are known to share some."""
    words = np.ndarray((len(text),), ">u8", np.append(text, np.zeros(8, np.uint8)), strides=(1,))
    out = most.astype(np.int64)
    open_ = np.flatnonzero(known < most)
    off = known[open_]
    while len(open_):
        x = words[a[open_] + off].astype(np.uint64) ^ words[b[open_] + off].astype(np.uint64)
        differs = x != 0
        d, y = open_[differs], x[differs]
        same = sum((y < np.uint64(1 << (8 * k))).astype(np.int64) for k in range(1, 8))
        out[d] = np.minimum(off[differs] + same, out[d])
        open_, off = open_[~differs], off[~differs] + 8
        some = most[open_] > off
        open_, off = open_[some], off[some]
    return out


def _seeds(text: np.ndarray, s: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """S* positions in the order of their suffixes (by the first ``most`` bytes at least), and common prefixes of neighbours."""
    at = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    marks = text[at] == MARK
    n, n_marks = len(at), int(marks.sum())
    end = np.append(at[1:], at[-1])
    # names: marks come first and are told apart; other stretches go by bytes and types, seven at a time, the next S* included
    order = np.concatenate([np.flatnonzero(marks), np.flatnonzero(~marks)])
    new = np.zeros(n, bool)
    new[: n_marks + 1] = True
    rank = np.empty(n, np.int64)
    rank[order] = np.minimum(np.arange(n), n_marks)
    coded, off = (text.astype(np.int64) << 1) | s, 0
    while True:
        slots = shared(new)
        slots = slots[end[order[slots]] - at[order[slots]] >= off]
        if not len(slots):
            break
        j = order[slots]
        key = np.zeros(len(j), np.int64)
        for k in range(off, off + 7):
            p = at[j] + k
            key = (key << 9) | np.where(p <= end[j], coded[np.minimum(p, len(text) - 1)] + 1, 0)
        refine(order, new, rank, slots, key)
        off += 7
    width, near, ranks = 1, np.ones(n, bool), [rank.copy()]
    while True:
        slots = shared(new)
        slots = slots[near[slots]]
        far = at[order[slots] + width] - at[order[slots]] >= most
        near[slots[far]] = False  # alike as far as is asked
        slots = slots[~far]
        if not len(slots):
            break
        refine(order, new, rank, slots, rank[order[slots] + width])
        ranks.append(rank.copy())
        width *= 2
    # names that neighbours share, by halving widths; groups that were closed share all that is asked
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(ranks) - 1, -1, -1):
        alike = ranks[k][a] == ranks[k][b]
        a[alike] = np.minimum(a[alike] + (1 << k), n - 1)
        b[alike] = np.minimum(b[alike] + (1 << k), n - 1)
    known = np.where(new[1:], at[a] - at[order[:-1]], most)
    at = at[order]
    stop = np.flatnonzero(text == MARK)
    left = stop[np.searchsorted(stop, at)] - at
    common = np.zeros(n, np.int64)
    if n > 1:
        common[1:] = _common(text, at[:-1], at[1:], known, np.minimum(np.minimum(left[:-1], left[1:]), most))
    return at, common.astype(np.int16)


def _handed(common: np.ndarray, picked: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``picked`` places of a list, dealt by their ``key``, and for each what it shares with the one before it under that key."""
    if not len(picked):
        return
    by = np.argsort(key, kind="stable")
    picked, key = picked[by], key[by]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    before = np.append(-1, picked[:-1])
    before[first] = picked[first] - 1
    levels = [common]
    for k in range(int((picked - before).max(initial=1)).bit_length() - 1):
        levels.append(np.minimum(levels[-1][: -(1 << k)], levels[-1][1 << k :]))
    least = np.empty(len(picked), np.int16)
    level = np.frexp(picked - before)[1] - 1
    for k, row in enumerate(levels):
        own = np.flatnonzero(level == k)
        least[own] = np.minimum(row[before[own] + 1], row[picked[own] - (1 << k) + 1])
    least[first] = 0  # those before it come from another byte
    for a, b in zip(first, np.append(first[1:], len(key)), strict=True):
        yield int(key[a]), picked[a:b], least[a:b]


def _bucket(text: np.ndarray, byte: int, at: np.ndarray, common: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of a byte and a type, from those whose next byte is another one: each round puts one byte before the last."""
    ats, commons, times = [at], [common], 1
    while len(at):
        picked = np.flatnonzero(text[at - 1] == byte)
        if not len(picked):
            break
        _, picked, least = next(_handed(common, picked, np.zeros(len(picked), np.uint8)))
        at, common = at[picked] - 1, np.minimum(least + np.int16(1), most).astype(np.int16)
        common[0] = min(times, most)
        ats.append(at)
        commons.append(common)
        times += 1
    return np.concatenate(ats), np.concatenate(commons)


def sorted_suffixes(text: np.ndarray, most: int, queue_bytes: int = QUEUE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in descending order of their suffixes, a byte at a time, and the prefix (up to ``most`` bytes, less than
    32767) that each shares with the one before it, which is the next greater suffix.

    ``text`` is of unsigned bytes; it begins and ends with :data:`MARK`, and no two marks stand side by side. Suffixes end at
    the next mark. Such that share ``most`` bytes may stand in any order.
    """
    s, times = _types(text)
    seeds, seeds_common = _seeds(text, s, most)
    edge = np.searchsorted(text[seeds], np.arange(257))
    queue, lower = Queues(queue_bytes), Queues(queue_bytes)
    for byte in range(256):
        at, common = queue.take(byte)
        if len(at):
            common[0] = 0
            at, common = _bucket(text, byte, at, common, most)
            lower.push(byte, at, common)
        own, own_common = seeds[edge[byte] : edge[byte + 1]], seeds_common[edge[byte] : edge[byte + 1]].copy()
        if len(own):
            own_common[0] = min(times[at[-1]], times[own[0]], most) if len(at) else 0
        at, common = np.concatenate([at, own]), np.concatenate([common, own_common])
        before = text[at - 1]
        picked = np.flatnonzero((before > byte) & (at > 0))
        for key, which, least in _handed(common, picked, before[picked]):
            queue.push(key, at[which] - 1, np.minimum(least + np.int16(1), most).astype(np.int16))
    for byte in range(255, 0, -1):
        at, common = queue.take(byte)
        if len(at):
            common[0] = 0
            at, common = _bucket(text, byte, at, common, most)
        low, low_common = lower.take(byte)
        if len(low):
            low, low_common = low[::-1], np.roll(low_common[::-1], 1)
            low_common[0] = min(times[at[-1]], times[low[0]], most) if len(at) else 0
        at, common = np.concatenate([at, low]), np.concatenate([common, low_common])
        if not len(at):
            continue
        yield at, common
        before = text[at - 1]
        picked = np.flatnonzero((before < byte) & (before != MARK))
        for key, which, least in _handed(common, picked, before[picked]):
            queue.push(key, at[which] - 1, np.minimum(least + np.int16(1), most).astype(np.int16))


def repeated(stretches: list[bytes], length: int, queue_bytes: int = QUEUE_BYTES) -> list[np.ndarray]:
    """For each stretch the places at which a string of ``length`` bytes starts that starts anywhere else too.

    Bytes must be below 255, as those of UTF-8 are.
    """
    first = np.cumsum([1, *[len(x) + 1 for x in stretches]])
    text = np.zeros(first[-1], np.uint8)
    for a, x in zip(first[:-1], stretches, strict=True):
        text[a : a + len(x)] = np.frombuffer(x, np.uint8) + 1
    hit = np.zeros(len(text), bool)
    kept = [len(x) > 0 for x in stretches]
    if not all(kept):
        some = iter(repeated([x for x in stretches if x], length, queue_bytes))
        return [next(some) if k else np.empty(0, np.int64) for k in kept]
    if stretches:
        for at, common in sorted_suffixes(text, length, queue_bytes):
            alike = np.flatnonzero(common >= length)
            hit[at[alike]] = hit[at[alike - 1]] = True
    return [np.flatnonzero(hit[a : a + len(x)]) for a, x in zip(first[:-1], stretches, strict=True)]
