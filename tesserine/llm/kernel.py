"""Vectorised byte kernels: words, lines and rolling hashes of many texts at once.

Texts are UTF-8 bytes joined by ``\\n``. Word classes of the contracts are ASCII
classes, so bytes decide them and no text is decoded. All hashes are 64 bits wide
and polynomial (Rabin-Karp) in an odd base, finished by a bijective mix.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import SLICE_BYTES

#: What a worker keeps between tasks for one kind of work. Other kinds of work drop it.
HELD: dict[str, object] = {}

_SEG = 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_M = (1 << 64) - 1


def _lut(inside: set[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(inside)] = True
    return out


_BLANK = {0x20, *range(0x09, 0x0E)}
#: ``[^\x20\x09-\x0D]``
NON_BLANK = _lut(set(range(256)) - _BLANK)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``, after A-Z became a-z
ALNUM = _lut({*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)})
NOT_NEWLINE = _lut(set(range(256)) - {0x0A})
#: First bytes of code points that stand in a word.
WORD_CHAR = _lut(set(range(256)) - _BLANK - set(range(0x80, 0xC0)))
#: A-Z to a-z, for ``bytes.translate``.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def release() -> None:
    """Give freed memory back to the system, so that workers that are used again don't add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


class _Base:
    """Powers of a base and of its inverse mod 2**64, grown on demand to at most ``_SEG`` and one window."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def tables(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, min(2 * len(self.up), _SEG + 1), 1 << 16)
            self.up, self.down = _powers(self.base, size), _powers(self.inverse, size)
        return self.up, self.down


_POW = [_Base(b) for b in _BASES]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (the finish of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def spans(buf: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes in a class."""
    m = np.empty(len(buf) + 2, np.int8)
    m[0] = m[-1] = 0
    np.take(inside.view(np.int8), buf, out=m[1:-1])
    d = np.flatnonzero(m[1:] != m[:-1])
    return d[0::2], d[1::2]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, alike for alike bytes anywhere. Temporaries stay near 1 MB of text."""
    out = np.empty(len(starts), np.uint64)
    up, down = _POW[lane].tables(_SEG + 1)
    i, n = 0, len(starts)
    while i < n:
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + _SEG, "right")))
        hi = int(ends[j - 1])
        if hi - lo > _SEG:  # one long span
            total = 0
            for at in range(lo, hi, _SEG):
                b = buf[at : min(at + _SEG, hi)].astype(np.uint64)
                b += np.uint64(1)
                b *= up[: len(b)]
                total += int(b.sum(dtype=np.uint64)) * pow(_POW[lane].base, at - lo, 1 << 64)
            out[i] = total & _M
        else:
            c = np.empty(hi - lo + 1, np.uint64)
            c[0] = 0
            b = buf[lo:hi].astype(np.uint64)
            b += np.uint64(1)
            b *= up[: hi - lo]
            np.cumsum(b, out=c[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = (c[e] - c[s]) * down[s]
        i = j
    out += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(out)


def window_hashes(words: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """Rolling hash of each run of ``n`` consecutive entries of ``words``, in parts of bounded temporaries."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out = np.empty(len(words) - n + 1, np.uint64)
    for at in range(0, len(out), _SEG):
        part = words[at : at + _SEG + n - 1]
        up, down = _POW[lane].tables(len(part) + 1)
        c = np.empty(len(part) + 1, np.uint64)
        c[0] = 0
        np.cumsum(part * up[: len(part)], out=c[1:])
        out[at : at + _SEG] = mix((c[n:] - c[:-n]) * down[: len(part) - n + 1])
    return out


class Texts:
    """Texts of a slice, joined; ``first[i]:first[i + 1]`` are the words of text ``i``."""

    def __init__(self, texts: list[bytes | None], inside: np.ndarray = NON_BLANK, lower: bool = False) -> None:
        HELD.clear()
        texts = [t or b"" for t in texts]
        self.data = b"\n".join(texts) + b"\n"
        if lower:
            self.data = self.data.translate(LOWER)
        self.buf = np.frombuffer(self.data, np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(size + 1)])
        self.starts, self.ends = spans(self.buf, inside)
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def hashes(self, lane: int = 0) -> np.ndarray:
        return span_hashes(self.buf, self.starts, self.ends, lane)

    def owner(self) -> np.ndarray:
        """The text that each word stands in."""
        return np.repeat(np.arange(len(self)), np.diff(self.first))

    def count(self, inside: np.ndarray) -> np.ndarray:
        """Bytes of a class in each text (the joining ``\\n`` is never counted twice: classes exclude it)."""
        if not len(self):
            return np.zeros(0, np.int64)
        return np.add.reduceat(inside[self.buf], self.offsets[:-1], dtype=np.int64)

    def windows(self, n: int) -> np.ndarray:
        """Starts (word numbers) of the windows of ``n`` words that stay in one text."""
        per = np.maximum(np.diff(self.first) - n + 1, 0)
        return np.repeat(self.first[:-1] - np.concatenate([[0], np.cumsum(per)])[:-1], per) + np.arange(per.sum())


def binaries(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return column.cast(pa.large_binary() if large else pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Cut batches so that a slice holds about ``most`` bytes of text, or one longer text."""
    for batch in batches:
        texts = binaries(batch.column(batch.schema.get_field_index(text)))
        lo = size = 0
        for i, t in enumerate(texts):
            size += len(t or b"")
            if size >= most or i == len(texts) - 1:
                yield batch.slice(lo, i + 1 - lo), texts[lo : i + 1]
                lo, size = i + 1, 0
    release()
