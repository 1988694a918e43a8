"""Functions over 10 240-bit hypervectors.

A vector is ``ARRAY<BIGINT>`` of 160 words; bit ``p`` is bit ``p % 64`` of word
``p // 64``, which is the little-endian layout of the 1 280 bytes. All but the
majority over large groups are column expressions and stay in the JVM. They take
any whole number of words, so a 64-bit sketch is a vector of one word.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 160
BITS = 64 * WORDS
BYTES = BITS // 8


def zero(words: int = WORDS) -> Column:
    """The vector without a set bit."""
    return F.array_repeat(F.lit(0).cast("long"), words)


def seeded(seed: Column, words: int = WORDS, prefix: str = "hv") -> Column:
    """A pseudo-random vector that depends on ``seed`` alone: the MD5 digests of prefix, seed and place."""
    # two words of 16 hexadecimal digits to each digest
    digests = F.transform(F.sequence(F.lit(0), F.lit((words - 1) // 2)), lambda i: F.md5(F.concat_ws(":", F.lit(prefix), seed.cast("string"), i.cast("string"))))
    pairs = F.transform(digests, lambda d: F.array(*[F.conv(F.substring(d, 1 + 16 * k, 16), 16, -10).cast("long") for k in (0, 1)]))
    return F.slice(F.flatten(pairs), 1, words)


def random(words: int = WORDS) -> Column:
    """A pseudo-random vector for each row, other ones in each query. A task that runs again may make others, so store them."""
    return seeded(F.uuid(), words, "random")


def sparse(seed: Column, density: float, words: int = WORDS, prefix: str = "sparse") -> Column:
    """``floor(bits * density)`` draws of a bit with replacement, all from ``seed``."""
    bits, draws = 64 * words, int(64 * words * density)
    if draws <= 0:
        return zero(words)
    places = F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda i: F.pmod(F.xxhash64(F.lit(prefix), seed.cast("string"), i), F.lit(bits)))
    return F.aggregate(places, zero(words), lambda v, p: F.transform(v, lambda w, k: F.when(k == F.floor(p / 64), w.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int")))).otherwise(w)))


def set_bit(vector: Column, place: int) -> Column:
    word, bit = divmod(place, 64)
    mask = 1 << bit
    mask = mask - (1 << 64) if mask >= 1 << 63 else mask
    return F.transform(vector, lambda w, k: F.when(k == word, w.bitwiseOR(F.lit(mask))).otherwise(w))


def bind(a: Column, b: Column) -> Column:
    """Exclusive or; its own inverse."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def weight(vector: Column) -> Column:
    """Set bits."""
    return F.aggregate(vector, F.lit(0), lambda s, w: s + F.bit_count(w))


def hamming(a: Column, b: Column) -> Column:
    return weight(bind(a, b))


def cosine(a: Column, b: Column, words: int = WORDS) -> Column:
    """``1 - 2 hamming / bits``, from -1 to 1."""
    return F.lit(1.0) - hamming(a, b) / F.lit(32.0 * words)


def _rotated(words: Column, n: int, shift: int) -> Column:
    """Rotate ``n`` words, the most significant first, left by ``shift`` bits."""
    skip, bits = (shift // 64) % n, shift % 64
    turned = F.concat(F.slice(words, skip + 1, n - skip), F.slice(words, 1, skip)) if skip else words
    if not bits:
        return turned
    after = F.concat(F.slice(turned, 2, n - 1), F.slice(turned, 1, 1))
    return F.zip_with(turned, after, lambda x, y: F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(y, 64 - bits)))


def _halves_swapped(words: Column) -> Column:
    side = lambda k: F.filter(words, lambda _, i: i % 2 == k)
    return F.flatten(F.zip_with(side(0), side(1), lambda low, high: F.array(high, low)))


def permute(vector: Column, shift: int, words: int = WORDS) -> Column:
    """Cyclic rotation in the layout of 128-bit words, the first of them the most significant."""
    return _halves_swapped(_rotated(_halves_swapped(vector), words, shift))


def permute_binary(vector: Column, shift: int, words: int = WORDS) -> Column:
    """Cyclic rotation in the layout of 64-bit words, the first of them the least significant."""
    return F.reverse(_rotated(F.reverse(vector), words, shift))


def to_bytes(vector: Column) -> Column:
    """The little-endian bytes."""
    digits = lambda w: F.lpad(F.hex(w), 16, "0")
    swapped = lambda h: F.concat(*[F.substring(h, 15 - 2 * k, 2) for k in range(8)])
    return F.unhex(F.array_join(F.transform(vector, lambda w: swapped(digits(w))), ""))


def from_bytes(data: Column, words: int = WORDS) -> Column:
    """Words of ``8 * words`` bytes; other lengths are an error."""
    word = lambda h: F.conv(F.concat(*[F.substring(h, 15 - 2 * k, 2) for k in range(8)]), 16, -10).cast("long")
    parsed = F.transform(F.regexp_extract_all(F.hex(data), F.lit("(.{16})"), 1), word)
    return F.when(F.octet_length(data) == 8 * words, parsed).otherwise(F.raise_error(F.concat(F.lit(f"a vector has {8 * words} bytes, not "), F.octet_length(data).cast("string"))))


def signs(values: Column) -> Column:
    """Sign bits (1 for ``>= 0``) of an array of numbers as one word per 64 values."""
    bit = F.transform(values, lambda v, i: F.when(v >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), (i % 64).cast("int"))).otherwise(F.lit(0).cast("long")))
    starts = F.sequence(F.lit(0), F.size(values) - 1, F.lit(64))
    return F.transform(starts, lambda s: F.aggregate(F.slice(bit, s + 1, F.lit(64)), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


_COUNTS = "array<bigint>"

#: Vectors whose bits are unpacked at once; their sums fit a byte. Keys whose counts leave a task in one batch.
BLOCK, ANSWERED = 255, 64


def _partial_counts(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Counts of each batch by key: rows of key, vector and sign. A few rows are unpacked at a time and a few keys answered, whatever a batch holds."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(1)
        values = lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, words)
        sign_ = batch.column(2).to_numpy(zero_copy_only=False)
        seen: dict[object, list[int]] = {}
        for i, k in enumerate(batch.column(0).to_pylist()):
            seen.setdefault(k, []).append(i)
        groups = list(seen.values())
        for some in (groups[i : i + ANSWERED] for i in range(0, len(groups), ANSWERED)):
            n, sums = [int(sign_[at].sum()) for at in some], []
            for at in some:
                total = np.zeros(64 * words, np.int64)
                for rows_ in (at[j : j + BLOCK] for j in range(0, len(at), BLOCK)):
                    bits = np.unpackbits(values[rows_].view(np.uint8), axis=1, bitorder="little")
                    own = sign_[rows_]
                    total += bits.sum(axis=0, dtype=np.uint8) if (own == 1).all() else own @ bits
                sums.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([at[0] for at in some])), pa.array(n, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], ["key", "n", "counts"])


def bit_counts(rows: DataFrame, keys: list[str], vector: str, words: int = WORDS, sign: str | None = None) -> DataFrame:
    """For each group the number of its vectors (``n``) and of its set bits at every place (``counts``).

    ``sign`` names a column of +1 and -1 that adds and retracts. Partial counts are made batch by batch before the
    shuffle, so that a group of any size costs a few rows for each task.
    """
    names = rows.select(F.struct(*keys).alias("key")).schema["key"].dataType
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    packed = rows.select(key.alias("key"), F.col(vector).alias("v"), (F.col(sign) if sign else F.lit(1)).cast("long").alias("sign"))
    schema = "key string, n long, counts array<long>"
    named = lambda made: made.select(F.from_json("key", names).alias("key"), "n", "counts").select("key.*", "n", "counts")

    parts = packed.mapInArrow(lambda batches: _partial_counts(batches, words), schema)
    if words <= 2:
        total = parts.groupBy("key").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("counts")[i]) for i in range(64 * words)]).alias("counts"))
        return named(total)

    def added(group: pa.Table) -> pa.Table:
        stack = group.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(group), -1).sum(axis=0)
        n = int(np.sum(group.column("n").to_numpy()))
        return pa.table([group.column("key").slice(0, 1), pa.array([n], pa.int64()), pa.array([stack], pa.list_(pa.int64()))], ["key", "n", "counts"])

    # two levels: a group's partial counts meet in a bounded number first
    salted = parts.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(16)))
    half = salted.groupBy("key", "salt").applyInArrow(lambda t: added(t.select(["key", "n", "counts"])), schema)
    return named(half.groupBy("key").applyInArrow(added, schema))


def retracted(total: DataFrame) -> DataFrame:
    """Counts of :func:`bit_counts` with ``sign``, where a group from which more was retracted than added is an error."""
    return total.withColumn("n", F.when(F.col("n") < 0, F.raise_error(F.lit("nothing is left to retract"))).otherwise(F.col("n")))


def finalized(counts: Column, n: Column, words: int = WORDS) -> Column:
    """Majority: a bit is set when more than half of ``n`` vectors set it; none of zero vectors."""
    bit = F.transform(counts, lambda c, i: F.when((n > 0) & (c > F.floor(n / 2)), F.call_function("shiftleft", F.lit(1).cast("long"), (i % 64).cast("int"))).otherwise(F.lit(0).cast("long")))
    return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda k: F.aggregate(F.slice(bit, k * 64 + 1, F.lit(64)), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


def bundle(rows: DataFrame, keys: list[str], vector: str, words: int = WORDS) -> DataFrame:
    """Bitwise strict majority of the vectors of each group: of one itself, of two their conjunction."""
    made = bit_counts(rows, keys, vector, words)
    return made.select(*keys, finalized(F.col("counts"), F.col("n"), words).alias(vector))


def majority(vectors: Iterable[np.ndarray], times: Iterable[int] | None = None) -> np.ndarray:
    """:func:`bundle` of words in memory (unsigned 64-bit), each as often as ``times`` says; a block is held at a time."""
    source, often, n, sums = iter(vectors), None if times is None else iter(times), 0, 0
    while block := list(islice(source, BLOCK)):
        bits = np.unpackbits(np.stack(block).view(np.uint8), axis=1, bitorder="little")
        if often is None:
            n, sums = n + len(block), sums + bits.sum(axis=0, dtype=np.uint8).astype(np.int64)
        else:
            each = list(islice(often, len(block)))
            n, sums = n + sum(each), sums + (np.array(each, float) @ bits).astype(np.int64)
    return np.packbits(sums > n // 2, bitorder="little").view(np.uint64) if n else np.zeros(WORDS, np.uint64)


def rotated(vector: np.ndarray, shift: int) -> np.ndarray:
    """:func:`permute` of words in memory."""
    return _turn(vector.reshape(-1, 2)[:, ::-1].reshape(-1), shift).reshape(-1, 2)[:, ::-1].reshape(-1)


def _turn(words: np.ndarray, shift: int) -> np.ndarray:
    turned, bits = np.roll(words, -(shift // 64)), shift % 64
    if not bits:
        return turned
    return (turned << np.uint64(bits)) | (np.roll(turned, -1) >> np.uint64(64 - bits))


#: Vectors that are added in one block, ``2**k - 1`` of them, and blocks at a time (their planes stay in the cache).
ADDED, AT_ONCE = 63, 8
#: Weighed vectors that are added at once.
TOGETHER = 512


def place_counts(levels: list[np.ndarray], kind: type) -> np.ndarray:
    """Set bits at every place over the first axis of ``levels[k]``, each ``2**k`` times, as numbers of ``kind``, the first bit of the first word first.

    Three words of one weight become one of it and one of the next, by five bit operations on 64 places at once.
    """
    out, rows, k = np.zeros((*levels[0].shape[1:-1], 64 * levels[0].shape[-1]), kind), levels[0], 0
    while len(rows) or k + 1 < len(levels):
        half, more = len(rows) // 2, levels[k + 1] if k + 1 < len(levels) else rows[:0]
        # what is carried, and the rows that begin at the next weight
        following, at, rest = np.concatenate([np.empty((half, *rows.shape[1:]), np.uint64), more]), 0, []
        while len(rows) > 2:
            m = len(rows) // 3
            a, b, c = rows[:m], rows[m : 2 * m], rows[2 * m : 3 * m]
            if len(rows) > 3 * m:
                rest.append(rows[3 * m :])
            rows, carried = a ^ b, following[at : at + m]
            np.bitwise_and(rows, c, out=carried)
            carried |= a & b
            rows ^= c
            at += m
            if len(rows) < 3 and rest:
                rows, rest = np.concatenate([rows, *rest]), []
        if len(rows) == 2:
            np.bitwise_and(rows[0], rows[1], out=following[at])
            rows = rows[:1] ^ rows[1:]
        if len(rows):
            bits = np.unpackbits(rows[0].byteswap().view(np.uint8), axis=-1)
            out += bits.astype(kind, copy=False) << kind(k)
        rows, k = following, k + 1
    return out


class Adder:
    """Majorities of many lists of named vectors at once. ``vectors`` makes those of some names; the ones used most are held.

    A list goes in as blocks of ``ADDED`` names; the j-th vector of a block that begins at place ``i`` is turned by
    ``stride * (i + j)`` bits (:func:`permute`). The turn by ``stride * i`` is made once, on the block's sums.
    """

    #: Vectors that are held: 84 MB.
    HELD = 1 << 16

    def __init__(self, vectors: Callable[[list], np.ndarray]) -> None:
        # row 0 is no vector
        self.vectors, self.index, self.table = vectors, {}, np.zeros((self.HELD + 1, WORDS), np.uint64)
        self.names, self.used, self.free = [None] * (self.HELD + 1), np.zeros(self.HELD + 1, np.int64), list(range(self.HELD, 0, -1))

    def _rows(self, names: Collection) -> None:
        """Hold the vectors of different names, at most half of ``HELD``."""
        new = [t for t in names if t not in self.index]
        if len(new) > len(self.free):
            # the quarter used least goes; uses of long ago count less and less
            used, most = self.used.copy(), np.iinfo(np.int64).max
            used[self.free], used[0], used[[self.index[t] for t in names if t in self.index]] = -1, most, most
            n = max(self.HELD // 4, len(new))
            self.free = np.argpartition(used, n)[:n].tolist()
            for r in self.free:
                self.index.pop(self.names[r], None)
                self.names[r] = None
            self.used -= self.used // 8
            self.used[self.free] = 0
        if new:
            rows = [self.free.pop() for _ in new]
            self.table[rows] = self.vectors(new).reshape(len(new), -1, 2)[:, :, ::-1].reshape(len(new), -1)
            self.index.update(zip(new, rows, strict=True))
            for t, r in zip(new, rows, strict=True):
                self.names[r] = t

    def sums(self, lists: Iterable[tuple[int, list[str], int]], n: int, stride: int = 0) -> np.ndarray:
        """For each of ``n`` numbers the sums at every place over its lists of names, each ``weight`` times: (number, names, weight)."""
        total, waiting = np.zeros((n, BITS), np.int32), []
        for number, names, weight in lists:
            for i in range(0, len(names), ADDED):
                waiting.append((number, i * stride % BITS, names[i : i + ADDED], weight))
                # many at a time: vectors that are new are made together
                if len(waiting) == self.HELD // (4 * ADDED):
                    self._add(total, waiting, stride)
                    waiting = []
        if waiting:
            self._add(total, waiting, stride)
        return total

    def _add(self, total: np.ndarray, blocks: list[tuple[int, int, list[str], int]], stride: int) -> None:
        self._rows(set().union(*(b[2] for b in blocks)))
        get = self.index.__getitem__
        for some in (blocks[i : i + AT_ONCE] for i in range(0, len(blocks), AT_ONCE)):
            ids = np.zeros((len(some), ADDED), np.int64)
            for k, b in enumerate(some):
                ids[k, : len(b[2])] = list(map(get, b[2]))
            np.add.at(self.used, ids.reshape(-1), 1)
            vectors = self.table[ids.T]
            if stride:
                vectors = _turned(vectors, np.arange(ADDED) * stride)
            for counts, (number, at, _, weight) in zip(place_counts([vectors], np.uint8), some, strict=True):
                own = total[number]
                times = counts if weight == 1 else counts * np.int32(weight)
                own[: BITS - at] += times[at:]
                own[BITS - at :] += times[:at]

    def weighed(self, names: list, times: np.ndarray) -> np.ndarray:
        """The sums at every place over the vectors of different names, each as often as ``times`` says."""
        total = np.zeros(BITS, np.int32)
        for i in range(0, len(names), TOGETHER):
            some, n = names[i : i + TOGETHER], times[i : i + TOGETHER]
            self._rows(some)
            ids = np.array(list(map(self.index.__getitem__, some)))
            self.used[ids] += 1
            # a name that stands c times is added once for each bit of c, by its weight
            total += place_counts([self.table[ids[n >> k & 1 == 1]] for k in range(int(n.max()).bit_length())], np.int32)
        return total


def majorities(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The vectors whose bits are set where sums (of :class:`Adder`) are more than half of ``n``."""
    words = np.packbits(sums > (n // 2)[:, None], axis=-1).view(np.uint64).byteswap()
    return words.reshape(len(sums), -1, 2)[:, :, ::-1].reshape(len(sums), -1)


def _turned(words: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """:func:`_turn` of each row of ``words[j]`` by ``shifts[j]``."""
    for j in np.flatnonzero(shifts % BITS >= 64):
        words[j] = np.roll(words[j], -(int(shifts[j]) % BITS // 64), axis=-1)
    bits = (shifts % 64).astype(np.uint64)[:, None, None]
    low = words >> (np.uint64(64) - bits)  # nothing where no bit is turned
    out = words << bits
    out[..., :-1] |= low[..., 1:]
    out[..., -1] |= low[..., 0]
    return out
