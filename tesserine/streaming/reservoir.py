"""Echo-state reservoir: time series to hypervectors.

Steps within a series follow one another, series do not: rows come sorted by series
and step, batch by batch, and each series starts with a fresh state. Many series are
stepped side by side, the columns of one matrix. Weights come from one seed and are
made once in a worker. The states of :data:`LANES` series, sparse weights and
:data:`HELD` values bound a worker's memory, however long a series is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import LIMITS

BITS = 10_240
#: Leak, inputs of a node, neighbours of a node, width of the ring they lie in, nodes between updates.
LEAK, INPUT_DEGREE, DEGREE, RING, STRIDE = 0.3, 4, 8, 512, 32
SETTLED = 1e-5
#: A state beyond two to this power is scaled down by it.
HUGE = 200
#: Series that are stepped side by side, and values of rows that are held to find them.
LANES, HELD = 64, 1 << 21


def squash(x: np.ndarray, shift: int | np.ndarray = 0) -> np.ndarray:
    """A rational approximation of the hyperbolic tangent, of ``x`` times two to the power ``shift`` and in that unit."""
    if not np.any(shift):
        return x * (x * x + 27) / (9 * x * x + 27)
    one = np.ldexp(1.0, -2 * shift)
    under = 9 * x * x + 27 * one
    return np.divide(x * (x * x + 27 * one), under, out=x / 9, where=under > 0)


class Reservoir:
    """Sparse random weights and a leaky state of which every 32nd node moves in a step, in turn.

    The approximated tangent has no bound, so states may grow with each step; the state is ``state`` times two to the
    power ``shift``, which never overflows.
    """

    def __init__(self, inputs: int, size: int = BITS, seed: int = 42, beta: float = 0.0, chaos: float = 0.0, radius: float = 0.95) -> None:
        if not 1 <= size <= 100_000 or not 1 <= inputs <= 100_000 or not 0 <= beta <= 0.5 or chaos < 0:
            raise ValueError("size and inputs are 1 to 100000, beta 0 to 0.5, chaos not negative")
        draw = np.random.Generator(np.random.PCG64(seed))
        self.inputs, self.size, self.beta, self.chaos, self.seed = inputs, size, beta, chaos, seed
        self.in_at = draw.integers(0, inputs, (size, INPUT_DEGREE))
        self.in_weight = draw.uniform(-1, 1, (size, INPUT_DEGREE))
        self.at = (np.arange(size)[:, None] + draw.integers(-RING // 2, RING // 2, (size, DEGREE))) % size
        self.weight = draw.uniform(-1, 1, (size, DEGREE))
        self.set_radius(radius)
        self.reset()

    def _times(self, x: np.ndarray) -> np.ndarray:
        return (self.weight * x[self.at]).sum(axis=1)

    def radius(self, rounds: int = 16) -> float:
        """Spectral radius by power iteration and a Rayleigh quotient."""
        x = np.full(self.size, self.size**-0.5)
        for _ in range(rounds):
            y = self._times(x)
            n = np.linalg.norm(y)
            if n == 0:
                return 0.0
            x = y / n
        return float(abs(x @ self._times(x)))

    def set_radius(self, radius: float) -> None:
        if not 0.9 <= radius <= 1.1:
            raise ValueError("a spectral radius is 0.9 to 1.1")
        now = self.radius()
        if now > 0:
            self.weight *= radius / now

    def reset(self) -> None:
        self.state, self.before, self.phase, self.shift = np.zeros(self.size), np.zeros(self.size), 0, 0
        self.noise = np.random.Generator(np.random.PCG64(self.seed + 1))

    def step(self, values: np.ndarray) -> float:
        """One step; returns how far the state moved."""
        if len(values) != self.inputs:
            raise ValueError(f"a step has {self.inputs} values, not {len(values)}")
        u = values + self.noise.uniform(-self.chaos, self.chaos, self.inputs) if self.chaos else values
        u = np.ldexp(u, -self.shift) if self.shift else u
        i = np.arange(self.phase, self.size, STRIDE)
        drive = (self.in_weight[i] * u[self.in_at[i]]).sum(axis=1) + (self.weight[i] * self.state[self.at[i]]).sum(axis=1)
        new = self.state.copy()
        new[i] = LEAK * squash(drive, self.shift) + (1 - LEAK + self.beta) * self.state[i] - self.beta * self.before[i]
        moved = float(np.linalg.norm(new - self.state))
        if self.shift:
            with np.errstate(over="ignore"):
                moved = float(np.ldexp(moved, self.shift))
        self.before, self.state, self.phase = self.state, new, (self.phase + 1) % STRIDE
        if np.abs(new[i]).max(initial=0) > 2.0**HUGE:
            self.before, self.state, self.shift = np.ldexp(self.before, -HUGE), np.ldexp(new, -HUGE), self.shift + HUGE
        return moved

    def run(self, series: np.ndarray) -> np.ndarray:
        return np.array([(self.step(v), self.state)[1] for v in series])

    def words(self) -> np.ndarray:
        """Bits by the sign of sums of equal chunks of the state."""
        return _words(self.state)


def _words(state: np.ndarray) -> np.ndarray:
    if len(state) < BITS:
        raise ValueError(f"a state of {len(state)} nodes is too small for {BITS} bits")
    chunk = len(state) // BITS
    bits = np.ascontiguousarray(state[: chunk * BITS]).reshape(BITS, chunk).sum(axis=1) > 0
    return np.packbits(bits, bitorder="little").view(np.int64)


class Lanes:
    """States of several series under one reservoir's weights, a column each; steps are those of :meth:`Reservoir.step`."""

    def __init__(self, own: Reservoir, n: int) -> None:
        self.own, self.steps = own, 0
        self.state, self.shift = np.zeros((own.size, n)), np.zeros(n, int)
        self.noise = np.random.Generator(np.random.PCG64(own.seed + 1))
        self.settled: list[list[int]] = [[] for _ in range(n)]

    def run(self, values: np.ndarray, first: np.ndarray, counts: np.ndarray) -> None:
        """Steps of rows of ``values``: ``counts`` from ``first`` on for each lane, the most in the first lane."""
        for t in range(int(counts[0]) if len(counts) else 0):
            n = int(np.searchsorted(-counts, -t))
            self._step(values[first[:n] + t].T, n)

    def _step(self, u: np.ndarray, n: int) -> None:
        r, state, shift = self.own, self.state[:, :n], self.shift[:n]
        if r.chaos:
            u = u + self.noise.uniform(-r.chaos, r.chaos, r.inputs)[:, None]
        shifted = shift.any()
        if shifted:
            u = np.ldexp(u, -shift)
        i = slice(self.steps % STRIDE, None, STRIDE)
        term = lambda weight, x, at, k: weight[i, k, None] * x[at[i, k]]
        # sums in the order in which NumPy adds up a row
        drive = term(r.in_weight, u, r.in_at, 0)
        for k in range(1, INPUT_DEGREE):
            drive += term(r.in_weight, u, r.in_at, k)
        parts = [term(r.weight, state, r.at, k) for k in range(DEGREE)]
        while len(parts) > 1:
            parts = [a + b for a, b in zip(parts[::2], parts[1::2], strict=True)]
        drive += parts[0]
        old = state[i]
        new = LEAK * squash(drive, shift if shifted else 0) + (1 - LEAK + r.beta) * old
        if r.beta:
            # no step but the last moved these nodes since, and it moved others
            new -= r.beta * old
        apart = new - old
        moved = np.sqrt((apart * apart).sum(axis=0))
        if shifted:
            with np.errstate(over="ignore"):
                moved = np.ldexp(moved, shift)
        state[i] = new
        for lane in np.flatnonzero(moved < SETTLED):
            self.settled[lane].append(self.steps)
        self.steps += 1
        high = np.flatnonzero(np.abs(new).max(axis=0, initial=0) > 2.0**HUGE)
        if len(high):
            state[:, high] = np.ldexp(state[:, high], -HUGE)
            shift[high] += HUGE

    def words(self, lane: int) -> np.ndarray:
        return _words(self.state[:, lane])


def _starts(keys: pa.Array) -> np.ndarray:
    """Rows at which another key begins."""
    try:
        code = keys.dictionary_encode("encode").indices.to_numpy()
        return np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    except pa.ArrowNotImplementedError:
        every = keys.to_pylist()
        return np.array([0, *(i for i in range(1, len(every)) if every[i] != every[i - 1])])


def _values(column: pa.Array, inputs: int) -> np.ndarray:
    n = column.value_lengths().fill_null(0).to_numpy()
    if (n != inputs).any():
        raise ValueError(f"a step has {inputs} values, not {n[n != inputs][0]}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(n), inputs)


@lru_cache(maxsize=4)
def _shared(inputs: int, size: int, seed: int, beta: float, chaos: float) -> Reservoir:
    return Reservoir(inputs, size, seed, beta, chaos)


def encode_series(rows: DataFrame, key: str, order: str, features: str, inputs: int, size: int = BITS, seed: int = 42, beta: float = 0.0, chaos: float = 0.0, longest: int | None = LIMITS["sequence"], held: int = HELD) -> DataFrame:
    """``key``, ``steps``, ``vector`` and ``attractors`` (steps at which the state settled) of each series.

    A series of over ``longest`` steps is an error; with None it may have any length. Nulls in ``order`` come last. A task
    holds ``held`` values of rows to find series in; a longer series is stepped as it comes, with the same outcome.
    """
    kind = dict(rows.dtypes)[key]
    schema = f"{key} {kind}, steps long, vector array<long>, attractors array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, rest = _shared(inputs, size, seed, beta, chaos), []
        long: tuple[pa.Array, Lanes] | None = None  # a series that goes on after the rows that came

        def made(keys: pa.Array, steps: list[int], words: list[np.ndarray], settled: list[list[int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([keys, pa.array(steps, pa.int64()), pa.array(words, pa.list_(pa.int64())), pa.array(settled, pa.list_(pa.int32()))], [key, "steps", "vector", "attractors"])

        def ended() -> Iterator[pa.RecordBatch]:
            if long is not None:
                yield made(long[0], [long[1].steps], [long[1].words(0)], long[1].settled)

        def step(keys: pa.Array, values: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
            """Step all series but the last of some rows, which waits for more unless it is all there is."""
            nonlocal rest, long
            first = _starts(keys)
            counts = np.diff(np.append(first, len(keys)))
            if long is not None:
                if _starts(pa.concat_arrays([long[0], keys.slice(0, 1)])).size > 1:
                    yield from ended()
                    long = None
                else:
                    check(long[1].steps + counts[0])
                    long[1].run(values, first[:1], counts[:1])
                    first, counts = first[1:], counts[1:]
            if not last and len(first):
                at = int(first[-1])
                if len(first) > 1 or len(keys) * inputs < held or long is not None:
                    rest = [(keys.slice(at), values[at:])]
                else:
                    check(counts[0])
                    long = (keys.slice(at, 1), Lanes(r, 1))
                    long[1].run(values, first, counts)
                first, counts = first[:-1], counts[:-1]
            if len(first) and long is not None:
                yield from ended()
                long = None
            check(counts.max(initial=0))
            order = np.argsort(-counts, kind="stable")
            for a in range(0, len(order), LANES):
                own = order[a : a + LANES]
                lanes = Lanes(r, len(own))
                lanes.run(values, first[own], counts[own])
                yield made(keys.take(pa.array(first[own])), counts[own].tolist(), [lanes.words(k) for k in range(len(own))], lanes.settled)

        def check(steps: int) -> None:
            if longest is not None and steps > longest:
                raise ValueError(f"a series has at most {longest} steps")

        def taken(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal rest
            own, rest = rest, []
            if own:
                yield from step(pa.concat_arrays([k for k, _ in own]), np.concatenate([v for _, v in own]), last)

        for batch in batches:
            if batch.num_rows:
                rest.append((batch.column(0), _values(batch.column(1), inputs)))
            if sum(v.size for _, v in rest) >= held:
                yield from taken(False)
        yield from taken(True)
        yield from ended()

    shaped = rows.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(features).alias("f"))
    # by number: a plan that adapts would put small rows into few tasks, and it is steps that take the time
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shaped.repartition(parts, "k").sortWithinPartitions("k", F.col("o").asc_nulls_last()).select("k", "f").mapInArrow(run, schema)
