"""Chaotic maps, and random projections of dense vectors to bits.

Maps are sequential; their values are drawn once on the driver for a fixed seed and
sent to the workers as matrices of a size that the input width bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import acos, cos, pi, sin, tanh

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_INPUT = 4096
_MASK = (1 << 64) - 1


def validate_input_dim(n: int) -> int:
    if not 1 <= n <= MAX_INPUT:
        raise ValueError(f"an input has 1 to {MAX_INPUT} values, not {n}")
    return n


def _bits_of(x: float) -> int:
    return int(np.float64(x).view(np.uint64))


def _rotl(x: int, n: int) -> int:
    return ((x << n) | (x >> (64 - n))) & _MASK


#: The multipliers of the 64-bit finish that spreads a map's state.
_FINISH = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def uniform(state: int) -> float:
    """A number in [0, 1) from the mixed 64 bits of a map's state."""
    for factor in _FINISH:
        state = ((state ^ (state >> 33)) * factor) & _MASK
    return ((state ^ (state >> 33)) >> 11) / (1 << 53)


class ChaoticMap:
    """A map whose step changes ``state``; iteration yields uniform numbers."""

    turns: tuple[int, ...] = (0, 32)

    def __init__(self, *state: float) -> None:
        self.state = state

    def step(self) -> tuple[float, ...]:
        raise NotImplementedError

    def next_value(self) -> float:
        self.state = self.step()
        mixed = 0
        for x, n in zip(self.state, self.turns, strict=False):
            mixed ^= _rotl(_bits_of(x), n)
        return uniform(mixed)

    def __iter__(self) -> Iterator[float]:
        while True:
            yield self.next_value()


class SineLogistic(ChaoticMap):
    """Two coupled logistic equations folded by a sine."""

    def __init__(self, x: float = 0.1, y: float = 0.2, a: float = 0.9) -> None:
        super().__init__(x, y)
        self.a = a

    def step(self) -> tuple[float, ...]:
        fold = lambda own, other: sin(pi * self.a * (other + 3) * own * (1 - own))
        x = fold(self.state[0], self.state[1])
        return x, fold(self.state[1], x)


class ChebyshevLogistic(ChaoticMap):
    """A Chebyshev polynomial of degree ``k`` coupled with a logistic equation, both folded to [-1, 1] and [0, 1]."""

    def __init__(self, x: float = 0.3, y: float = 0.4, a: float = 3.99, k: int = 4) -> None:
        super().__init__(x, y)
        self.a, self.k = a, k

    def step(self) -> tuple[float, ...]:
        x, y = self.state
        x = cos(self.k * acos(max(-1.0, min(1.0, x))) + y)
        return x, (self.a * y * (1 - y) + abs(x)) % 1.0


class CascadedSines(ChaoticMap):
    """An iterative map with infinite collapse, a logistic and a sine map in a cycle."""

    turns = (0, 21, 42)

    def __init__(self, x: float = 0.1, y: float = 0.2, z: float = 0.3, a: tuple[float, float, float] = (21.0, 3.9, 0.9)) -> None:
        super().__init__(x, y, z)
        self.a = a

    def step(self) -> tuple[float, ...]:
        x, y, z = self.state
        a, b, c = self.a
        x = sin(a / (y if abs(y) > 1e-12 else 1e-12))
        y = sin(pi * b * (z + 3) * y * (1 - y) + x)
        return x, y, sin(pi * c * (x + 3) * z * (1 - z) + y)


class CoupledLorenz(ChaoticMap):
    """Two Lorenz systems with diffusive coupling, one Runge-Kutta step of fourth order at a time."""

    turns = (0, 11, 21, 32, 42, 53)

    def __init__(self, start: tuple[float, ...] = (0.1, 0.0, 0.0, -0.1, 0.1, 0.2), coupling: float = 0.1, dt: float = 0.01) -> None:
        super().__init__(*start)
        self.coupling, self.dt = coupling, dt

    def _slope(self, s: np.ndarray) -> np.ndarray:
        x, y, z = s.reshape(2, 3).T
        flow = np.stack([10 * (y - x), x * (28 - z) - y, x * y - 8 / 3 * z], axis=1)
        flow[:, 0] += self.coupling * (x[::-1] - x)
        return flow.reshape(-1)

    def step(self) -> tuple[float, ...]:
        s, h = np.array(self.state), self.dt
        a = self._slope(s)
        b = self._slope(s + h / 2 * a)
        c = self._slope(s + h / 2 * b)
        d = self._slope(s + h * c)
        return tuple(s + h / 6 * (a + 2 * b + 2 * c + d))


class NeuralCircuit(ChaoticMap):
    """Three neurons in a ring, each driven by its neighbours through a hyperbolic tangent."""

    turns = (0, 21, 42)

    def __init__(self, x: float = 0.1, y: float = 0.2, z: float = 0.3, a: float = 3.0, b: float = 2.5, c: float = 2.8) -> None:
        super().__init__(x, y, z)
        self.weights = (a, b, c)

    def step(self) -> tuple[float, ...]:
        x, y, z = self.state
        a, b, c = self.weights
        return tanh(a * y - b * x + z), tanh(b * z - c * y + x), tanh(c * x - a * z + y)


def ternary_matrix(inputs: int, bits: int, seed: int = 42) -> np.ndarray:
    """Rows of zeros (two thirds) and signs (one sixth each)."""
    draw = np.random.Generator(np.random.PCG64(seed)).random((bits, validate_input_dim(inputs)))
    return np.where(draw < 2 / 3, 0, np.where(draw < 5 / 6, 1, -1)).astype(np.int8)


def chaotic_matrix(inputs: int, bits: int, chaos: ChaoticMap | None = None) -> np.ndarray:
    """Rows of values in [-1, 1) in the order that a map yields them."""
    source = iter(chaos or SineLogistic())
    return np.fromiter((2 * next(source) - 1 for _ in range(validate_input_dim(inputs) * bits)), np.float64, inputs * bits).reshape(bits, inputs)


def _packed(bits: np.ndarray) -> pd.Series:
    words = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
    return pd.Series(list(words))


def _projection(inputs: int, decide: Callable[[np.ndarray], np.ndarray], words: int) -> Callable[[Column], Column]:
    @F.pandas_udf("array<bigint>")
    def project(values: pd.Series) -> pd.Series:
        fits = np.array([v is not None and len(v) == inputs for v in values], bool)
        dense = np.stack([v if ok else np.zeros(inputs) for v, ok in zip(values, fits, strict=True)]).astype(np.float64) if len(values) else np.zeros((0, inputs))
        bits = decide(dense)
        bits[~fits] = False  # a wrong length has no set bit
        return _packed(bits) if len(values) else pd.Series([], dtype=object)

    return project


def random_projection(inputs: int, bits: int = 10_240, seed: int = 42) -> Callable[[Column], Column]:
    """Bit is 1 where the ternary row's sum is not negative."""
    matrix = ternary_matrix(inputs, bits, seed).astype(np.float64)
    return _projection(inputs, lambda x: x @ matrix.T >= 0, bits // 64)


def chaotic_projection(inputs: int, bits: int = 10_240, chaos: ChaoticMap | None = None) -> Callable[[Column], Column]:
    """Bit is 1 where the product with the map's row is positive."""
    matrix = chaotic_matrix(inputs, bits, chaos)
    return _projection(inputs, lambda x: x @ matrix.T > 0, bits // 64)


def voronoi_projection(inputs: int, bits: int = 10_240, chaos: ChaoticMap | None = None) -> Callable[[Column], Column]:
    """Bit is 1 where the first of the bit's two centroids is strictly nearer."""
    both = chaotic_matrix(inputs, 2 * bits, chaos)
    first, second = both[0::2], both[1::2]
    # |x - a|^2 < |x - b|^2  <=>  2 x (b - a) < |b|^2 - |a|^2
    bound = (second**2).sum(axis=1) - (first**2).sum(axis=1)
    return _projection(inputs, lambda x: 2 * (x @ (second - first).T) < bound, bits // 64)
