"""Maximal periodic runs of words, found on suffix trees (Stoye and Gusfield).

Texts of a slice share one suffix tree, in which words of different texts differ. It is held as a suffix array by prefix
doubling, the common prefixes of neighbours, and the intervals of these: an inner node is an interval of the array, its
string depth the least common prefix in it. For each node the leaves of all children but the largest are walked, in all
``O(n log n)``: a leaf ``i`` with ``i + depth`` (or ``i - depth``) below the same node, but on another branch, begins (or
ends) a branching tandem repeat. That is the last repeat of a run; rotated to the left as far as words allow, it gives the
run's start, and repeats that give the same stretch merge into the one of the smallest period. All steps work on whole
levels of arrays; there is no loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .common import carried

#: A run has this many words at least, and so many times its period.
LEAST, TIMES = 6, 4
#: Leaves that are walked at once.
WALK = 1 << 21


class Suffixes:
    """Suffix array and common prefixes of sequences of words that stand one after another, each closed by its own mark.

    ``same`` numbers what is compared: alike in one sequence only if the words are. ``rank[k]`` is alike for two places
    where the next ``2**k`` words are.
    """

    def __init__(self, same: np.ndarray) -> None:
        n = len(same)
        order = np.argsort(same, kind="stable")
        new = np.ones(n, bool)
        new[1:] = same[order][1:] != same[order][:-1]
        head = np.flatnonzero(new)
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(head, np.diff(np.append(head, n)))
        self.rank, width = [rank.astype(np.int32 if n < 1 << 31 else np.int64)], 1
        while True:
            alone = new & np.append(new[1:], True)
            slots = np.flatnonzero(~alone)
            if not len(slots):
                break
            at = order[slots]
            group, then = rank[at], rank[at + width]
            by = np.argsort(group * n + then, kind="stable")
            order[slots] = at = at[by]
            group, then = group[by], then[by]
            split = np.ones(len(at), bool)
            split[1:] = (group[1:] != group[:-1]) | (then[1:] != then[:-1])
            new[slots] = split
            first = np.flatnonzero(split)
            rank[at] = np.repeat(slots[first], np.diff(np.append(first, len(at))))
            self.rank.append(rank.astype(self.rank[0].dtype))
            width *= 2
        self.order, self.place = order, rank
        self.common = self._common()

    def _common(self) -> np.ndarray:
        """Words that each suffix shares with the one before it in order; 0 at both ends."""
        n, order, first = len(self.order), self.order, self.rank[0]
        out = np.zeros(n + 1, np.int64)
        i = np.flatnonzero(first[order[1:]] == first[order[:-1]]) + 1
        a, b = order[i - 1].copy(), order[i].copy()
        for k in range(len(self.rank) - 1, -1, -1):
            alike = self.rank[k][a] == self.rank[k][b]
            a += alike * (1 << k)
            b += alike * (1 << k)
        out[i] = a - order[i - 1]
        return out

    def backwards(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the sequences share which end at ``a`` and ``b``."""
        start = a
        for k in range(len(self.rank) - 1, -1, -1):
            x, y = a - (1 << k) + 1, b - (1 << k) + 1
            ok = (x >= 0) & (y >= 0)
            alike = ok & (self.rank[k][np.where(ok, x, 0)] == self.rank[k][np.where(ok, y, 0)])
            a, b = a - alike * (1 << k), b - alike * (1 << k)
        return start - a


def _nearest(common: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``at`` the nearest places before and after with a value that is no greater. ``common`` is 0 at both ends."""
    zeros = np.flatnonzero(common == 0)
    levels = [common]
    for k in range(int(np.diff(zeros).max(initial=1)).bit_length() - 1):
        levels.append(np.minimum(levels[-1][: -(1 << k)], levels[-1][1 << k :]))
    own, before, after = common[at], at - 1, at + 1
    for k in range(len(levels) - 1, -1, -1):
        least, x = levels[k], before - (1 << k) + 1
        before = before - (1 << k) * ((x >= 0) & (least[np.maximum(x, 0)] > own))
        after = after + (1 << k) * ((after < len(least)) & (least[np.minimum(after, len(least) - 1)] > own))
    return before, after


def branching_repeats(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of the branching tandem repeats (some twice)."""
    common = s.common
    edge = np.flatnonzero(common)
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    if not len(edge):
        return found[0]
    before, after = _nearest(common, edge)
    # a node is named by its first inner edge
    node = np.arange(len(common))
    node[edge] = np.where(common[before] == common[edge], before, edge)
    while True:
        up = node[node]
        if np.array_equal(up, node):
            break
        node = up
    named = node[edge]
    first = named == edge
    low, high = np.zeros(len(common), np.int64), np.zeros(len(common), np.int64)
    low[edge[first]] = before[first]
    np.maximum.at(high, named, after - 1)
    # children: from each inner edge to the next edge, and from the node's start to its first inner edge
    parent, start, end = np.concatenate([named, edge[first]]), np.concatenate([edge, before[first]]), np.concatenate([after, edge[first]])
    size = end - start
    mark = size * len(size) + np.arange(len(size))
    largest = np.zeros(len(common), np.int64)
    np.maximum.at(largest, parent, mark)
    light = np.flatnonzero(largest[parent] != mark)
    parent, start, size = parent[light], start[light], size[light]
    words, place, total = s.rank[0], s.place, np.concatenate([[0], np.cumsum(size)])
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(total, total[a] + WALK, "right")) - 1)
        n = size[a:b]
        of = np.repeat(parent[a:b], n)
        i = s.order[np.repeat(start[a:b] - total[a:b], n) + np.arange(total[a], total[b])]
        period, lo, hi = common[of], low[of], high[of]
        second = place[i + period]
        hit = np.flatnonzero((second >= lo) & (second <= hi))
        hit = hit[words[i[hit] + period[hit]] != words[i[hit] + 2 * period[hit]]]
        found.append((i[hit], period[hit]))
        back = i - period
        other = place[np.maximum(back, 0)]
        hit = np.flatnonzero((back >= 0) & (other >= lo) & (other <= hi))
        hit = hit[words[i[hit]] != words[i[hit] + period[hit]]]
        found.append((back[hit], period[hit]))
        a = b
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def maximal(s: Suffixes, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and smallest periods of the maximal runs, by start and period."""
    at, period = branching_repeats(s)
    start = at - s.backwards(at - 1, at + period - 1)
    end = at + 2 * period
    long = (end - start >= least) & (end - start >= times * period)
    start, end, period = start[long], end[long], period[long]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    by = np.lexsort((period, start))
    return start[by], (end - start)[by], period[by]


def _suffixes(t: kernel.Texts) -> tuple[Suffixes, np.ndarray]:
    """The suffixes of a slice's words, and where each text begins among them. Words are told apart by 64-bit hashes."""
    ids, per = np.unique(t.hashes(), return_inverse=True)[1], np.diff(t.first)
    first = t.first + np.arange(len(t.first))  # a mark closes each text
    same = np.empty(first[-1], np.int64)
    places = np.arange(len(ids)) + t.owner()
    width = len(ids) + 1
    same[first[1:] - 1] = np.arange(len(per)) * width
    same[places] = t.owner() * width + ids + 1
    return Suffixes(same), first


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ADDED = ["n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"]


def _columns(texts: list[bytes | None], least: int, times: int) -> list[pa.Array]:
    t = kernel.Texts(texts)
    s, first = _suffixes(t)
    start, length, period = maximal(s, least, times)
    owner = np.searchsorted(first, start, "right") - 1
    start = start - first[owner]
    edge = np.searchsorted(owner, np.arange(len(texts) + 1))
    # the greatest exponent of each text; equal fractions are equal doubles
    best = np.lexsort((period, start, -(length / np.maximum(period, 1)), owner))
    has = np.flatnonzero(np.diff(edge))
    top = best[edge[:-1][has]]
    chosen = lambda x: pa.array([dict(zip(has.tolist(), x[top].tolist(), strict=True)).get(i) for i in range(len(texts))], pa.int64())
    runs: list[list[dict]] = [[] for _ in texts]
    collapsed: list[bytes | None] = []
    for i, raw in enumerate(texts):
        words = (raw or b"").split()
        a, b = int(edge[i]), int(edge[i + 1])
        if b > a:
            step = np.zeros(len(words) + 1, np.int64)
            np.add.at(step, start[a:b] + period[a:b], 1)
            np.add.at(step, start[a:b] + length[a:b], -1)
            words = list(compress(words, np.cumsum(step)[:-1] == 0))
            runs[i] = [{"start": int(x), "length": int(y), "period": int(z)} for x, y, z in zip(start[a:b], length[a:b], period[a:b], strict=True)]
        collapsed.append(b" ".join(words))
    return [pa.array(np.diff(edge), pa.int64()), chosen(start), chosen(length), chosen(period), chosen(1000 * length // np.maximum(period, 1)), pa.array(runs, pa.list_(_RUN)), pa.array(collapsed, pa.binary()).cast(pa.string())]


def find(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``docs`` with the maximal runs of each text's words (``[^\\x20\\x09-\\x0D]+``, numbered from 0).

    A run is a stretch of consecutive words with smallest period ``p``, at least ``least`` words and ``times * p`` words
    long, that no neighbouring word extends. Added are ``n_runs``; ``start``, ``length``, ``period`` and
    ``exponent_milli`` of the run with the greatest length over period (ties: smallest start, then period), null without a run;
    ``runs`` (all of them by start, then period); and ``collapsed``, the words that stay, joined by one space, if of each run
    only the first period is kept.

    Input columns of those names are replaced, others stay. A null text has no words. Rows that repeat are judged each for
    itself. An empty table gives an empty result. A text must fit a worker, with some 250 bytes for each of its words; nothing
    is shuffled.
    """
    if times < 2:
        raise ValueError("a run repeats its period twice at least")
    packed, rest = carried(docs, _ADDED)
    packed = packed.select("_row", F.col(f"`{text}`").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in kernel.slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(texts, least, times)], ["_row", *_ADDED])

    long = T.LongType()
    span = T.ArrayType(T.StructType([T.StructField(c, long) for c in ("start", "length", "period")]))
    kinds = [*[T.StructField(c, long) for c in _ADDED[:5]], T.StructField("runs", span), T.StructField("collapsed", T.StringType())]
    out = packed.mapInArrow(run, T.StructType([packed.schema["_row"], *kinds]))
    return out.select(*[F.col("_row")[c].alias(c) for c in rest], *_ADDED)
