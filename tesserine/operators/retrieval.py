"""The retrieval cascade: cache, index, graph candidates, bucket candidates, exact scan; its counters; absences."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import check_k
from . import search
from .filters import Filter

#: Results that a cache holds, and the longest that it takes.
CACHE_ENTRIES, CACHED_K = 128, 100


@dataclass
class Metrics:
    """Counters of a session, and sums of times from which means are made."""

    counts: dict[str, int] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)

    def add(self, name: str, n: int = 1, seconds: float = 0.0) -> None:
        self.counts[name] = self.counts.get(name, 0) + n
        self.seconds[name] = self.seconds.get(name, 0.0) + seconds

    def snapshot(self) -> dict[str, float]:
        """Totals by name, and mean milliseconds of what was timed."""
        total = {f"{k}_total": v for k, v in sorted(self.counts.items())}
        return total | {f"avg_{k}_latency_ms": 1000 * self.seconds[k] / n for k, n in sorted(self.counts.items()) if self.seconds[k] and n}

    def reset(self) -> None:
        self.counts.clear()
        self.seconds.clear()


class Cache:
    """The last results by key, the oldest go first. Results are lists of a top-k, so an entry is bounded."""

    def __init__(self, entries: int = CACHE_ENTRIES) -> None:
        self.entries, self.held = entries, OrderedDict()
        self.hits = self.misses = self.evictions = 0

    def get(self, key: tuple) -> list | None:
        if key in self.held:
            self.held.move_to_end(key)
            self.hits += 1
            return self.held[key]
        self.misses += 1
        return None

    def put(self, key: tuple, rows: list) -> None:
        self.held[key] = rows
        self.held.move_to_end(key)
        while len(self.held) > self.entries:
            self.held.popitem(last=False)
            self.evictions += 1

    def clear(self) -> None:
        self.held.clear()

    def snapshot(self) -> dict[str, int]:
        return {"cache_hits_total": self.hits, "cache_misses_total": self.misses, "cache_evictions_total": self.evictions}


@dataclass(frozen=True)
class Stats:
    """What one retrieval did."""

    source: str = "exact"
    candidates: int = 0
    scored: int = 0
    fell_back_to_exact: bool = False
    seconds: float = 0.0
    best_score: float | None = None
    selectivity: float = 1.0
    strategy: str | None = None

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class Config:
    """Which candidates are tried, and how many are scored. Over ``max_candidates`` of them an exact scan answers."""

    graph: bool = False
    buckets: bool = False
    graph_depth: int = 1
    graph_fanout: int = 10
    bucket_width: int = 8
    max_candidates: int = 1000

    @classmethod
    def for_tokens(cls, tokens: int) -> Config:
        p = search.preset(tokens)
        return cls(p["graph"], p["buckets"], p["graph_depth"], p["graph_fanout"], p["bucket_width"], p["max_candidates"])


def find_similar(corpus: DataFrame, query: list[int], k: int, config: Config = Config(), edges: DataFrame | None = None, ann: Callable[[list[int], int], DataFrame] | None = None) -> tuple[DataFrame, Stats]:
    """The best ``k`` by the first way that has candidates: the index, links, buckets, all rows.

    An index or candidates may miss near rows; the exact scan does not. Candidates are scored exactly. Where there are
    more than ``max_candidates`` none is cut off: all rows are scanned instead.
    """
    check_k(k)
    if ann is not None:
        return ann(query, k), Stats("index")
    ways = []
    if config.graph and edges is not None:
        ways.append(("graph", lambda: search.graph_candidates(corpus, edges, query, config.graph_fanout, config.graph_depth)))
    if config.buckets:
        ways.append(("bucket", lambda: search.bucket_candidates(corpus, query, config.bucket_width).select("id")))
    for source, candidates in ways:
        found = candidates().select("id")
        n = found.limit(config.max_candidates + 1).count()
        if n > config.max_candidates:
            break
        if n >= k:
            return score_positions(corpus, query, found, k), Stats(source, n, n)
    return search.probe(corpus, query, k), Stats("exact", fell_back_to_exact=bool(ways))


def score_positions(corpus: DataFrame, query: list[int], candidates: DataFrame, k: int) -> DataFrame:
    """Exact scores of candidate ids (column ``id``), the best ``k``."""
    return search.probe(corpus.join(candidates.select("id").distinct(), "id", "left_semi"), query, k)


def with_stats(corpus: DataFrame, query: list[int], k: int, filter_: Filter, stats: Stats = Stats()) -> tuple[DataFrame, Stats]:
    """A filtered retrieval with its selectivity and the strategy that it stands for."""
    keep = filter_.on(corpus)
    total, matching = corpus.agg(F.count(F.lit(1)), F.count_if(keep)).first()
    hits = search.probe(corpus, query, k, filter_=filter_)
    return hits, replace(stats, candidates=matching, scored=matching, selectivity=matching / total if total else 0.0, strategy=search.filter_strategy(total, matching))


def timed(run: Callable[[], list]) -> tuple[list, float]:
    began = time.perf_counter()
    return run(), time.perf_counter() - began
