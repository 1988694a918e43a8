"""Fusion of ranked lists, and reranking."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges below the epsilon of 32-bit floats count as none.
EPSILON = 1.1920929e-7


def weights(tokens: int) -> tuple[float, float]:
    """Weights of keyword and vector scores by the number of query tokens."""
    if tokens in (1, 2):
        return 0.9, 0.1
    if tokens in (3, 4):
        return 0.7, 0.3
    return (0.4, 0.6) if 5 <= tokens <= 8 else (0.2, 0.8)


def normalized(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Scores by their place between least and greatest, per group of ``by``; all 1.0 without a range.

    Lists are results of a top-k and so bounded by k a group.
    """
    span = Window.partitionBy(*(by or [F.lit(0)]))
    low, high = F.min("score").over(span), F.max("score").over(span)
    return hits.withColumn("score", F.when(high - low < EPSILON, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low)))


def merge(keyword: DataFrame, vector: DataFrame, weight: tuple[float, float], k: int) -> DataFrame:
    """Weighted sum of both normalised lists by id; an id on one list alone has that part. ``k`` = 0 is empty."""
    parts = normalized(keyword.select("id", "score")).withColumn("score", F.col("score") * weight[0])
    parts = parts.unionByName(normalized(vector.select("id", "score")).withColumn("score", F.col("score") * weight[1]))
    return parts.groupBy("id").agg(F.sum("score").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def merge_single(hits: DataFrame, weight: float, k: int) -> DataFrame:
    return normalized(hits.select("id", "score")).withColumn("score", F.col("score") * weight).orderBy(F.desc("score"), "id").limit(k)


def recency(hits: DataFrame, now: int, half_life_days: float, blend: float = 0.7, at: str = "modified_at") -> DataFrame:
    """``blend`` of the score and the rest of a half-life decay of the row's age."""
    age = F.greatest(F.lit(0), F.lit(now) - F.col(at)) / 86400.0
    return hits.withColumn("score", blend * F.col("score") + (1 - blend) * F.pow(F.lit(2.0), -age / half_life_days))


def mmr(candidates: DataFrame, lambda_: float, k: int, group: str | None = None) -> DataFrame:
    """Maximal marginal relevance over candidate lists (``id``, ``score``, ``vector``, and ``group`` of bounded size).

    Picks one by one the highest ``lambda * score - (1 - lambda) * closest pick``, the closest at least 0. With
    ``lambda_`` of 1 or a first score of 0.99 the order is that of the scores. Returns ``rank`` from 1.
    """
    key = group or "_all"
    rows = candidates if group else candidates.withColumn("_all", F.lit(0))
    kind = dict(rows.dtypes)

    def pick(table: pa.Table) -> pa.Table:
        table = table.sort_by([("score", "descending"), ("id", "ascending")])
        score = table.column("score").to_numpy()
        v = np.array(table.column("vector").to_pylist(), np.int64).view(np.uint64)
        left, chosen, close = np.ones(len(score), bool), [], np.zeros(len(score))
        plain = lambda_ >= 1 or (len(score) and score[0] >= 0.99)
        while left.any() and len(chosen) < k:
            value = score if plain else lambda_ * score - (1 - lambda_) * close
            i = int(np.argmax(np.where(left, value, -np.inf)))
            chosen.append((i, float(value[i])))
            left[i] = False
            close = np.maximum(close, 1 - np.bitwise_count(v ^ v[i]).sum(axis=1) / (32.0 * v.shape[1]))
        at = pa.array([i for i, _ in chosen], pa.int64())
        return pa.table([table.column(key).take(at), table.column("id").take(at), pa.array([s for _, s in chosen], pa.float64()), pa.array(range(1, len(chosen) + 1), pa.int32())], [key, "id", "score", "rank"])

    out = rows.groupBy(key).applyInArrow(pick, f"{key} {kind[key]}, id {kind['id']}, score double, rank int")
    return out if group else out.drop("_all")


def parse_rerankers(spec: str, now: int = 0) -> list[Callable[[DataFrame], DataFrame]]:
    """``mmr:0.7``, ``recency:30d`` and ``recency:30d:0.7``, comma-separated."""
    made: list[Callable[[DataFrame], DataFrame]] = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        name, *args = part.split(":")
        try:
            if name == "mmr" and len(args) <= 1:
                share = float(args[0]) if args else 0.7
                if not 0 <= share <= 1:
                    raise ValueError
                made.append(lambda hits, share=share: mmr(hits, share, 1 << 30).join(hits.drop("score"), "id"))
                continue
            if name == "recency" and 1 <= len(args) <= 2 and (m := re.fullmatch(r"(\d+(?:\.\d+)?)d", args[0])):
                days, blend = float(m[1]), float(args[1]) if len(args) == 2 else 0.7
                if days <= 0 or not 0 <= blend <= 1:
                    raise ValueError
                made.append(lambda hits, days=days, blend=blend: recency(hits, now, days, blend))
                continue
        except ValueError:
            pass
        raise ValueError(f"not a reranker: {part}")
    return made


def chained(steps: Iterator[Callable[[DataFrame], DataFrame]], hits: DataFrame) -> DataFrame:
    for step in steps:
        hits = step(hits)
    return hits
