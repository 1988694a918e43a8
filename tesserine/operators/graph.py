"""Traversal, paths and retrieval over weighted directed edges.

Levels are walked together: each step joins the frontier with the edges once. The
steps are written to the session's checkpoint folder, so lineage stays short and a
lost executor costs one step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import LIMITS
from ..sources.tables import cut

#: Cost of an edge of no strength: half of the largest 32-bit float.
NO_STRENGTH = 1.7014117331926443e38


@dataclass(frozen=True)
class Traversal:
    max_depth: int = 3
    max_results: int = 100
    min_strength: float = 0.0

    def __post_init__(self) -> None:
        if not 0 <= self.max_depth <= LIMITS["traversal_depth"] or not 1 <= self.max_results <= LIMITS["traversal_results"]:
            raise ValueError("a traversal has at most 32 levels and 10000 results")


def bfs(edges: DataFrame, start: str, config: Traversal = Traversal()) -> DataFrame:
    """``id`` and ``depth`` of the nodes reached, the start included; the nearest first, ties by id."""
    spark = edges.sparkSession
    ways = edges.where(F.col("strength") >= config.min_strength).select(F.col("from_id").alias("id"), "to_id")
    seen = spark.createDataFrame([(start, 0)], "id string, depth int")
    front = seen
    for depth in range(1, config.max_depth + 1):
        front = cut(front.join(ways, "id").select(F.col("to_id").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.orderBy("depth", "id").limit(config.max_results)


def _best_paths(edges: DataFrame, start: str, goal: str, cost: Column, config: Traversal) -> DataFrame:
    """One row with the cheapest path of at most ``max_depth`` edges, or none. Ties go to the smaller path.

    First, from both ends by turns, costs alone are relaxed, an edge longer each round, from the side that has the smaller
    front. They bound what a path can cost, and end when no longer path can cost less. Then paths are made, but only over
    edges that can be on one within the bound, so paths travel for few nodes.
    """
    ways = edges.where(F.col("strength") >= config.min_strength).select(F.col("from_id").alias("at"), F.col("to_id").alias("to"), cost.alias("step"))
    if start == goal:
        return edges.sparkSession.createDataFrame([([start], 0.0)], "path array<string>, cost double")
    found = _bounded(ways, start, goal, config.max_depth)
    if found is None:
        return edges.sparkSession.createDataFrame([], "path array<string>, cost double")
    near, bound = found
    return _paths(near, start, goal, bound, config.max_depth)


def _relaxed(known: DataFrame, front: DataFrame, ways: DataFrame, bound: float | None) -> tuple[DataFrame, DataFrame]:
    """Costs one edge further: all of them, and those that are new or less. Nothing over the bound goes on."""
    new = front.join(ways, "at").groupBy(F.col("to").alias("at")).agg(F.min(F.col("cost") + F.col("step")).alias("cost"))
    new = new if bound is None else new.where(F.col("cost") <= bound)
    better = cut(new.join(known.select("at", F.col("cost").alias("old")), "at", "left").where(F.col("old").isNull() | (F.col("cost") < F.col("old"))).select("at", "cost"))
    return cut(known.join(better.select("at"), "at", "left_anti").unionByName(better)), better


def _bounded(ways: DataFrame, start: str, goal: str, depth: int) -> tuple[DataFrame, float] | None:
    """Edges that may lie on a path as cheap as the cheapest, and a bound of its cost; None without a path."""
    spark = ways.sparkSession
    least = ways.agg(F.min("step")).first()[0]
    if least is None:
        return None
    back = ways.select(F.col("to").alias("at"), F.col("at").alias("to"), "step")
    known = [spark.createDataFrame([(n, 0.0)], "at string, cost double") for n in (start, goal)]
    front, sizes, lowest, bound = list(known), [1, 1], [0.0, 0.0], None
    for _ in range(depth):
        side = 0 if sizes[0] <= sizes[1] else 1
        known[side], front[side] = _relaxed(known[side], front[side], (ways, back)[side], bound if least >= 0 else None)
        sizes[side], lowest[side] = front[side].agg(F.count(F.lit(1)), F.min("cost")).first()
        met = known[0].join(known[1].select("at", F.col("cost").alias("rest")), "at").agg(F.min(F.col("cost") + F.col("rest"))).first()[0]
        if met is not None:  # sums in another order may differ in their last digits
            bound = met + 1e-9 * max(1.0, abs(met))
        if not sizes[side] or (least >= 0 and bound is not None and lowest[0] + lowest[1] > bound):
            break
    if bound is None:
        return None
    if least < 0:
        return ways, float("inf")
    # an edge on such a path is within the bound from the side that has reached its ends
    a, b = known[0].select("at", F.col("cost").alias("_a")), known[1].select(F.col("at").alias("to"), F.col("cost").alias("_b"))
    from_start = ways.join(a, "at").where(F.col("_a") + F.col("step") <= bound).select("at", "to", "step")
    to_goal = ways.join(b, "to").where(F.col("_b") + F.col("step") <= bound).select("at", "to", "step")
    return cut(from_start.unionByName(to_goal).distinct()), bound


def _paths(ways: DataFrame, start: str, goal: str, bound: float, depth: int) -> DataFrame:
    """The cheapest path over few edges, by relaxation of whole paths; a node goes on when more edges reach it cheaper."""
    known = ways.sparkSession.createDataFrame([(start, 0.0, [start])], "at string, cost double, path array<string>")
    front = known
    for _ in range(depth):
        new = front.join(ways, "at").where(~F.array_contains("path", F.col("to")))
        new = new.select(F.col("to").alias("at"), (F.col("cost") + F.col("step")).alias("cost"), F.concat("path", F.array("to")).alias("path")).where(F.col("cost") <= bound)
        best = new.groupBy("at").agg(F.min(F.struct("cost", "path")).alias("b")).select("at", "b.cost", "b.path")
        before = known.select("at", F.struct("cost", "path").alias("k"))
        front = cut(best.join(before, "at", "left").where(F.col("k").isNull() | (F.struct("cost", "path") < F.col("k"))).select("at", "cost", "path"))
        if front.isEmpty():
            break
        known = cut(known.join(front.select("at"), "at", "left_anti").unionByName(front))
    return known.where(F.col("at") == goal).select("path", "cost")


def shortest_path(edges: DataFrame, start: str, goal: str, config: Traversal = Traversal()) -> DataFrame:
    """Path of least ``-ln(strength)`` by relaxation, one edge longer each round (so the depth limit is exact)."""
    return _best_paths(edges, start, goal, F.when(F.col("strength") > 0, -F.log("strength")).otherwise(F.lit(NO_STRENGTH)), config)


def shortest_path_hops(edges: DataFrame, start: str, goal: str, config: Traversal = Traversal()) -> DataFrame:
    return _best_paths(edges, start, goal, F.lit(1.0), config)


def decayed(strength: Column, elapsed: Column, curve: str = "none", seconds: int = 1, drop: float = 0.0) -> Column:
    """Strength after ``elapsed`` seconds by ``none``, ``linear``, ``exponential`` (half-life) or ``step``."""
    match curve:
        case "none":
            return strength
        case "linear":
            return F.when(elapsed >= seconds, F.lit(0.0)).otherwise(strength * (1 - elapsed / F.lit(float(seconds))))
        case "exponential":
            return strength * F.pow(F.lit(0.5), elapsed / F.lit(float(seconds)))
        case "step":
            return F.when(elapsed >= seconds, F.greatest(strength - drop, F.lit(0.0))).otherwise(strength)
    raise ValueError(f"unknown curve {curve}")


def with_decay(edges: DataFrame, now: int, **curve: object) -> DataFrame:
    elapsed = F.greatest(F.lit(0), F.lit(now) - F.col("created_at"))
    return edges.withColumn("strength", decayed(F.col("strength"), elapsed, **curve))


def outgoing(edges: DataFrame, node: str, now: int, **curve: object) -> DataFrame:
    return with_decay(edges.where(F.col("from_id") == node), now, **curve).select("to_id", "strength")


def incoming(edges: DataFrame, node: str, now: int, **curve: object) -> DataFrame:
    """In-edges, the strongest first."""
    return with_decay(edges.where(F.col("to_id") == node), now, **curve).select("from_id", "strength").orderBy(F.desc("strength"), "from_id")


def graph_rag(similar: DataFrame, edges: DataFrame, anchors: int = 10, hops: int = 2, least: float = 0.1, weights: tuple[float, float] = (0.6, 0.4), k: int = 10, new_nodes: int = LIMITS["new_nodes"]) -> DataFrame:
    """Retrieval from the rows most similar, expanded over edges.

    ``similar`` has ``id`` and ``score`` of every live row. Anchors are its best rows; each hop takes the weakest edge
    of the way so far as its strength and scores ``w0 * similarity + w1 * strength / (1 + hop)``. A node keeps its best
    row, and goes on from it. At most ``new_nodes`` nodes join, the best scored of a hop first. Returns ``id``,
    ``score``, ``similarity``, ``anchor_id``, ``hop_distance``, ``assoc_strength``.
    """
    ways = edges.where(F.col("strength") >= least).select(F.col("from_id").alias("id"), "to_id", F.col("strength").alias("edge"))
    # every hop reads the scores, so vectors are compared once
    similar = cut(similar.select("id", "score"))
    best = similar.orderBy(F.desc("score"), "id").limit(anchors)
    row = F.struct((weights[0] * F.col("score") + weights[1] * F.lit(1.0)).alias("score"), F.col("score").alias("similarity"), F.col("id").alias("anchor_id"), F.lit(0).alias("hop_distance"), F.lit(1.0).alias("assoc_strength"))
    known = cut(best.select("id", row.alias("r")))
    front, joined = known, 0
    own = similar.select(F.col("id").alias("to_id"), F.col("score").alias("similarity"))
    for hop in range(1, hops + 1):
        way = front.join(ways, "id").select("to_id", "r.anchor_id", F.least("r.assoc_strength", "edge").alias("strength"))
        reached = way.join(own, "to_id").select(
            F.col("to_id").alias("id"),
            F.struct((weights[0] * F.col("similarity") + weights[1] * F.col("strength") / (1 + hop)).alias("score"), "similarity", "anchor_id", F.lit(hop).alias("hop_distance"), F.col("strength").alias("assoc_strength")).alias("r"),
        )
        # of equal scores the smaller anchor
        rank = lambda r: F.struct(r["score"].alias("score"), r["assoc_strength"].alias("strength"), (-r["hop_distance"]).alias("near"))
        top = reached.groupBy("id").agg(F.max(F.struct(rank(F.col("r")).alias("rank"), F.col("r").alias("r"))).alias("b")).select("id", F.col("b.r").alias("r"))
        old = known.select("id", F.col("r").alias("before"))
        better = cut(top.join(old, "id", "left").where(F.col("before").isNull() | (F.col("r.score") > F.col("before.score"))))
        fresh = better.where(F.col("before").isNull()).orderBy(F.desc("r.score"), "id").limit(max(0, new_nodes - joined)).select("id", "r")
        fresh = cut(fresh)
        joined += fresh.count()
        front = cut(fresh.unionByName(better.where(F.col("before").isNotNull()).select("id", "r")))
        if front.isEmpty():
            break
        known = cut(known.join(front, "id", "left_anti").unionByName(front))
    return known.select("id", "r.*").orderBy(F.desc("score"), "id").limit(k)
