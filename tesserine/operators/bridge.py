"""Retrieval over an ontology: labels expand a query, three scores are blended, facts are packed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.hypervector import majority
from ..sources.tables import cut
from .filters import live, searchable_text
from .fusion import normalized
from .search import probe, scored

WEIGHTS = (0.6, 0.3, 0.1)
MAX_FACTS, TOKEN_BUDGET = 20, 1000


def label_index(ontology: DataFrame) -> DataFrame:
    """``label`` in small letters and ``concept_id``."""
    return ontology.select(F.col("id").alias("concept_id"), F.explode("labels").alias("label")).select(F.lower("label").alias("label"), "concept_id").distinct()


def matched(tokens: DataFrame, index: DataFrame) -> DataFrame:
    """Ontology concepts whose label a token is (column ``token``)."""
    return tokens.select(F.lower("token").alias("label")).distinct().join(index, "label").select("concept_id").distinct()


def expanded(found: DataFrame, ontology: DataFrame, depth: int) -> DataFrame:
    """Labels of the concepts found and of those related up to ``depth`` steps away, level by level."""
    ways = ontology.select(F.col("id").alias("concept_id"), F.explode("related").alias("to"))
    seen = front = found.select("concept_id")
    for _ in range(depth):
        front = cut(front.join(ways, "concept_id").select(F.col("to").alias("concept_id")).distinct().join(seen, "concept_id", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.join(ontology.select(F.col("id").alias("concept_id"), F.explode("labels").alias("label")), "concept_id").select("label").distinct()


def with_label(ontology: DataFrame, new: DataFrame) -> DataFrame:
    return ontology.join(new.select("id"), "id", "left_anti").unionByName(new)


def without(ontology: DataFrame, ids: list[str]) -> DataFrame:
    return ontology.where(~F.col("id").isin(ids)) if ids else ontology


def final_score(deterministic: Column, concept: Column, semantic: Column, weights: tuple[float, float, float] = WEIGHTS) -> Column:
    return weights[0] * deterministic + weights[1] * concept + weights[2] * semantic


def merged(primary: DataFrame, widened: DataFrame, k: int, reranker: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Hits of both lists (``id``, ``score``) with their parts, evidence and final score.

    The primary scores are normalised. A reranker may set ``semantic`` before the blend.
    """
    a = normalized(primary.select("id", "score")).select("id", F.col("score").alias("deterministic"))
    b = widened.select("id", F.col("score").alias("concept"))
    both = a.join(b, "id", "full_outer")
    evidence = F.array_compact(F.array(F.when(F.col("deterministic").isNotNull(), F.lit("deterministic")), F.when(F.col("concept").isNotNull(), F.lit("concept"))))
    both = both.withColumn("evidence", evidence).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("deterministic", "concept")}).withColumn("semantic", F.lit(0.0))
    if reranker:
        both = reranker(both)
    return both.withColumn("final_score", final_score(F.col("deterministic"), F.col("concept"), F.col("semantic"))).orderBy(F.desc("final_score"), "id").limit(k)


def query(concepts: DataFrame, ontology: DataFrame, text: str, k: int, now: int, depth: int = 2, code_aware: bool = False, reranker: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Retrieval by a text, widened over an ontology: ``id``, its three scores, ``evidence`` and ``final_score``.

    The best ``k`` live rows are the deterministic part. Labels of ontology concepts that the text names, and of those
    related to them, count where a live row has that id; the first ``k`` by name are bundled, and the bundle scores the
    deterministic rows and the labels' rows. Both parts are normalised. Without matching labels the first part is all.
    """
    live_rows = concepts.where(live(now))
    vector = [int(w) for w in tx.encode_text(text, code_aware=code_aware).view("int64")]
    primary = cut(probe(live_rows, vector, k).select("id", "score"))
    tokens = ontology.sparkSession.createDataFrame([(t,) for t in sorted(set(tx._tokens(text, code_aware, True)))], "token string")
    labels = expanded(matched(tokens, label_index(ontology)), ontology, depth)
    named = cut(live_rows.join(labels.select(F.col("label").alias("id")), "id", "left_semi").select("id").orderBy("id").limit(k))
    ids = [r.id for r in named.toLocalIterator()]
    widened = primary.limit(0)
    if ids:
        bundle = [int(w) for w in majority(tx.encode_text(i, code_aware=code_aware) for i in ids).view("int64")]
        some = live_rows.join(primary.select("id").unionByName(named).distinct(), "id", "left_semi")
        widened = normalized(scored(some, bundle).select("id", "score"))
    return merged(primary, widened, k, reranker)


def best_final(hits: DataFrame) -> float:
    """The best final score, 0 without hits."""
    return hits.agg(F.coalesce(F.max("final_score"), F.lit(0.0)).alias("best")).first().best


def facts(concepts: DataFrame) -> DataFrame:
    """``id`` and ``text`` of the rows that have a text."""
    return concepts.select("id", searchable_text(F.col("metadata")).alias("text")).where("text is not null")


def packet(hits: DataFrame, facts: DataFrame, budget: int = TOKEN_BUDGET, most: int = MAX_FACTS) -> DataFrame:
    """Facts of the best hits within a token budget: ``facts``, ``tokens``, ``confidence`` (mean of the top scores).

    ``hits`` has at most a top-k of rows. The text is the fact's or the id; a text repeated counts once, at its best
    hit; at most ``most`` are looked at; a fact over what is left of the budget is skipped and later ones may fit.
    """
    told = hits.join(facts.select("id", F.col("text").alias("fact")), "id", "left").withColumn("fact", F.coalesce("fact", "id"))
    again = Window.partitionBy("fact").orderBy(F.desc("final_score"), "id")
    once = told.withColumn("_r", F.row_number().over(again)).where("_r = 1").orderBy(F.desc("final_score"), "id").limit(most)
    once = once.withColumn("cost", tx.estimated_tokens(F.col("fact")).cast("int"))
    listed = once.agg(F.array_sort(F.collect_list(F.struct((-F.col("final_score")).alias("o"), "id", "fact", "cost"))).alias("all"))
    start = F.struct(F.lit(0).alias("tokens"), F.array().cast("array<string>").alias("facts"))
    step = lambda s, x: F.when(s["tokens"] + x["cost"] <= budget, F.struct((s["tokens"] + x["cost"]).alias("tokens"), F.concat(s["facts"], F.array(x["fact"])).alias("facts"))).otherwise(s)
    made = listed.select(F.aggregate("all", start, step).alias("p"), F.when(F.size("all") > 0, -F.aggregate("all", F.lit(0.0), lambda s, x: s + x["o"]) / F.size("all")).otherwise(F.lit(0.0)).alias("confidence"))
    return made.select("p.facts", F.col("p.tokens").alias("tokens"), "confidence")
