"""Summaries, retrieval quality and the read-only SQL surface."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def concept_summary(concepts: DataFrame, associations: DataFrame) -> DataFrame:
    """Counts of both tables, and the distinct namespaces."""
    a = concepts.agg(F.count(F.lit(1)).alias("concepts"), F.array_sort(F.collect_set("namespace")).alias("namespaces"))
    return a.withColumn("associations", associations.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()).select("concepts", "associations", "namespaces")


def benchmark_summary(benchmarks: DataFrame) -> DataFrame:
    return benchmarks.agg(F.count(F.lit(1)).alias("benchmarks"), F.coalesce(F.avg("p50_us"), F.lit(0.0)).alias("mean_p50_us"), F.array_sort(F.collect_set("suite")).alias("suites"))


def namespaces(*tables: DataFrame) -> DataFrame:
    out = tables[0].select("namespace")
    for t in tables[1:]:
        out = out.union(t.select("namespace"))
    return out.distinct().orderBy("namespace")


def _top(retrieved: Column, k: int) -> Column:
    return F.slice(retrieved, 1, k)


def hit_at(gold: Column, retrieved: Column, k: int) -> Column:
    return F.arrays_overlap(gold, _top(retrieved, k))


def recall_at(gold: Column, retrieved: Column, k: int) -> Column:
    """Share of the gold ids among the first ``k``; 0 without gold ids."""
    return F.when(F.size(gold) > 0, F.size(F.array_intersect(gold, _top(retrieved, k))) / F.size(gold)).otherwise(F.lit(0.0))


def reciprocal_rank(gold: Column, retrieved: Column) -> Column:
    """One over the place of the first gold id, 0 without one."""
    places = F.filter(F.transform(retrieved, lambda r, i: F.when(F.array_contains(gold, r), i + 1)), lambda p: p.isNotNull())
    return F.when(F.size(places) > 0, 1.0 / F.array_min(places)).otherwise(F.lit(0.0))


def ndcg_at(gold: Column, retrieved: Column, k: int) -> Column:
    """Gain over the ideal gain, discounted by the logarithm of the place."""
    gain = F.aggregate(F.transform(_top(retrieved, k), lambda r, i: F.when(F.array_contains(gold, r), 1.0 / F.log2(i + F.lit(2.0))).otherwise(F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(gold), F.lit(k)))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + F.lit(1.0)))
    return F.when(F.size(gold) > 0, gain / ideal).otherwise(F.lit(0.0))


def index_percentile(values: Column, p: float) -> Column:
    """The sorted value at the index ``floor((n - 1) p)``."""
    return F.element_at(F.array_sort(values), (F.floor((F.size(values) - 1) * F.lit(p)) + 1).cast("int"))


def quality(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means over cases that should be answered, precision and recall of abstention, and latencies.

    ``results`` has ``recall_at_5``, ``reciprocal_rank``, ``ndcg_at_10``, ``abstained``, ``should_abstain``, ``latency``.
    Percentiles come from the histogram of latencies, of which there are few different ones.
    """
    answered = ~F.col("should_abstain")
    mean = lambda c: F.coalesce(F.avg(F.when(answered, F.col(c))), F.lit(0.0)).alias(c)
    both = F.count_if(F.col("abstained") & F.col("should_abstain"))
    groups = results.groupBy(*by) if by else results
    return groups.agg(
        F.count(F.lit(1)).alias("cases"), mean("recall_at_5"), mean("reciprocal_rank"), mean("ndcg_at_10"),
        F.coalesce(both / F.nullif(F.count_if("abstained"), F.lit(0)), F.lit(0.0)).alias("abstain_precision"),
        F.coalesce(both / F.nullif(F.count_if("should_abstain"), F.lit(0)), F.lit(0.0)).alias("abstain_recall"),
        F.expr("percentile_disc(0.5) within group (order by latency)").alias("p50"),
    )


_READ = re.compile(r"\s*(select|with)\b", re.IGNORECASE)


def read_only(spark: SparkSession, sql: str) -> DataFrame:
    """One SELECT or WITH statement; anything else is refused."""
    body = sql.strip().removesuffix(";")
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", "", body, flags=re.DOTALL)
    if not _READ.match(body) or ";" in bare:
        raise ValueError("only one SELECT or WITH statement is allowed")
    return spark.sql(body)


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as a JSON object."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("row"))


def cut_cells(rows: DataFrame) -> DataFrame:
    """For tables on a screen: cells over 19 characters become 16 and three points."""
    cell = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    return rows.select(*[F.when(F.length(cell(c)) > 19, F.concat(F.substring(cell(c), 1, 16), F.lit("..."))).otherwise(cell(c)).alias(c) for c in rows.columns[:20]])
