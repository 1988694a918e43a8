"""Promoted metadata keys: the same rows as over the JSON text, and predicates that reach the scan."""

import json
import random

from pyspark.sql import functions as F

from tesserine.operators import filters, search

VALUES = [1, "1", 1.5, True, "true", None, "null", [1, 2], {"b": 1, "a": [None]}, "", "é", 'q"q']


def table(spark, folder, n=400):
    rng, rows = random.Random(3), []
    for i in range(n):
        own = {key: rng.choice(VALUES) for key in ("k", "a.b", "o`d") if rng.random() < 0.7}
        rows.append((i, None if i % 50 == 7 else "{broken" if i % 50 == 8 else json.dumps(own), [rng.getrandbits(62)]))
    filters.promote(spark.createDataFrame(rows, "id long, metadata string, vector array<long>"), "k", "a.b", "o`d").repartitionByRange(8, "metadata$k", "id").write.parquet(folder)
    return spark.read.parquet(folder)


def tree(rng, depth):
    kind = rng.choice(["eq", "in", "exists"] if depth == 0 else ["and", "or", "not"])
    key = rng.choice(["k", "a.b", "o`d", "none"])
    match kind:
        case "eq":
            return filters.eq(key, rng.choice(VALUES))
        case "in":
            return filters.in_(key, rng.sample(VALUES, rng.randint(0, 3)))
        case "exists":
            return filters.exists(key)
        case "not":
            return filters.not_(tree(rng, depth - 1))
    return filters.Filter(kind, below=tuple(tree(rng, depth - 1) for _ in range(rng.randint(0, 3))))


def test_same_rows_as_over_the_text(spark, tmp_path):
    rows, rng = table(spark, str(tmp_path / "t")), random.Random(4)
    trees = [tree(rng, depth) for depth in (0, 0, 0, 0, 1, 1, 1, 2, 2, 3, 3) for _ in range(2)]
    both = rows.select("id", *[F.struct(t.on(rows).alias("a"), t.column(F.col("metadata")).alias("b")).alias(f"t{i}") for i, t in enumerate(trees)])
    for r in both.collect():
        for i, t in enumerate(trees):
            assert r[f"t{i}"].a is not None and r[f"t{i}"].a == r[f"t{i}"].b, (r.id, t)


def test_the_scan_gets_the_predicate(spark, tmp_path):
    rows = table(spark, str(tmp_path / "t"))
    for keep in (filters.eq("k", 1), filters.in_("k", ["1", None]), filters.and_(filters.exists("k"), filters.not_(filters.eq("a.b", 1.5)))):
        plan = rows.where(keep.on(rows)).select("id")._jdf.queryExecution().executedPlan().toString()
        pushed = plan.split("PushedFilters: [")[1].split("]")[0]
        assert "metadata$k" in pushed and "parse_json" not in plan and "metadata#" not in plan, plan
    hits = search.probe(rows, [5], 9, filter_=filters.eq("k", 1))
    assert "metadata$k" in hits._jdf.queryExecution().executedPlan().toString().split("PushedFilters: [")[1].split("]")[0]
    assert hits.collect() == search.probe(rows.drop("metadata$k"), [5], 9, filter_=filters.eq("k", 1)).collect()
