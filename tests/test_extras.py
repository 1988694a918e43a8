import pytest

from tesserine.plans import extras, memory

from .compare import same


@pytest.mark.parametrize("name", sorted(extras.ORACLE_SQL))
def test_query(spark, sf, name):
    same(spark, sf, extras.QUERIES[name], extras.ORACLE_SQL[name])


def test_recall_of_the_batch_search(spark, sf):
    found = {(r.query_id, r.id) for r in extras.QUERIES["q22_lsh_batch"](spark, sf).collect()}
    exact = {(r.query_id, r.id) for r in memory.QUERIES["q3_probe_batch"](spark, sf).collect()}
    assert len(found & exact) / len(exact) >= 0.9


def test_whole_table_queries_keep_no_sorted_edges(spark, sf):
    """One shuffle makes both ways of a pair; no range partitioning, which would run it all twice, and no kept copy."""
    plan = extras.QUERIES["u19_clear_associations"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and plan.count("Exchange hashpartitioning") == 1 and "edges-" not in plan


def test_batch_of_buckets_shuffles_no_pairs(spark, sf, monkeypatch):
    """The same rows from one part and from many, and only the best of each part behind a bucket's queries."""
    index, rows = memory.lsh_index(spark, sf), memory.sketches(spark, sf)
    asked = rows.where("id % 20 = 0").select("id", "vector").withColumnRenamed("id", "query_id")
    made = lambda: sorted(map(tuple, memory._LSH.search_batch(index, asked, 10, flips=1).collect()))
    one = made()
    monkeypatch.setattr(memory._LSH, "BUCKET_ROWS", 100)
    assert made() == one and len(one) == 10 * asked.count()
    assert "FlatMapCoGroupsInArrow" in memory._LSH.search_batch(index, asked, 10, flips=1)._jdf.queryExecution().executedPlan().toString()
