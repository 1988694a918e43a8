import pytest

from tesserine.plans import memory, sqlsuite

from .compare import same

SLOW = {"g2_shortest_path", "g3_shortest_path_hops"}
CHECKED = [n for n in memory.ORACLE_SQL if n not in SLOW]


@pytest.mark.parametrize("name", sorted(sqlsuite.SUITE))
def test_sql_suite(spark, sf, name):
    same(spark, sf, sqlsuite.QUERIES[name], sqlsuite.ORACLE_SQL[name])


@pytest.mark.parametrize(("keys", "kept"), [([1, 2], [3]), ([1, None], []), ([], [None, 1, 2, 3])])
def test_not_in_with_nulls_and_without_a_broadcast(spark, tmp_path, keys, kept):
    spark.createDataFrame([(1,), (2,), (3,), (None,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k, 5.0) for k in keys] + [(3, 1.0)], "l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = sqlsuite.QUERIES["l1_not_in_subquery"](spark, str(tmp_path))
    assert sorted((r[0] for r in df.collect()), key=lambda k: k or 0) == kept
    # no join that sends every key to the driver and to all executors because of nulls
    assert "isNullAwareAntiJoin=true" not in df._jdf.queryExecution().optimizedPlan().toString() and "IS NULL" not in _joins(df).upper().replace("ISNULL", "IS NULL")


def _joins(df):
    return "\n".join(line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftAnti" in line)


@pytest.mark.parametrize("name", CHECKED)
def test_memory_query(spark, sf, name):
    same(spark, sf, memory.QUERIES[name], memory.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["id", "distance", "score"]
    assert df.count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
