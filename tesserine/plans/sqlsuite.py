"""Relational queries over the star schema, in SQL that both Spark and DuckDB read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.analytics import read_only

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Name to SQL.
SUITE = {
    "l1_filter_project": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000",
    "l1_pricing_summary": """
        SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
               round(avg(l_discount), 6) AS avg_disc, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "l1_inner_join": """
        SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "l1_star_join": """
        SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey = s_nationkey GROUP BY r_name, n_name""",
    "l1_left_join": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "l1_right_join": "SELECT p_partkey, count(l_orderkey) AS n FROM lineitem RIGHT JOIN part ON l_partkey = p_partkey AND l_quantity > 45 GROUP BY p_partkey",
    "l1_full_join": """
        SELECT coalesce(c.k, s.k) AS nationkey, c.n AS customers, s.n AS suppliers
        FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1) c
        FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON c.k = s.k""",
    "l1_semi_join": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "l1_anti_join": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "l1_theta_join": """
        SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""",
    "l1_range_join": """
        WITH band AS (SELECT p_partkey, p_size, p_retailprice AS lo, p_retailprice + 5 AS hi FROM part WHERE p_size = 10)
        SELECT b.p_partkey, count(*) AS n FROM band b JOIN part p ON p.p_size = b.p_size AND p.p_retailprice >= b.lo AND p.p_retailprice < b.hi GROUP BY b.p_partkey""",
    "l1_interval_join": """
        SELECT a.event_id, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '1' HOUR GROUP BY a.event_id""",
    "l1_grouping_sets": """
        SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) AS g FROM lineitem
        GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""",
    "l1_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "l1_cube": "SELECT p_brand, p_size, count(*) AS n FROM part WHERE p_size < 6 GROUP BY CUBE (p_brand, p_size)",
    "l1_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15",
    "l1_distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "l1_count_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag",
    "l1_filtered_aggregates": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(sum(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END), 0) AS big FROM orders GROUP BY o_orderpriority",
    "l1_statistics": "SELECT p_brand, round(stddev_samp(p_retailprice), 6) AS sd, round(var_pop(p_retailprice), 4) AS vp, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY p_brand",
    "l1_correlation": "SELECT event_type, round(corr(value, user_id), 6) AS r, round(covar_samp(value, user_id), 4) AS cv FROM events GROUP BY event_type",
    "l1_percentile": """
        SELECT event_type, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY value), 6) AS p90 FROM events GROUP BY event_type""",
    "l1_row_number": "SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) x WHERE rn <= 3",
    "l1_rank": "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS d FROM part",
    "l1_ntile": "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS q FROM customer",
    "l1_percent_rank": "SELECT s_suppkey, round(percent_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey), 6) AS pr, round(cume_dist() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey), 6) AS cd FROM supplier",
    "l1_lag_lead": """
        SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_type, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS later FROM events""",
    "l1_first_last": """
        SELECT event_id, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f,
               last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM events""",
    "l1_running_sum": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS s FROM events",
    "l1_moving_average": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS m FROM events",
    "l1_range_frame": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM part",
    "l1_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "l1_union_all": "SELECT 'c' AS t, count(*) AS n FROM customer UNION ALL SELECT 's' AS t, count(*) AS n FROM supplier",
    "l1_intersect": "SELECT l_partkey FROM lineitem WHERE l_quantity > 48 INTERSECT SELECT p_partkey FROM part WHERE p_size > 25",
    "l1_except": "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders",
    "l1_scalar_subquery": "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) * 1.5 FROM customer)",
    "l1_correlated_subquery": "SELECT l_orderkey, l_linenumber FROM lineitem a WHERE l_quantity < (SELECT 0.3 * avg(l_quantity) FROM lineitem b WHERE b.l_partkey = a.l_partkey)",
    "l1_in_subquery": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
    "l1_not_in_subquery": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 2)",
    "l1_cte": """
        WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), top AS (SELECT max(t) AS m FROM spend)
        SELECT o_custkey, round(t / m, 6) AS share FROM spend, top WHERE t > 0.8 * m""",
    "l1_recursive_cte": "WITH RECURSIVE n(i, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT i + 1, f * (i + 1) FROM n WHERE i < 12) SELECT i, f FROM n",
    "l1_sort_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "l1_offset": "SELECT p_partkey FROM part ORDER BY p_retailprice, p_partkey LIMIT 10 OFFSET 20",
    "l1_case": "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 200000 THEN 'mid' ELSE 'high' END AS band, nullif(o_orderstatus, 'O') AS s FROM orders",
    "l1_strings": "SELECT p_partkey, upper(p_name) AS u, length(p_name) AS n, substring(p_brand, 1, 5) AS b, replace(p_type, ' ', '_') AS t, concat(p_brand, '-', p_type) AS c, trim(p_name) AS tr FROM part",
    "l1_dates": "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, date_trunc('month', o_orderdate) AS t, datediff('day', TIMESTAMP '1992-01-01 00:00:00', o_orderdate) AS d FROM orders",
    "l1_math": "SELECT p_partkey, abs(p_size - 25) AS a, round(sqrt(p_retailprice), 6) AS q, CAST(floor(p_retailprice / 7) AS BIGINT) AS f, p_size % 7 AS r, round(ln(p_retailprice), 6) AS l FROM part",
    "l1_pivot": "SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS o FROM orders GROUP BY o_orderpriority",
    "l1_conditional_join": "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN part ON l_partkey = p_partkey WHERE (p_size < 10 AND l_quantity BETWEEN 1 AND 11) OR (p_size > 40 AND l_quantity BETWEEN 20 AND 30)",
    "l1_max_by": "SELECT user_id, max_by(event_type, event_id) AS last_type, min_by(event_type, event_id) AS first_type FROM events GROUP BY user_id",
    "l1_sessions": """
        WITH gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS new FROM events),
        numbered AS (SELECT user_id, event_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM gaps)
        SELECT user_id, session, count(*) AS n, min(event_id) AS lo FROM numbered GROUP BY user_id, session""",
    "l1_arrays": "SELECT vec_id, list_sum(embedding[1:3]) AS head, len(embedding) AS n, list_contains(embedding, embedding[1]) AS has FROM embeddings",
    "l1_json": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL",
    "l1_maps": "SELECT o_custkey, map_extract_value(map_from_entries(list((o_orderkey, o_orderstatus) ORDER BY o_orderkey)), min(o_orderkey)) AS first FROM orders GROUP BY o_custkey",
    "l1_percentiles": "SELECT l_returnflag, percentile_disc(0.5) WITHIN GROUP (ORDER BY l_quantity) AS mid, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY l_returnflag",
    "l1_correlated": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > (SELECT avg(o_totalprice) FROM orders))",
    "l1_values_lateral": "SELECT n_nationkey, v FROM nation, LATERAL (SELECT n_nationkey * 2 AS v) t",
}
#: Where the engines spell one function differently: DuckDB's form.
OTHER = {
    "l1_dates": SUITE["l1_dates"].replace("date_trunc('month', o_orderdate)", "CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)"),
}
SPARK_FORM = {
    "l1_arrays": "SELECT vec_id, aggregate(slice(embedding, 1, 3), 0D, (s, x) -> s + x) AS head, size(embedding) AS n, array_contains(embedding, embedding[0]) AS has FROM embeddings",
    "l1_json": "SELECT event_id, get_json_object(props, '$.k') AS k FROM events WHERE get_json_object(props, '$.k') IS NOT NULL",
    "l1_maps": "SELECT o_custkey, map_from_entries(array_sort(collect_list(struct(o_orderkey, o_orderstatus))))[min(o_orderkey)] AS first FROM orders GROUP BY o_custkey",
    # Spark answers NOT IN by sending all keys to every executor; nulls are asked for apart, so that a plain anti join is left
    "l1_not_in_subquery": """
        WITH k AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity >= 2), s AS (SELECT count(*) AS n, count(l_partkey) AS m FROM lineitem WHERE l_quantity >= 2)
        SELECT p_partkey FROM part LEFT ANTI JOIN k ON p_partkey = l_partkey CROSS JOIN s WHERE n = m AND (n = 0 OR p_partkey IS NOT NULL)""",
    "l1_dates": SUITE["l1_dates"].replace("datediff('day', TIMESTAMP '1992-01-01 00:00:00', o_orderdate)", "datediff(o_orderdate, DATE '1992-01-01')"),
}


def views(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    for t in names:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql = SPARK_FORM.get(name, SUITE[name])
        views(spark, sf_dir, tuple(t for t in TABLES if t in sql))
        return read_only(spark, sql)

    return run


QUERIES = {name: _query(name) for name in SUITE}
ORACLE_SQL = {name: OTHER.get(name, sql) for name, sql in SUITE.items()}
