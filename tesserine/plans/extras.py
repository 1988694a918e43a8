"""More named queries over the test tables with the SQL that checks them: texts, stores, exports, indices, paths."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hypervector as hv
from ..functions import text as tx
from ..memory import Memory
from ..operators import filters, graph, hnsw, lifecycle, multi_index, retrieval, search
from ..sources import readers, schemas, sink, tables, writers
from ..streaming import timers
from .memory import _BITDIST, _E, _KW, _LOW, _LSH, _SAME, _SK, NOW, Query, _bm25, _dated, _edges, _fnv, _kept, _latest, _linked, _r, _t, _versions, _word, lsh_index, sketches


QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{tables.checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- vectors -------------------------------------------------------------------


@query("h6_bundle_wide", """WITH h AS (SELECT lang, list_transform(range(0, 80), lambda i: md5('hv:' || doc_id || ':' || i)) AS m FROM documents),
b AS (SELECT lang, i, count(*) AS n, count(*) FILTER (get_bit(('0x' || substr(m[i // 2 + 1], CAST(1 + 16 * (i % 2) AS INT), 16))::UBIGINT::BIT, 0) = 1) AS top,
  count(*) FILTER (('0x' || substr(m[i // 2 + 1], CAST(1 + 16 * (i % 2) AS INT), 16))::UBIGINT % 2 = 1) AS low FROM (SELECT lang, m, unnest(range(0, 160)) AS i FROM h) GROUP BY lang, i)
SELECT lang, CAST(i AS INT) AS word, top > n // 2 AS top_bit, low > n // 2 AS low_bit FROM b""")
def h6_wide(spark, sf_dir):
    v = _t(spark, sf_dir, "documents").select("lang", hv.seeded(F.col("doc_id")).alias("vector"))
    made = hv.bundle(v, ["lang"], "vector").select("lang", F.posexplode("vector").alias("word", "w"))
    return made.select("lang", "word", (F.col("w") < 0).alias("top_bit"), (F.col("w").bitwiseAND(F.lit(1)) == 1).alias("low_bit"))


@query("h21_add_and_retract", """WITH b AS (SELECT label, unnest(range(64)) AS i, unnest(embedding) >= 0 AS s, CASE WHEN vec_id % 3 = 0 THEN -1 ELSE 1 END AS g FROM embeddings),
c AS (SELECT label, i, sum(g) FILTER (s) AS c, sum(g) AS n FROM b GROUP BY label, i) SELECT label, CAST(max(n) AS BIGINT) AS n, list(CAST(coalesce(c, 0) AS BIGINT) ORDER BY i)::VARCHAR AS counts FROM c GROUP BY label""")
def h21(spark, sf_dir):
    rows = sketches(spark, sf_dir).withColumn("sign", F.when(F.col("id") % 3 == 0, -1).otherwise(1))
    made = hv.retracted(hv.bit_counts(rows, ["label"], "vector", 1, "sign"))
    return made.select("label", "n", F.concat(F.lit("["), F.array_join("counts", ", "), F.lit("]")).alias("counts"))


@query("h5_set_bit", "SELECT doc_id, 3 AS weight, true AS low FROM documents")
def h5(spark, sf_dir):
    v = hv.set_bit(hv.set_bit(hv.set_bit(hv.zero(), 0), 10_239), 63)
    return _t(spark, sf_dir, "documents").select("doc_id", hv.weight(v).cast("int").alias("weight"), (v[0] == F.lit(-(1 << 63) + 1)).alias("low"))


@query("f16_probe_by_row", f"{_SK} SELECT vec_id AS id, d AS distance, round(1 - d / 32.0, 6) AS score FROM s WHERE label <> 3 ORDER BY d, vec_id LIMIT 15")
def f16(spark, sf_dir):
    rows = sketches(spark, sf_dir).withColumn("expires_at", F.when(F.col("label") == 3, 5).cast("long"))
    return search.probe(rows, _word(rows, 0), 15, now=5).withColumn("score", _r("score"))


# queries are the rows whose id is divisible by 20, against all rows
_NEAR = " OR ".join("(" + " + ".join(f"((e.embedding[{p + 1}] >= 0) <> (q.embedding[{p + 1}] >= 0))::INT" for p in places) + ") <= 1" for places in _LSH.places)


@query("q22_lsh_batch", f"""SELECT query_id, id, distance, CAST(rank AS INT) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, CAST({_BITDIST.format(a='e.embedding', b='q.embedding')} AS INT) AS distance,
row_number() OVER (PARTITION BY q.vec_id ORDER BY {_BITDIST.format(a='e.embedding', b='q.embedding')}, e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON {_NEAR} WHERE q.vec_id % 20 = 0) WHERE rank <= 10""")
def q22(spark, sf_dir):
    asked = sketches(spark, sf_dir).where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    return _LSH.search_batch(lsh_index(spark, sf_dir), asked, 10, flips=1).select("query_id", "id", "distance", "rank")


@query("q24_lsh_filtered_near", f"""{_SK}, q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), n AS (SELECT s.* FROM s, q WHERE label = 3 AND ({_SAME})),
f AS (SELECT count(*) >= 3 AS enough FROM n) SELECT vec_id AS id, d AS distance, round(1 - d / 32.0, 6) AS score FROM (SELECT * FROM n WHERE (SELECT enough FROM f) UNION ALL SELECT * FROM s WHERE label = 3 AND NOT (SELECT enough FROM f)) ORDER BY d, vec_id LIMIT 3""".replace(", q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), n", ", n"))
def q24(spark, sf_dir):
    rows = sketches(spark, sf_dir)
    return _LSH.search_filtered(rows, _LSH.keys(rows), _word(rows, 0), 3, filters.eq("label", 3)).withColumn("score", _r("score"))


@query("f1_promoted_filter", """SELECT doc_id, source, lang FROM documents WHERE source IN (SELECT min(source) FROM documents UNION ALL SELECT max(source) FROM documents)
AND NOT coalesce(lang = 'de', false) AND NOT coalesce(n_chars = 100, false) AND source IS NOT NULL""")
def f1_promoted(spark, sf_dir):
    """A filter tree whose keys are columns: the scan gets it, and the JSON is parsed for the one key that isn't."""
    docs = _t(spark, sf_dir, "documents")
    made = lambda: filters.promote(docs.select("doc_id", "source", "lang", F.to_json(F.struct("source", "lang", "n_chars")).alias("metadata")), "source", "lang")  # noqa: E731
    rows = _kept(spark, sf_dir, "promoted", "documents", made, ["metadata$source", "doc_id"])
    ends = docs.agg(F.min("source"), F.max("source")).first()
    keep = filters.and_(filters.in_("source", list(ends)), filters.not_(filters.eq("lang", "de")), filters.not_(filters.eq("n_chars", 100)), filters.not_(filters.eq("n_chars", "100")), filters.exists("source"))
    return rows.where(keep.on(rows)).select("doc_id", "source", "lang")


@query("q2_promoted_probe", f"{_SK} SELECT vec_id AS id, d AS distance, round(1 - d / 32.0, 6) AS score FROM s WHERE label IN (1, 2) OR label = 5 ORDER BY d, vec_id LIMIT 10")
def q2_promoted(spark, sf_dir):
    made = lambda: filters.promote(sketches(spark, sf_dir), "label")  # noqa: E731
    rows = _kept(spark, sf_dir, "labelled", "embeddings", made, ["metadata$label", "id"])
    keep = filters.or_(filters.in_("label", [1, 2]), filters.eq("label", 5))
    return search.probe(rows, _word(rows, 0), 10, filter_=keep).withColumn("score", _r("score"))


# Queries with noise: each 20th row's sketch with nine of its bits turned.
_NOISY = """WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x >= 0) AS v FROM embeddings),
a AS (SELECT vec_id AS query_id, list_transform(range(64), lambda i: v[i + 1] <> list_contains(list_transform(range(9), lambda j: (vec_id + 7 * j) % 64), i)) AS v FROM s WHERE vec_id % 20 = 0)"""
_APART = "CAST(list_sum(list_transform(list_zip(a.v, s.v), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS INT)"
_MULTI = multi_index.MultiIndex(parts=4, most=10)


def _noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = [F.expr(f"shiftleft(1L, cast(pmod(id + {7 * j}, 64) as int))") for j in range(9)]
    mask = reduce(lambda a, b: a.bitwiseOR(b), turned)
    rows = sketches(spark, sf_dir).where("id % 20 = 0")
    return rows.select(F.col("id").alias("query_id"), F.array(F.col("vector")[0].bitwiseXOR(mask)).alias("vector"))


def _multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir, "parts", "embeddings", lambda: _MULTI.build(sketches(spark, sf_dir)), ["part", "key"])


@query("q11_within_radius", f"""{_NOISY}, c AS (SELECT v, min(vec_id) AS id FROM s GROUP BY v) SELECT * FROM (SELECT a.query_id, s.id, {_APART} AS distance FROM a, c AS s) WHERE distance <= 11""")
def q11_radius(spark, sf_dir):
    """Different vectors at most 11 bits from each query, by their smallest id, from the index alone."""
    asked = _noisy(spark, sf_dir)
    near = _MULTI.classes(_multi(spark, sf_dir), asked, 11).select(F.col("asked").alias("vector"), F.col("ids")[0].alias("id"), "distance")
    return asked.join(near, "vector").select("query_id", "id", "distance")


@query("q13_nearest_exact", f"""{_NOISY} SELECT query_id, id, distance, round(1 - distance / 32.0, 6) AS score, CAST(rank AS INT) AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (SELECT a.query_id, s.vec_id AS id, {_APART} AS distance FROM a, s)) WHERE rank <= 1""")
def q13_nearest(spark, sf_dir):
    return _MULTI.nearest(_multi(spark, sf_dir), _noisy(spark, sf_dir), 1).withColumn("score", _r("score"))


@query("q14_rows_read", f"""{_NOISY}, c AS (SELECT DISTINCT v FROM s), d AS (SELECT a.query_id, list_sum(list_transform(range(4), lambda p:
CASE WHEN list_sum(list_transform(range(16 * p, 16 * p + 16), lambda i: CASE WHEN a.v[i + 1] <> c.v[i + 1] THEN 1 ELSE 0 END)) <= 2 THEN 1 ELSE 0 END)) AS n FROM a, c)
SELECT query_id, CAST(sum(n) AS BIGINT) AS opened FROM d GROUP BY query_id""")
def q14_read(spark, sf_dir):
    """Rows of the index that the lookups of a search within 11 bits read."""
    return _MULTI.opened(_multi(spark, sf_dir), _noisy(spark, sf_dir), _MULTI.steps(11))


@query("q25_hnsw_recall", "SELECT true AS enough")
def q25(spark, sf_dir):
    """Recall of the walks against the exact scan over the queries whose id is divisible by 20: at least 0.9."""
    rows, built = sketches(spark, sf_dir), hnsw.HnswIndex(m=16, ef_build=96, ef=96)
    index = _kept(spark, sf_dir, "graphs", "embeddings", lambda: built.build(rows))
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    exact = search.probe_batch(rows, asked, 10).groupBy("query_id").agg(F.max("distance").alias("edge"))
    found = built.search_batch(index, asked, 10).join(exact, "query_id")
    return found.agg((F.count_if(F.col("distance") <= F.col("edge")) >= 0.9 * 10 * F.count_distinct("query_id")).alias("enough"))


@query("q16_candidate_positions", f"{_SK} SELECT vec_id AS id, d AS distance, round(1 - d / 32.0, 6) AS score FROM s WHERE vec_id % 7 = 1 ORDER BY d, vec_id LIMIT 8")
def q16(spark, sf_dir):
    rows = sketches(spark, sf_dir)
    return retrieval.score_positions(rows, _word(rows, 0), rows.where("id % 7 = 1").select("id"), 8).withColumn("score", _r("score"))


_BUCKETED = " + ".join(f"((embedding[{i + 1}] >= 0) <> (q[{i + 1}] >= 0))::INT" for i in range(_LOW))


@query("q8_cascade", f"{_SK}, b AS (SELECT s.* FROM s, q WHERE {_BUCKETED} <= 1), c AS (SELECT count(*) BETWEEN 5 AND 1000 AS ok FROM b) SELECT vec_id AS id, d AS distance, round(1 - d / 32.0, 6) AS score FROM (SELECT * FROM b WHERE (SELECT ok FROM c) UNION ALL SELECT * FROM s WHERE NOT (SELECT ok FROM c)) ORDER BY d, vec_id LIMIT 5")
def q8(spark, sf_dir):
    rows = sketches(spark, sf_dir)
    return retrieval.find_similar(rows, _word(rows, 0), 5, retrieval.Config(buckets=True, bucket_width=_LOW))[0].withColumn("score", _r("score"))


@query("q17_filtered_with_stats", "SELECT round(avg((label = 1)::INT), 6) AS selectivity, count(*) FILTER (label = 1) AS candidates, CASE WHEN count(*) < 20 OR avg((label = 1)::INT) < 0.3 THEN 'Pre' WHEN avg((label = 1)::INT) <= 0.8 THEN 'BucketPost' ELSE 'ScanPost' END AS strategy FROM embeddings")
def q17(spark, sf_dir):
    rows = sketches(spark, sf_dir)
    stats = retrieval.with_stats(rows, _word(rows, 0), 5, filters.eq("label", 1))[1]
    return spark.createDataFrame([(round(stats.selectivity, 6), stats.candidates, stats.strategy)], "selectivity double, candidates long, strategy string")


# ---- texts ---------------------------------------------------------------------

_WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"


@query("t8_normalize", f"SELECT doc_id, lower(trim(text, {_WS})) AS normal FROM documents")
def t8(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", tx.normalize(F.col("text")).alias("normal"))


@query("t5_tokenize", r"SELECT page_id, array_to_string(list_filter(regexp_split_to_array(url, '[ \t\n\r\x0B\f]+'), lambda t: t <> ''), '|') AS tokens FROM pages")
def t5(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.array_join(tx.tokenize(F.col("url"), lowercase=False), "|").alias("tokens"))


@query("t9_absence_id", f"SELECT user_id, 'absence:' || {_fnv('t')} AS id FROM (SELECT DISTINCT user_id, 'q ' || user_id AS t FROM events)")
def t9(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("user_id").distinct().select("user_id", tx.absence_id(F.concat(F.lit("  Q "), "user_id", F.lit("\n"))).alias("id"))


@query("t10_scoped_absence_id", f"SELECT conv_id, 'absence:' || {_fnv('t')} AS id FROM (SELECT DISTINCT conv_id, chr(1) || repeat(chr(0), 7) || 's' || 'q' || conv_id AS t FROM conversations)")
def t10(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", tx.scoped_absence_id(F.lit("s"), F.concat(F.lit("q"), "conv_id")).alias("id"))


@query("t11_sentences", "SELECT n_nationkey, n_name || ' lies in ' || r_name AS sentence, 'Summary: ' || n_name || chr(10) || 'Facts:' || chr(10) || '- ' || r_name || chr(10) || '- key ' || n_nationkey AS context FROM nation JOIN region ON r_regionkey = n_regionkey")
def t11(spark, sf_dir):
    both = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    facts = F.array(F.col("r_name"), F.concat(F.lit("key "), "n_nationkey"))
    return both.select("n_nationkey", tx.to_sentence(F.col("n_name"), F.lit("lies in"), F.col("r_name")).alias("sentence"), tx.to_context(F.col("n_name"), facts).alias("context"))


@query("b2_remove_documents", f"WITH k AS (SELECT doc_id AS id, {_KW.format('text')} AS k FROM documents WHERE doc_id % 3 > 0), p AS (SELECT DISTINCT id, unnest(k) AS t FROM k) SELECT t AS term, count(*) AS df FROM p GROUP BY t")
def b2(spark, sf_dir):
    gone = _t(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"))
    return _bm25(spark, sf_dir).remove(gone).postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query("b5_token_overlap", f"WITH k AS (SELECT unnest({_KW.format('text')}) AS t FROM documents) SELECT count(*) FILTER (t = 'the') > 0 AS common, count(*) FILTER (t = 'zyzzyva') > 0 AS rare, 0 AS left_after_clear FROM k")
def b5(spark, sf_dir):
    index = _bm25(spark, sf_dir)
    return spark.createDataFrame([(index.overlaps(["zyzzyva", "the"]), index.overlaps(["zyzzyva"]), index.clear().postings.count())], "common boolean, rare boolean, left_after_clear int")


# ---- filters and checks --------------------------------------------------------


@query("f5_expired", "WITH n AS (SELECT CAST(floor(epoch(max(ts))) AS BIGINT) AS now FROM events) SELECT CAST(event_id AS VARCHAR) AS id FROM events, n WHERE event_id % 3 = 0 AND CAST(floor(epoch(ts)) AS BIGINT) + 86400 * (user_id % 50) <= now")
def f5(spark, sf_dir):
    return _dated(spark, sf_dir).where(filters.expired(_latest(spark, sf_dir))).select("id")


@query("f7_neighbors", f"WITH {_E} SELECT to_id, strength FROM e WHERE from_id = 's2' AND strength >= 0.4")
def f7(spark, sf_dir):
    return filters.neighbors(_edges(spark, sf_dir), "s2", 0.4)


@query("f8_get_concept", "SELECT CAST(event_id AS VARCHAR) AS id, event_type FROM events WHERE event_id = 12")
def f8(spark, sf_dir):
    return filters.concept(_dated(spark, sf_dir), "12").select("id", "event_type")


@query("f10_valid_namespaces", "SELECT doc_id, text IS NOT NULL AND strlen(text) BETWEEN 1 AND 128 AND NOT regexp_matches(text, '\\p{Cc}') AS ok, coalesce(strlen(text), 0) <= 300 AS small FROM documents")
def f10(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", schemas.valid_namespace(F.col("text")).alias("ok"), F.coalesce(schemas.valid_metadata(F.col("text"), 300), F.lit(True)).alias("small"))


@query("s10_normalized_path", "SELECT page_id, replace(regexp_replace('./' || url, '^\\./', ''), chr(92), '/') AS path, left(html, 200) AS preview, sha256(html) AS fingerprint FROM pages")
def s10(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", readers.normalized_path(F.concat(F.lit("./"), "url")).alias("path"), tx.preview(F.col("html")).alias("preview"), F.sha2("html", 256).alias("fingerprint"))


@query("s6_indexed_rows", "SELECT 'jsonl:' || event_id AS id, event_type AS searchable_text, left(event_type, 200) AS text_preview FROM events WHERE event_id % 5 = 0")
def s6_rows(spark, sf_dir):
    value = F.when(F.col("event_id") % 5 == 0, F.to_json(F.struct(F.col("event_type").alias("text")))).otherwise("{not json")
    return readers.index_lines(_t(spark, sf_dir, "events").select(F.col("event_id").alias("line"), value.alias("value")))[0].select("id", "searchable_text", "text_preview")


@query("s7_sync", "SELECT 'gone' AS what, event_id AS id FROM events WHERE event_id % 10 = 3 AND user_id % 2 = 0 UNION ALL SELECT 'same', event_id FROM events WHERE event_id % 10 NOT IN (3, 4) AND user_id % 2 = 0")
def s7(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("path"), F.lit("a").alias("fingerprint"))
    staged = e.where("id % 10 <> 3 and path % 2 = 0").withColumn("fingerprint", F.when(F.col("id") % 10 == 4, "b").otherwise("a"))
    gone, same = readers.synced(e, staged)
    return gone.select(F.lit("gone").alias("what"), "id").unionByName(same.select(F.lit("same").alias("what"), "id"))


# ---- lifecycle ------------------------------------------------------------------


@query("u3_ttl", "SELECT event_id, 1000 + least(user_id * 100000000, 3153600000) AS expires_at FROM events")
def u3(spark, sf_dir):
    return lifecycle.with_ttl(_t(spark, sf_dir, "events").withColumn("s", F.col("user_id") * 100_000_000), 1000, F.col("s")).select("event_id", "expires_at")


@query("u10_update", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS metadata FROM customer WHERE c_custkey % 3 = 0")
def u10(spark, sf_dir):
    have = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("metadata"), F.lit(1).cast("long").alias("modified_at"))
    new = have.where("id % 3 = 0").select((F.col("id")).alias("id"), F.lit("new").alias("metadata")).unionByName(spark.createDataFrame([(-1, "x")], "id long, metadata string").select(F.col("id").cast(dict(have.dtypes)["id"]).alias("id"), "metadata"))
    made, unknown = lifecycle.updated(have, new, ["id"], 9)
    return made.where(F.lit(unknown.count() == 1)).where("modified_at = 9").select("id", "metadata")


@query("u12_delete_concepts", f"WITH {_E} SELECT from_id, to_id FROM e WHERE from_id NOT LIKE '%7' AND to_id NOT LIKE '%7'")
def u12(spark, sf_dir):
    e = _edges(spark, sf_dir)
    ids = e.select(F.col("from_id").alias("id")).unionByName(e.select(F.col("to_id").alias("id"))).distinct()
    return lifecycle.deleted(ids, e, ids.withColumnRenamed("id", "concept_id"), ids.where("id like '%7'"))[1].select("from_id", "to_id")


@query("u19_clear_associations", f"WITH {_E} SELECT from_id, to_id FROM e WHERE from_id <> 's1'")
def u19(spark, sf_dir):
    return lifecycle.cleared(_linked(spark, sf_dir), "s1").select("from_id", "to_id")


@query("u20_reinforce", f"WITH {_E}, t AS (SELECT min(to_id) AS t FROM e WHERE from_id = 's1') SELECT from_id, to_id, CASE WHEN from_id = 's1' AND to_id = t THEN 7 ELSE created_at END AS created_at FROM e, t")
def u20(spark, sf_dir):
    e = _edges(spark, sf_dir)
    end = e.where("from_id = 's1'").agg(F.min("to_id")).first()[0]
    return lifecycle.reinforced(e, "s1", end, 7).select("from_id", "to_id", F.col("created_at").cast("long").alias("created_at"))


@query("a8_list_versions", "SELECT CAST(user_id AS VARCHAR) AS concept_id, count(*) AS versions FROM events GROUP BY 1")
def a8(spark, sf_dir):
    return lifecycle.retained(_versions(spark, sf_dir), 10_000).groupBy("concept_id").agg(F.count(F.lit(1)).alias("versions"))


@query("e20_short_circuits", "SELECT 'q' || user_id AS id FROM events GROUP BY user_id HAVING count(*) >= 3 AND user_id % 400 BETWEEN 0 AND 299")
def e20(spark, sf_dir):
    at = F.timestamp_seconds(F.lit(NOW) - F.col("user_id") % 400)
    rows = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("attempt_count"))
    rows = rows.select(F.concat(F.lit("q"), "user_id").alias("id"), "attempt_count", F.lit("n").alias("namespace"), F.lit(4).cast("long").alias("namespace_revision"), at.alias("last_seen"))
    return lifecycle.short_circuits(rows, "n", 4, F.timestamp_seconds(F.lit(NOW))).select("id")


# ---- graph ----------------------------------------------------------------------


@query("g5_path_over_levels", """WITH RECURSIVE w AS (SELECT o_custkey AS f, o_custkey + 1 AS t, (o_custkey % 9 + 1) / 10.0 AS s FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey < 60)
UNION ALL SELECT o_custkey, o_custkey + 3, (o_custkey % 4 + 1) / 10.0 FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey < 60)),
p(id, c, d) AS (SELECT min(f), 0.0::DOUBLE, 0 FROM w UNION SELECT t, min(c - ln(s)), d + 1 FROM p JOIN w ON f = id WHERE d < 6 GROUP BY t, d)
SELECT abs(round(min(c), 6)) AS cost FROM p WHERE id = (SELECT max(id) FROM p)""")
def g5(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").where("o_custkey < 60").select("o_custkey").distinct()
    way = lambda step, of: o.select(F.col("o_custkey").cast("string").alias("from_id"), (F.col("o_custkey") + step).cast("string").alias("to_id"), ((F.col("o_custkey") % of + 1) / 10.0).alias("strength"))  # noqa: E731
    e = tables.cut(way(1, 9).unionByName(way(3, 4)))
    start = str(o.agg(F.min("o_custkey")).first()[0])
    reach = graph.bfs(e, start, graph.Traversal(6, 10_000)).agg(F.max(F.col("id").cast("long")).alias("m")).first().m
    return graph.shortest_path(e, start, str(reach), graph.Traversal(max_depth=6)).select(F.abs(_r("cost")).alias("cost"))


@query("g6_path_of_many_edges", """WITH RECURSIVE w AS (SELECT c_custkey AS f, c_custkey + k AS t, ((c_custkey * 7 + k * 5) % 9 + 1) / 10.0 AS s FROM customer, (SELECT unnest([1, 2, 3]) AS k)),
p(id, c, d) AS (SELECT min(f), 0.0::DOUBLE, 0 FROM w UNION ALL SELECT t, min(c - ln(s)), d + 1 FROM p JOIN w ON f = id WHERE d < 16 GROUP BY t, d)
SELECT round(min(c), 6) AS cost, true AS long FROM p WHERE id = (SELECT min(f) + 24 FROM w)""")
def g6(spark, sf_dir):
    """From the first customer to the one 24 numbers on, over edges of all customers."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("k"))
    e = tables.cut(c.select(F.col("c_custkey").cast("string").alias("from_id"), (F.col("c_custkey") + F.col("k")).cast("string").alias("to_id"), (((F.col("c_custkey") * 7 + F.col("k") * 5) % 9 + 1) / 10.0).alias("strength")))
    start = c.agg(F.min("c_custkey")).first()[0]
    found = graph.shortest_path(e, str(start), str(start + 24), graph.Traversal(max_depth=16))
    return found.select(_r("cost").alias("cost"), (F.size("path") > 10).alias("long"))


# ---- the store ------------------------------------------------------------------


def _stored_customers(spark: SparkSession, sf_dir: str, now: int = 100) -> Memory:
    memory = Memory(spark, _folder(spark, "store"), now=now)
    rows = _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.array(F.col("c_custkey").cast("long")).alias("vector"), F.to_json(F.struct(F.col("c_name").alias("searchable_text"))).alias("metadata"))
    memory.upsert(rows)
    return memory


def _ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    last = c.agg(F.max("c_custkey")).first()[0]
    return c.where(F.col("c_custkey") < last).select(F.col("c_custkey").cast("string").alias("from_id"), (F.col("c_custkey") + 1).cast("string").alias("to_id"), F.lit(0.5).alias("strength"))


@query("u7_upsert_and_read", "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 2 = 0 THEN 'again' ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS version FROM customer WHERE c_custkey % 5 > 0")
def u7(spark, sf_dir):
    m = _stored_customers(spark, sf_dir)
    m.upsert(m.concepts.where("cast(id as long) % 2 = 0").select("id", "vector", F.lit('{"searchable_text": "again"}').alias("metadata")))
    m.delete_rows(m.concepts.where("cast(id as long) % 5 = 0").select("id"))
    last = m.table("versions").groupBy(F.col("concept_id").alias("id")).agg(F.max("version").cast("int").alias("version"))
    return m.concepts.join(last, "id").select("id", filters.searchable_text(F.col("metadata")).alias("name"), "version")


@query("u22_delete_namespace", "SELECT 0 AS here, count(*) AS there, count(*) AS removed, 2 AS revision FROM customer")
def u22(spark, sf_dir):
    m = _stored_customers(spark, sf_dir)
    other = Memory(spark, m.store.root, "other", now=100)
    other.upsert(m.concepts.select("id", "vector", "metadata"))
    n = m.delete_namespace()
    return spark.createDataFrame([(m.concepts.count(), other.concepts.count(), n, m.namespace_revision())], "here int, there long, removed long, revision int")


@query("u24_replace_namespace", "SELECT count(*) FILTER (c_custkey % 2 = 1) AS concepts, 0 AS edges, 2 AS revision FROM customer")
def u24(spark, sf_dir):
    m = _stored_customers(spark, sf_dir)
    m.merge_namespace(m.concepts.limit(0).select("id", "vector", "metadata"), _ways(spark, sf_dir))
    revision = m.namespace_revision()
    m.replace_namespace(m.concepts.where("cast(id as long) % 2 = 1").select("id", "vector", "metadata"), _ways(spark, sf_dir).limit(0))
    return spark.createDataFrame([(m.concepts.count(), m.edges.count(), m.namespace_revision() - revision + 1)], "concepts long, edges int, revision int")


@query("s15_merge_import", "SELECT count(*) + 1 AS concepts, count(*) - 1 AS edges, 100 AS created_at FROM customer")
def s15(spark, sf_dir):
    m = _stored_customers(spark, sf_dir)
    later = Memory(spark, m.store.root, now=200)
    new = m.concepts.select("id", "vector", "metadata").unionByName(spark.createDataFrame([("new", [1], "{}")], "id string, vector array<long>, metadata string"))
    later.merge_namespace(new, _ways(spark, sf_dir))
    old = later.concepts.where("id <> 'new'").agg(F.max("created_at")).first()[0]
    return spark.createDataFrame([(later.concepts.count(), later.edges.count(), old)], "concepts long, edges long, created_at int")


_ALL = "CAST(c_custkey AS VARCHAR) AS id"


@query("u24_atomic_replace", f"""SELECT 0 AS step, {_ALL}, CAST(NULL AS VARCHAR) AS to_id FROM customer UNION ALL SELECT 1, {_ALL}, NULL FROM customer UNION ALL SELECT 2, {_ALL}, NULL FROM customer
UNION ALL SELECT 3, {_ALL}, CASE WHEN c_custkey + 2 <= (SELECT max(c_custkey) FROM customer) THEN CAST(c_custkey + 2 AS VARCHAR) END FROM customer WHERE c_custkey % 2 = 1""")
def u24_atomic(spark, sf_dir):
    """What a reader sees of a namespace and its edges while it is replaced: after each step of a writer that stops, and after the commit."""
    m = _stored_customers(spark, sf_dir)
    seen = lambda step: m.concepts.select(F.lit(step).alias("step"), "id").join(m.edges.select(F.col("from_id").alias("id"), "to_id"), "id", "left")  # noqa: E731
    new = m.concepts.where("cast(id as long) % 2 = 1").select("id", "vector", "metadata")
    c = _t(spark, sf_dir, "customer")
    last = c.agg(F.max("c_custkey")).first()[0]
    ways = c.where((F.col("c_custkey") % 2 == 1) & (F.col("c_custkey") + 2 <= last)).select(F.col("c_custkey").cast("string").alias("from_id"), (F.col("c_custkey") + 2).cast("string").alias("to_id"), F.lit(0.5).alias("strength"))
    stopped = m.store.commit()
    states = [seen(0)]
    stopped.delete("concepts", m.concepts.select("namespace", "id"))
    states.append(seen(1))
    stopped.upsert("associations", ways.select(F.lit(m.namespace).alias("namespace"), "*", F.lit(1).cast("long").alias("created_at")))
    states.append(seen(2))
    m.replace_namespace(new, ways)
    rows = seen(3)
    for s in states:
        rows = rows.unionByName(s)
    return rows.select("step", "id", "to_id")


@query("s18_reads_over_many_logs", "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 3 = 0 THEN 'changed ' || c_custkey % 6 ELSE c_name END AS name FROM customer WHERE c_custkey % 7 > 0")
def s18(spark, sf_dir):
    """A base, logs over it and tombstones, read by keys first."""
    m = _stored_customers(spark, sf_dir)
    m.store.compact("concepts", m.SCHEMAS["concepts"], m.KEYS["concepts"])
    own = m.concepts
    for k in range(6):
        text = F.to_json(F.struct(F.concat(F.lit("changed "), F.lit(k % 6).cast("string")).alias("searchable_text")))
        m._written("concepts", own.where((F.col("id").cast("long") % 6 == k) & (F.col("id").cast("long") % 3 == 0)).withColumn("metadata", text))
    m._written("concepts", own.where(F.col("id").cast("long") % 7 == 0), deleted=True)
    return m.concepts.select("id", filters.searchable_text(F.col("metadata")).alias("name"))


@query("e1_change_feed", f"""SELECT 'ConceptInjected' AS kind, {_ALL}, CAST(NULL AS VARCHAR) AS other_id, CAST(NULL AS DOUBLE) AS score, CAST(1 AS BIGINT) AS times FROM customer
UNION ALL SELECT 'ConceptUpdated', {_ALL}, NULL, NULL, 1 FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT 'Associated', {_ALL}, CAST(c_custkey + 1 AS VARCHAR), 0.5, 1 FROM customer WHERE c_custkey < (SELECT max(c_custkey) FROM customer)
UNION ALL SELECT 'Disassociated', '1', '2', NULL, 1
UNION ALL SELECT 'ConceptDeleted', {_ALL}, NULL, NULL, 1 FROM customer WHERE c_custkey % 5 = 0""")
def e1(spark, sf_dir):
    """Events of writes, updates and deletions, read by a stream that is stopped and started again in between."""
    folder = _folder(spark, "feed")
    m = _stored_customers(spark, sf_dir)

    def drain() -> None:
        q = m.changes().writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        q.start().awaitTermination()

    drain()
    m.upsert(m.concepts.where("cast(id as long) % 2 = 0").select("id", "vector", F.lit("{}").alias("metadata")))
    m._associated(_ways(spark, sf_dir).withColumn("created_at", F.lit(100).cast("long")))
    drain()
    m.disassociate("1", "2")
    m.delete_rows(m.concepts.where("cast(id as long) % 5 = 0").select("id"))
    drain()
    return spark.read.parquet(f"{folder}/out").groupBy("kind", "id", "other_id", "score").agg(F.count(F.lit(1)).alias("times"))


@query("u17_associate_batch", "SELECT count(*) - 1 AS created, 2 AS failed FROM customer")
def u17(spark, sf_dir):
    m = _stored_customers(spark, sf_dir)
    new = _ways(spark, sf_dir).unionByName(spark.createDataFrame([("nobody", "1", 0.5), ("1", "1", 2.0)], "from_id string, to_id string, strength double"))
    good, bad = lifecycle.associated(m.edges.limit(0), new, m.concepts, m.now)
    return good.agg(F.count(F.lit(1)).alias("created")).withColumn("failed", F.lit(bad.count()).cast("int"))


@query("u31_ontology", "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS label FROM nation WHERE n_nationkey <> 3")
def u31(spark, sf_dir):
    m = Memory(spark, _folder(spark, "store"), now=1)
    m.save_ontology(_t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.lit(1).alias("version"), F.array("n_name").alias("labels"), F.array().cast("array<string>").alias("related")))
    m.delete_canonical("3")
    return m.ontology.select("id", F.col("labels")[0].alias("label"))


@query("a3_storage", "SELECT count(*) AS concepts, true AS has_bytes, 'customer' AS namespace FROM customer")
def a3(spark, sf_dir):
    m = _stored_customers(spark, sf_dir)
    stats = m.storage()
    return spark.createDataFrame([(stats["concepts"], stats["bytes"] > 0, "customer")], "concepts long, has_bytes boolean, namespace string")


@query("x6_export_and_load", "SELECT 'p' || l_partkey AS src_id, 's' || l_suppkey AS dst_id, round(avg(l_discount) * 10, 4) AS strength FROM lineitem GROUP BY l_partkey, l_suppkey")
def x6(spark, sf_dir):
    folder = _folder(spark, "export")
    rows = _linked(spark, sf_dir).where("from_id like 'p%'").select(F.col("from_id").alias("src_id"), F.col("to_id").alias("dst_id"), "strength")
    told = json.loads(writers.export_all({"associations": rows}, folder))["files"]["associations"]
    back = spark.read.parquet(f"{folder}/associations.parquet")
    return back.where(F.lit(told["rows"] > 0 and len(told["sha256"]) == 64))


@query("x5_committed_export", "SELECT 'p' || l_partkey AS src_id, 's' || l_suppkey AS dst_id, round(avg(l_discount) * 10, 4) AS strength FROM lineitem GROUP BY l_partkey, l_suppkey")
def x5(spark, sf_dir):
    """Rows read by the manifest that the write's commit made; a file that is not as it says takes them all away."""
    folder = _folder(spark, "committed")
    rows = _linked(spark, sf_dir).where("from_id like 'p%'").select(F.col("from_id").alias("src_id"), F.col("to_id").alias("dst_id"), "strength")
    told = sink.export(rows, folder)
    whole = sink.damaged(spark, folder).isEmpty() and told["rows"] == sum(f["rows"] for f in told["files"])
    return sink.read(spark, folder).where(F.lit(whole))


@query("s12_json_round_trip", "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation")
def s12(spark, sf_dir):
    m = Memory(spark, _folder(spark, "store"), now=1)
    n = _t(spark, sf_dir, "nation")
    m.upsert(n.select(F.col("n_nationkey").cast("string").alias("id"), hv.seeded(F.col("n_nationkey")).alias("vector"), F.to_json(F.struct(F.col("n_name").alias("searchable_text"))).alias("metadata")))
    back = Memory(spark, _folder(spark, "store"), now=2)
    back._import_payload(json.loads(m.export()), merge=False)
    same = back.concepts.alias("b").join(m.concepts.alias("m"), (F.col("b.id") == F.col("m.id")) & (F.col("b.vector") == F.col("m.vector")))
    return same.select("b.id", filters.searchable_text(F.col("b.metadata")).alias("name"))


@query("q38_kept_text_index", r"SELECT CAST(doc_id AS VARCHAR) AS id, CAST(len(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\x0B\f]+'), lambda t: t <> '')) AS INT) AS dl FROM documents")
def q38(spark, sf_dir):
    m = Memory(spark, _folder(spark, "store"), now=1)
    d = _t(spark, sf_dir, "documents")
    m.upsert(d.select(F.col("doc_id").cast("string").alias("id"), F.array(F.col("doc_id").cast("long")).alias("vector"), F.to_json(F.struct(F.col("text").alias("searchable_text"))).alias("metadata")))
    m.text_index()  # made by the first, read by the second
    return m.text_index().lengths.select("id", "dl")


# ---- scans, functions by SQL, streams ---------------------------------------------


def _round_trip(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Orders written in a format and read back by a filter."""
    folder = _folder(spark, kind)
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus"), F.round("o_totalprice", 2).cast("double").alias("o_totalprice"))
    writer = rows.write.option("header", True) if kind == "csv" else rows.write
    writer.format(kind).save(folder)
    reader = spark.read.schema(rows.schema)
    return (reader.option("header", True) if kind == "csv" else reader).format(kind).load(folder).where("o_totalprice > 1000").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("total"))


_SCANNED = "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS total FROM orders WHERE round(o_totalprice, 2) > 1000"
query("l5_scan_csv", _SCANNED)(lambda spark, sf_dir: _round_trip(spark, sf_dir, "csv"))
query("l5_scan_json", _SCANNED)(lambda spark, sf_dir: _round_trip(spark, sf_dir, "json"))
query("l5_scan_orc", _SCANNED)(lambda spark, sf_dir: _round_trip(spark, sf_dir, "orc"))


@query("l6_table_function", "SELECT doc_id, CAST(i AS INT) AS place, w AS word FROM (SELECT doc_id, unnest(range(1, 4)) AS i, string_split(lang || ' ' || source || ' end', ' ') AS ws FROM documents), LATERAL (SELECT ws[i] AS w) WHERE w IS NOT NULL")
def l6(spark, sf_dir):
    """Words of a text by a table function of SQL."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION first_words(t STRING, n INT) RETURNS TABLE (place INT, word STRING) RETURN SELECT pos + 1, col FROM posexplode(slice(split(t, ' '), 1, n))")
    _t(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return spark.sql("SELECT doc_id, f.place, f.word FROM documents, LATERAL first_words(concat_ws(' ', lang, source, 'end'), 3) f")


@query("l7_custom_aggregate", "SELECT l_returnflag, round(exp(avg(ln(l_quantity))), 6) AS geometric_mean FROM lineitem GROUP BY l_returnflag")
def l7(spark, sf_dir):
    """An aggregate that SQL defines over built-in ones."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION geometric(mean_of_logs DOUBLE) RETURNS DOUBLE RETURN exp(mean_of_logs)")
    _t(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql("SELECT l_returnflag, geometric(m) AS geometric_mean FROM (SELECT l_returnflag, avg(ln(l_quantity)) AS m FROM lineitem GROUP BY l_returnflag)").withColumn("geometric_mean", _r("geometric_mean"))


@query("l8_similarity_join", f"SELECT q.vec_id AS a, e.vec_id AS b, CAST({_BITDIST.format(a='e.embedding', b='q.embedding')} AS INT) AS distance FROM embeddings q JOIN embeddings e ON q.vec_id < e.vec_id AND ({_NEAR.replace(') <= 1', ') = 0')}) WHERE {_BITDIST.format(a='e.embedding', b='q.embedding')} <= 12")
def l8(spark, sf_dir):
    """Pairs of one bucket that differ in at most 12 bits: a join by buckets, never of all pairs."""
    index = lsh_index(spark, sf_dir)
    a, b = (index.select("table", "key", F.col("id").alias(n), F.col("vector").alias(f"v{n}")) for n in ("a", "b"))
    met = a.join(b, ["table", "key"]).where("a < b").withColumn("distance", hv.hamming(F.col("va"), F.col("vb")).cast("int")).where("distance <= 12")
    return met.select("a", "b", "distance").distinct()


@query("w3_session_bm25", """WITH d AS (SELECT conv_id || ':' || turn AS id, conv_id, text FROM conversations WHERE turn = 0), k AS (SELECT id, conv_id, """ + _KW.format("text") + """ AS k FROM d),
p AS (SELECT id, t, count(*) AS tf FROM (SELECT id, unnest(k) AS t FROM k) GROUP BY id, t), df AS (SELECT t, count(*) AS df FROM p GROUP BY t), c AS (SELECT count(*) AS n, avg(len(k)) AS a FROM k),
s AS (SELECT p.id, sum((ln(n + 1) - ln(df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * len(k) / a))) AS score FROM p JOIN df USING (t) JOIN k USING (id), c WHERE t IN ('the', 'of', 'and') GROUP BY p.id HAVING score > 0)
SELECT id, round(score, 6) AS score FROM (SELECT * FROM s ORDER BY s.score DESC, id LIMIT 50) ORDER BY score DESC, id LIMIT 5""")
def w3(spark, sf_dir):
    from .harness import Conversations

    m = Memory(spark, _folder(spark, "store"), now=1)
    rows = _t(spark, sf_dir, "conversations").where("turn = 0").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    m.upsert(rows.select("id", F.array(F.lit(1).cast("long")).alias("vector"), F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("searchable_text"))).alias("metadata")))
    return Conversations(m).query_bm25("the of and", None, 5).withColumn("score", _r("score"))


@query("w5_session_keywords", """WITH d AS (SELECT conv_id || ':' || turn AS id, conv_id, coalesce(text, '') AS text FROM conversations), k AS (SELECT id, conv_id, """ + _KW.format("text") + """ AS k FROM d),
p AS (SELECT id, t, count(*) AS tf FROM (SELECT id, unnest(k) AS t FROM k) GROUP BY id, t), df AS (SELECT t, count(*) AS df FROM p GROUP BY t), c AS (SELECT count(*) AS n, avg(len(k)) AS a FROM k),
s AS (SELECT p.id, any_value(conv_id) AS conv_id, sum((ln(n + 1) - ln(df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * len(k) / a))) AS score FROM p JOIN df USING (t) JOIN k USING (id), c WHERE t IN ('the', 'of', 'and') GROUP BY p.id HAVING score > 0)
SELECT id, round(score, 6) AS score FROM s WHERE conv_id IN (3, 5) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY s.score DESC, id) <= 5""")
def w5(spark, sf_dir):
    """The best turns of two sessions by keywords; statistics span all turns of all sessions."""
    from .harness import Conversations

    m = Memory(spark, _folder(spark, "store"), now=1)
    rows = _t(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.coalesce("text", F.lit("")).alias("searchable_text"), F.col("conv_id").cast("string").alias("session_id"))
    m.upsert(rows.select("id", F.array(F.lit(1).cast("long")).alias("vector"), F.to_json(F.struct("searchable_text", "session_id")).alias("metadata")))
    told = Conversations(m)
    return told.query_bm25("the of and", "3", 5).unionByName(told.query_bm25("the of and", "5", 5)).withColumn("score", _r("score"))


@query("b1_incremental_index", r"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 10 = 0 THEN 'the the ' || text ELSE text END AS text FROM documents WHERE doc_id % 10 <> 1),
k AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '[ 	

]+'), lambda t: t <> '') AS k FROM d),
p AS (SELECT id, t, count(*) AS tf FROM (SELECT id, unnest(k) AS t FROM k) GROUP BY id, t), df AS (SELECT t, count(*) AS df FROM p GROUP BY t), c AS (SELECT count(*) AS n, avg(len(k)) AS a FROM k)
SELECT p.id, round(sum((ln(n + 1) - ln(df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * len(k) / a))), 6) AS score
FROM p JOIN df USING (t) JOIN k USING (id), c WHERE t IN ('and', 'of', 'und') GROUP BY p.id HAVING score > 0""")
def b1_incremental(spark, sf_dir):
    """All scores of an index that was built once and then followed an upsert and a deletion by small segments."""
    m = Memory(spark, _folder(spark, "store"), now=1)
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.array(F.col("doc_id").cast("long")).alias("vector"), "text")
    rows = lambda df: df.select("id", "vector", F.to_json(F.struct(F.col("text").alias("searchable_text"))).alias("metadata"))  # noqa: E731
    m.upsert(rows(d))
    m.text_index()
    m.upsert(rows(d.where("cast(id as long) % 10 = 0").withColumn("text", F.concat(F.lit("the the "), "text"))))
    m.text_index()
    m.delete_rows(d.where("cast(id as long) % 10 = 1").select("id"))
    return m.text_index().scores(["and", "of", "und"]).select("id", _r("score").alias("score"))


@query("e7_expiries_in_a_stream", "SELECT event_type AS namespace, CAST(user_id AS VARCHAR) AS id, CAST(arg_max(ts, event_id) AS TIMESTAMP) + INTERVAL 1 DAY AS expires_at FROM events GROUP BY 1, 2 HAVING CAST(arg_max(ts, event_id) AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT CAST(max(ts) AS TIMESTAMP) FROM events)")
def e7(spark, sf_dir):
    """Each event lets its user's row of that kind live one day longer; rows whose time is up when the stream ends."""
    folder, conf = _folder(spark, "expiries"), "spark.sql.streaming.stateStore.providerClass"
    stream = spark.readStream.schema(_t(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    writes = stream.select(F.col("event_type").alias("namespace"), F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), (F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 DAY")).alias("expires_at"))
    before = spark.conf.get(conf)
    spark.conf.set(conf, timers.PROVIDER)
    try:
        q = timers.expiries(writes).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        q.start().awaitTermination()
    finally:
        spark.conf.set(conf, before)
    return spark.read.parquet(f"{folder}/out").withColumn("expires_at", F.col("expires_at").cast("timestamp_ntz"))
