"""The registered queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fixity, jaccard, leaks, licenses, manifest, packing, preferences, quality, rans, repeats, runs, substrings, urls
from .common import stored, table

#: Words of the contracts, as a DuckDB expression over ``text``.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _op1_sql() -> str:
    """The rules, and the steps over host links until little is left to move."""
    rules = sorted(urls.RULES, key=lambda r: (len(r.rule), r.rule), reverse=True)
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.rule}'" for r in rules) + " END"
    by_rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in rules) + " END"
    host = lambda u: f"translate(regexp_extract({u}, '://([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}')"
    href = urls.HREF.replace("'", "''")
    return rf"""
WITH RECURSIVE p AS (
  SELECT page_id, html, coalesce({host("url")}, '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), r AS (
  SELECT *, {rule} AS rule, {by_rule} AS by_rule FROM p
), h AS (
  SELECT host, count(*) AS n, count(*) FILTER (by_rule = 'allow') AS a, count(*) FILTER (by_rule = 'block') AS b FROM r WHERE host <> '' GROUP BY host
), s AS (
  SELECT *, b >= {urls.SEED_SHARE} * n AS bad, NOT (b >= {urls.SEED_SHARE} * n) AND a > 0 AS good FROM h
), l AS (
  SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{href}', 1)) AS href FROM p
), e AS (
  SELECT src, dst, count(*) AS n FROM (
    SELECT src, {host("CASE WHEN starts_with(href, '//') THEN 'x:' || href ELSE href END")} AS dst FROM l WHERE regexp_matches(href, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//')
  ) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst
), o AS (SELECT src, sum(n) AS n FROM e GROUP BY src), i AS (SELECT dst, sum(n) AS n FROM e GROUP BY dst)
, ways AS (
  SELECT 'trust' AS kind, src AS host, dst AS next, e.n / o.n AS share FROM e JOIN o USING (src)
  UNION ALL SELECT 'distrust', dst, src, e.n / i.n FROM e JOIN i USING (dst)
), m(kind, host, mass, moving) AS (
  SELECT 'trust', host, a / (SELECT CAST(sum(a) AS DOUBLE) FROM s WHERE good), 1.0::DOUBLE FROM s WHERE good
  UNION ALL SELECT 'distrust', host, b / (SELECT CAST(sum(b) AS DOUBLE) FROM s WHERE bad), 1.0::DOUBLE FROM s WHERE bad
), walk(kind, host, mass, moving) AS (
  SELECT * FROM m
  UNION ALL
  SELECT kind, host, mass, sum(mass) OVER () FROM (
    SELECT walk.kind, ways.next AS host, {urls.DAMPING} * sum(walk.mass * ways.share) AS mass
    FROM walk JOIN ways ON ways.kind = walk.kind AND ways.host = walk.host WHERE walk.moving >= {urls.LEFT} GROUP BY walk.kind, ways.next
  )
)
, t AS (SELECT host, sum(mass) AS m FROM walk WHERE kind = 'trust' GROUP BY host), d AS (SELECT host, sum(mass) AS m FROM walk WHERE kind = 'distrust' GROUP BY host)
SELECT page_id, r.host, path, rule, coalesce(by_rule, CASE WHEN coalesce(d.m, 0) > coalesce(t.m, 0)
       AND d.m >= {urls.FLOOR} / greatest(1, (SELECT count(*) FROM s WHERE bad)) THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN t ON t.host = r.host LEFT JOIN d ON d.host = r.host
"""


#: Pages that one archive file of the audit holds, by their numbers.
_PER_ARCHIVE = 256


def _replica(page: Column, record: Column) -> Column:
    """A second copy of a record with damage that the page number tells: a byte changed, a record cut, one lost (null)."""
    n = F.length(record)
    half = F.floor(n / 2).cast("int")
    changed = F.concat(F.substring(record, F.lit(1), half), F.lit("?"), F.substring(record, half + 2, n))
    return F.when(page % 401 == 7, F.lit(None)).when(page % 89 == 5, F.substring(record, F.lit(1), n - 7)).when(page % 97 == 13, changed).otherwise(record)


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records of archive files, offsets by the order of their numbers, against a damaged replica.

    Records are hashed where they are read; sizes and digests alone are moved to add up the offsets.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", fixity.warc_record(F.col("url"), F.col("html")).alias("record"))
    archive = F.format_string("part-%06d.warc", F.floor(F.col("page_id") / _PER_ARCHIVE))
    # pages without a number are dealt out by what they hold
    archive = F.when(F.col("page_id").isNotNull(), archive).otherwise(F.format_string("part-none-%06d.warc", F.pmod(F.xxhash64("record"), F.lit(1 << 16))))
    copy = _replica(F.col("page_id"), F.col("record"))
    hashed = pages.select("page_id", archive.alias("archive"), F.octet_length("record").cast("long").alias("size"), fixity.digest_of(F.col("record")).alias("first"), F.when(copy.isNotNull(), fixity.digest_of(copy)).alias("second"))
    # pages that share a number stand in the order of their digests; both replicas read the offsets that were written once
    before = Window.partitionBy("archive").orderBy("page_id", "first", "second").rowsBetween(Window.unboundedPreceding, -1)
    placed = stored(hashed.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0))), "placed")
    side = lambda c: placed.where(F.col(c).isNotNull()).select("archive", "offset", F.col(c).alias("digest"))
    return fixity.audit(side("first"), side("second"))


OP2_SQL = f"""
WITH r AS (
  SELECT page_id, format('part-{{:06d}}.warc', page_id // {_PER_ARCHIVE}) AS archive,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
         || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))
         || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages
), a AS (
  SELECT *, CAST(coalesce(sum(strlen(record)) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM r
), b AS (
  SELECT archive, off, CASE WHEN page_id % 89 = 5 THEN substr(record, 1, length(record) - 7)
         WHEN page_id % 97 = 13 THEN substr(record, 1, length(record) // 2) || '?' || substr(record, length(record) // 2 + 2) ELSE record END AS record
  FROM a WHERE page_id % 401 <> 7
)
SELECT a.archive, a.off AS offset, sha256(a.record) AS first_digest, sha256(b.record) AS second_digest,
       CASE WHEN b.record IS NULL THEN 'missing' ELSE 'changed' END AS damage
FROM a LEFT JOIN b ON a.archive = b.archive AND a.off = b.off WHERE b.record IS NULL OR a.record <> b.record
"""


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.deduplicate(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents
), win AS (
  SELECT r, i, array_to_string(ws[i:i + 34], ' ') AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1
), gone AS (
  SELECT DISTINCT r, i + k AS p FROM twice, (SELECT unnest(range(0, 35)) AS k)
), kept AS (
  SELECT w.r, string_agg(u.word, ' ' ORDER BY u.p) AS t, count(*) AS n
  FROM w, LATERAL (SELECT unnest(w.ws) AS word, unnest(range(1, len(w.ws) + 1)) AS p) u
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.r = w.r AND g.p = u.p) GROUP BY w.r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY x, y
), e AS (
  SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x) r USING (doc_id)
"""


def _stale(turns: DataFrame) -> DataFrame:
    """The rejected side: each conversation with its last reply replaced by the reply before it, or by none."""
    own = Window.partitionBy("conv_id").orderBy("turn")
    replies = turns.where(F.col("role") == preferences.ASSISTANT).select("conv_id", "turn", F.lag("text").over(own).alias("before"), F.lead("turn").over(own).alias("next"))
    last = replies.where(F.col("next").isNull()).select("conv_id", "turn", F.coalesce("before", F.lit("")).alias("before"), F.lit(True).alias("last"))
    return turns.join(last, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", F.when(F.col("last") & (F.col("role") == preferences.ASSISTANT), F.col("before")).otherwise(F.col("text")).alias("text"))


def _spelt(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")


def op5_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    made = preferences.pair(turns, _stale(turns))
    return made.withColumns({c: _spelt(c) for c in ("chosen_spans", "rejected_spans")})


OP5_SQL = """
WITH t AS (
  SELECT conv_id, turn, role, text, role = 'assistant' AND turn = max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS final FROM conversations
), b AS (
  SELECT conv_id, turn, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before FROM t WHERE role = 'assistant'
), s AS (
  SELECT t.conv_id, t.turn, t.role, t.text AS c, CASE WHEN final THEN before ELSE text END AS r FROM t LEFT JOIN b ON b.conv_id = t.conv_id AND b.turn = t.turn
), d AS (
  SELECT *, min(CASE WHEN c IS DISTINCT FROM r THEN turn END) OVER (PARTITION BY conv_id) AS split FROM s
), e AS (
  SELECT *, split IS NULL OR turn < split AS common, '<|im_start|>' || coalesce(role, '') || chr(10) AS head, '<|im_end|>' || chr(10) AS foot FROM d
), f AS (
  SELECT *, head || coalesce(c, '') || foot AS cc, head || coalesce(r, '') || foot AS rr FROM e
), g AS (
  SELECT *, coalesce(sum(length(cc)) OVER w, 0) + length(head) AS cs, coalesce(sum(length(rr)) OVER w, 0) + length(head) AS rs FROM f
  WINDOW w AS (PARTITION BY conv_id, common ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT conv_id, count(*) FILTER (common) AS n_prompt, coalesce(string_agg(cc, '' ORDER BY turn) FILTER (common), '') AS prompt,
       coalesce(string_agg(cc, '' ORDER BY turn) FILTER (NOT common), '') AS chosen, coalesce(string_agg(rr, '' ORDER BY turn) FILTER (NOT common), '') AS rejected,
       coalesce(string_agg(CAST(cs AS BIGINT) || '-' || CAST(cs + length(coalesce(c, '')) + length(foot) AS BIGINT), ',' ORDER BY turn) FILTER (NOT common AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg(CAST(rs AS BIGINT) || '-' || CAST(rs + length(coalesce(r, '')) + length(foot) AS BIGINT), ',' ORDER BY turn) FILTER (NOT common AND role = 'assistant'), '') AS rejected_spans
FROM g GROUP BY conv_id
"""


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.cascade(docs, features=quality.BASE)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *quality.BASE, failed.alias("base_failed"), "kept")


OP6_SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents
), lines AS (
  SELECT r, line, count(*) AS c FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line
), dup AS (
  SELECT r, sum(c) AS n_lines, sum(c - 1) AS n_dup_lines FROM lines GROUP BY r
), grams AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c
  FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)
), rep AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE c > 1) GROUP BY r
), f AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
         length(text) - length(replace(text, '!', '')) AS n_bangs
  FROM w LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 50 * n_lines
            OR 100 * n_upper > 50 * word_chars OR 100 * n_bangs > 30 * n_words
            OR word_chars > 12 * n_words OR word_chars < 2 * n_words) AS kept
FROM b
"""


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def licence_base_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op7_license_scans`` that its phrases alone decide, which SQL can state."""
    return op7_license_scans(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def _base_phrases_sql() -> str:
    """Every place of every phrase."""
    hit = lambda p: " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(p.split()))
    label = "CASE " + " ".join(f"WHEN {hit(p)} THEN '{x}'" for p, x in licenses.PHRASES.items()) + " END"
    return rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), p AS (
  SELECT r, i - 1 AS place, {label} AS label FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)
), b AS (
  SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM p WHERE label IS NOT NULL GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels
FROM w LEFT JOIN b USING (r)
"""


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = rans.read_tokens(rans.write_tokens(docs))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = leaks.screen(docs, table(spark, sf_dir, "benchmark"), short=True).select("doc_id", F.explode("leaks").alias("leak"))
    return found.select("doc_id", "leak.item_id", "leak.edits", "leak.start", "leak.end")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def _crc32(c: Column) -> Column:
    """Unsigned CRC-32 of a number's decimal digits."""
    return F.crc32(c.cast("string"))


def _crc32_sql(text: str) -> str:
    """The same in SQL: bit by bit over the bytes of an ASCII text."""
    bit = lambda c: f"CASE WHEN {c} & 1 = 1 THEN xor(3988292384, {c} >> 1) ELSE {c} >> 1 END"
    byte = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda d, _: " + bit("d") + ")"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: {byte}))"


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.deduplicate(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS x FROM documents
), s AS (
  SELECT r, i, md5(substr(x, 2 * i + 1, 800)) AS g FROM (SELECT r, x, unnest(range(0, n - 399)) AS i FROM d WHERE n >= 400)
), twice AS (
  SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS c FROM s) WHERE c > 1
), spans AS (
  SELECT r, min(i) AS a, max(i) + 400 AS b FROM (SELECT r, i, sum(CASE WHEN i <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS k FROM twice) GROUP BY r, k
), kept AS (
  SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS from_ FROM spans
), cut AS (
  SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(x, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS x FROM kept JOIN d USING (r) GROUP BY r
)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(cut.x, d.x))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    # what is checked against the manifest: the same rows, some with a length that is one too large
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = manifest.leaf_of(*[F.col("n_chars") + 1 if f == "n_chars" else F.col(f) for f in fields])
    made = manifest.build(docs, "doc_id", "lang", fields, F.when(_crc32(F.col("doc_id")) % 7 == 0, tampered))
    return made.withColumnRenamed("key", "doc_id").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _op12_sql() -> str:
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda n: f"sha256({' || '.join(map(part, ('doc_id', 'source', 'lang', n, 'text')))})"
    return f"""
WITH RECURSIVE l AS (
  SELECT doc_id, lang, {leaf("n_chars")} AS leaf, CASE WHEN {_crc32_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {leaf("(n_chars + 1)")} END AS claim FROM documents
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM l
), low(lang, level, pos, h, n) AS (
  SELECT lang, 0, rank, leaf, count(*) OVER (PARTITION BY lang) FROM r
  UNION ALL
  SELECT lang, any_value(level) + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM low WHERE n > 1 GROUP BY lang, pos // 2
), sub AS (
  SELECT lang, level AS depth, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank FROM low WHERE n = 1
), high(level, pos, h, n) AS (
  SELECT 0, rank, h, count(*) OVER () FROM sub
  UNION ALL
  SELECT any_value(level) + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM high WHERE n > 1 GROUP BY pos // 2
), top AS (
  SELECT level AS depth, h AS root FROM high WHERE n = 1
), steps AS (
  SELECT r.doc_id, r.lang, r.rank, s.h AS subroot, top.root, r.leaf, coalesce(r.claim, r.leaf) AS now, s.depth, top.depth AS depth_above, s.rank AS group_rank
  FROM r JOIN sub s ON s.lang IS NOT DISTINCT FROM r.lang, top
), walk(doc_id, lang, leaf, subroot, root, depth, total, group_rank, level, pos, now, proof) AS (
  SELECT doc_id, lang, leaf, subroot, root, depth, depth + depth_above, group_rank, 0, CASE WHEN depth > 0 THEN rank ELSE group_rank END, now, '' FROM steps
  UNION ALL
  SELECT w.doc_id, w.lang, w.leaf, w.subroot, w.root, w.depth, w.total, w.group_rank, w.level + 1,
         CASE WHEN w.level + 1 = w.depth THEN w.group_rank ELSE w.pos // 2 END,
         sha256(CASE WHEN w.pos % 2 = 1 THEN coalesce(a.h, b.h, '') || w.now ELSE w.now || coalesce(a.h, b.h, '') END), w.proof || coalesce(a.h, b.h, '')
  FROM walk w
  LEFT JOIN low a ON w.level < w.depth AND a.lang IS NOT DISTINCT FROM w.lang AND a.level = w.level AND a.pos = xor(w.pos, 1)
  LEFT JOIN high b ON w.level >= w.depth AND b.level = w.level - w.depth AND b.pos = xor(w.pos, 1)
  WHERE w.level < w.total
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, now AS folded_root, now = root AS verified FROM walk WHERE level = total
"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # every tenth text, by the checksum of its number, gets a periodic end
    h = _crc32(F.col("doc_id"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size("_words"), F.floor(F.col("_h") / 10)
    # a text without words has no place; its remainder must not fail
    at, times = (g % F.greatest(n, F.lit(1))).cast("int"), (3 + g % 8).cast("int")
    period = (1 + F.floor((n - F.col("_at")) / F.col("_times"))).cast("int")
    repeated = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("_words", F.when(i >= F.col("_at"), F.col("_at") + (i - F.col("_at")) % F.col("_period")).otherwise(i)))
    plant = F.col("_h") % 10 == 0
    docs = docs.withColumn("_h", h).withColumn("_words", F.when(plant, words)).withColumn("_at", at).withColumn("_times", times).withColumn("_period", period)
    docs = docs.select("doc_id", F.when(plant & (n > 0), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))
    found = runs.find(docs)
    spelt = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(spelt, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


OP13_SQL = rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws, {_crc32_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents
), a AS (
  SELECT *, len(ws) AS n, (h // 10) % greatest(len(ws), 1) AS a, h // 10 AS g FROM t
), w AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
         THEN list_transform(range(0, n), lambda i: ws[CAST(1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END AS BIGINT)]) ELSE ws END AS ws FROM a
), p AS (
  SELECT r, n, unnest(range(0, n)) AS i, unnest(ws) AS word FROM w
), alike AS (
  SELECT x.r, y.i - x.i AS q, x.i FROM p x JOIN p y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), islands AS (
  SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM alike
), stretches AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
  SELECT r, start, length, min(q) AS period FROM stretches GROUP BY r, start, length
), best AS (
  SELECT r, start, length, period, count(*) OVER (PARTITION BY r) AS n_runs, row_number() OVER (PARTITION BY r ORDER BY length / period DESC, start, period) AS k FROM runs
), spelt AS (
  SELECT r, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM runs GROUP BY r
), gone AS (
  SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM p ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(spelt.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM w LEFT JOIN (SELECT * FROM best WHERE k = 1) USING (r) LEFT JOIN spelt USING (r) LEFT JOIN kept USING (r)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_warc_fixity": op2_warc_fixity,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_preference_formatting": op5_preference_formatting,
    "op6_quality_rules": op6_quality_rules,
    "op7_license_scans": op7_license_scans,
    "licence_base_phrases": licence_base_phrases,
    "op8_token_files": op8_token_files,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_suffix_array_dedup": op11_suffix_array_dedup,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": _op1_sql(),
    "op2_warc_fixity": OP2_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op4_ngram_jaccard_join": OP4_SQL,
    "op5_preference_formatting": OP5_SQL,
    "op6_quality_rules": OP6_SQL,
    "licence_base_phrases": _base_phrases_sql(),
    "op11_suffix_array_dedup": OP11_SQL,
    "op12_merkle_manifest": _op12_sql(),
    "op13_periodic_runs": OP13_SQL,
}
