"""Readers: exports, JSON lines, Markdown, benchmark results, SQLite files, ontologies."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import preview
from . import schemas


def empty_analytics(spark: SparkSession) -> dict[str, DataFrame]:
    """The four analytics tables without rows."""
    return {name: spark.createDataFrame([], schema) for name, schema in schemas.ANALYTICS.items()}


def open_analytics(spark: SparkSession, database: str) -> None:
    """Create the four tables in a catalog database where they are missing."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, schema in schemas.ANALYTICS.items():
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({columns}) USING parquet")


def load_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Concepts and associations of a JSON export, the last of repeated keys; a concept without id is an error."""
    whole = spark.read.schema(schemas.EXPORT).json(path, multiLine=True)
    c = whole.select(F.posexplode("concepts").alias("pos", "c")).select("pos", "c.*")
    text = F.coalesce("text", F.get_json_object("metadata", "$.text"))
    concepts = c.select(
        F.when(F.col("id").isNull(), F.raise_error(F.lit("a concept has no id"))).otherwise(F.col("id")).alias("id"), text.alias("text"), F.coalesce("namespace", F.lit("default")).alias("namespace"),
        F.col("created_at").alias("created_at_us"), F.coalesce("modified_at", "created_at").alias("updated_at_us"), F.col("expires_at").alias("expires_at_us"), F.coalesce("metadata", F.lit("null")).alias("metadata_json"), "pos",
    )
    e = whole.select(F.posexplode("associations").alias("pos", "e")).select(F.col("e")[0].alias("src_id"), F.col("e")[1].alias("dst_id"), F.col("e")[2].cast("double").alias("strength"), "pos")
    return _last(concepts, ["id"]), _last(e, ["src_id", "dst_id"])


def _last(rows: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("pos"))
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "pos")


def load_benchmarks(spark: SparkSession, folder: str) -> DataFrame:
    """Every ``*.jsonl`` of a folder: suite by file name, microseconds of the latency, the whole line kept."""
    try:
        lines = spark.read.option("pathGlobFilter", "*.jsonl").text(folder)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schemas.ANALYTICS["benchmarks"])
        raise
    lines = lines.select("value", F.regexp_replace(F.col("_metadata.file_name"), r"\.jsonl$", "").alias("suite")).where(F.trim("value") != "")
    name = F.get_json_object("value", "$.query_id")
    latency = F.get_json_object("value", "$.latency_ms").cast("double")
    wanted = lambda c, what: F.when(c.isNull(), F.raise_error(F.lit(f"a result has no {what}"))).otherwise(c)
    none = F.lit(None)
    return lines.select("suite", wanted(name, "query_id").alias("name"), none.cast("string").alias("commit"), F.lit(0).cast("long").alias("run_at_us"), (wanted(latency, "latency_ms") * 1000).alias("p50_us"), none.cast("double").alias("p95_us"), none.cast("double").alias("p99_us"), F.col("value").alias("extras"))


def index_lines(lines: DataFrame, field: str = "text", id_field: str | None = None, tag_field: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines (``line`` number from 1, ``value``), and how many were skipped and why."""
    own = lambda f: F.get_json_object("value", f"$.{f}")
    parsed = F.try_parse_json("value")
    is_text = F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant")) == "STRING", F.lit(False))
    why = F.when(F.trim("value") == "", "blank").when(parsed.isNull(), "invalid").when(own(field).isNull(), "missing").when(~is_text, "not text").when(F.trim(own(field)) == "", "blank text")
    judged = lines.withColumn("why", why)
    id_ = F.concat(F.lit("jsonl:"), F.col("line").cast("string"))
    id_ = F.coalesce(own(id_field), id_) if id_field else id_
    tags = F.filter(F.transform(F.split(F.coalesce(own(tag_field), F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "") if tag_field else F.array().cast("array<string>")
    kept = judged.where("why is null").select(id_.alias("id"), F.col("line"), own(field).alias("searchable_text"), preview(own(field)).alias("text_preview"), tags.alias("tags"))
    return kept, judged.where("why is not null").groupBy("why").agg(F.count(F.lit(1)).alias("skipped"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file with their numbers from 1.

    Numbers come from the count of lines in each partition; a partition numbers its own, and only counts are collected.
    """
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    part = F.shiftright("at", 33)
    # a row's partition stands in the upper bits, and the parts of one file are read in order
    counts = lines.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    first = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return lines.withColumn("part", part).join(F.broadcast(first), "part").select((F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("line"), "value")


def chunks_by_heading(files: DataFrame, least: int = 2) -> DataFrame:
    """Sections of Markdown texts (``path``, ``value``): ``path``, ``idx``, ``level``, ``heading``, ``content``, ``fingerprint``.

    A heading line has one to six ``#`` and a text. Sections above level ``least`` and those without content are left
    out, as is what stands before the first heading. Lines are rows, and a section is the number of headings so far.
    """
    heading = r"^(#{1,6})\s+(\S.*)$"
    lines = files.select("path", F.posexplode(F.split(F.regexp_replace("value", "\r", ""), "\n")).alias("n", "line"))
    lines = lines.withColumn("mark", F.regexp_extract(F.trim("line"), heading, 1))
    upto = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("idx", F.count_if(F.col("mark") != "").over(upto).cast("int") - 1).where("idx >= 0")
    own = lines.groupBy("path", "idx").agg(
        F.max(F.when(F.col("mark") != "", F.struct(F.length("mark").alias("level"), F.regexp_extract(F.trim("line"), heading, 2).alias("heading")))).alias("h"),
        F.array_sort(F.collect_list(F.when(F.col("mark") == "", F.struct("n", "line")))).alias("body"),
    )
    content = F.array_join(F.transform("body", lambda x: x["line"]), "\n")
    sections = own.select("path", "idx", "h.level", "h.heading", F.trim(F.regexp_replace(content, r"^\n+|\n+$", "")).alias("content"))
    kept = sections.where((F.col("level") >= least) & (F.col("content") != ""))
    return kept.withColumn("fingerprint", F.sha2("content", 256)).withColumn("id", F.concat_ws(":", F.lit("md"), "path", F.col("level").cast("string"), F.col("idx").cast("string")))


def normalized_path(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")


def synced(existing: DataFrame, staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a sync deletes (chunks gone from sources that are staged) and what it leaves as it is (same fingerprint)."""
    sources = staged.select("path").distinct()
    gone = existing.join(sources, "path", "left_semi").join(staged.select("id"), "id", "left_anti")
    same = existing.join(staged.select("id", "fingerprint"), ["id", "fingerprint"], "left_semi")
    return gone, same


def sessions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SESSIONS).json(path).select("session_id", F.posexplode("turns").alias("turn", "t")).select("session_id", "turn", "t.*")


def query_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.QUERIES).json(path)


def ontology(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CANONICAL).json(path, multiLine=True)


def violations(concepts: DataFrame, edges: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """What makes an import invalid: ``problem`` and ``key``. ``existing`` ids may be the ends of edges when merging."""
    twice = concepts.groupBy("id").count().where("count > 1").select(F.lit("duplicate id").alias("problem"), F.col("id").alias("key"))
    pair = F.concat_ws(" -> ", "from_id", "to_id")
    edge_twice = edges.groupBy("from_id", "to_id").count().where("count > 1").select(F.lit("duplicate edge").alias("problem"), pair.alias("key"))
    bad = edges.where(~F.coalesce(F.col("strength").between(0.0, 1.0), F.lit(False))).select(F.lit("bad strength").alias("problem"), pair.alias("key"))
    ids = concepts.select("id") if existing is None else concepts.select("id").unionByName(existing.select("id"))
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct().join(ids, "id", "left_anti").select(F.lit("dangling end").alias("problem"), F.col("id").alias("key"))
    return twice.unionByName(edge_twice).unionByName(bad).unionByName(ends)


class SqliteSource(DataSource):
    """Batch source ``sqlite`` over a file that the executors can open: options ``path``, ``table``, ``columns``.

    The table is read in ranges of row ids, one partition each.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SqliteReader(schema, dict(self.options))


class _SqliteReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        self.names, self.options = schema.fieldNames(), options

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        con = self._open()
        low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.options["table"]}"').fetchone()
        con.close()
        step = int(self.options.get("rows", 100_000))
        return [InputPartition((a, min(a + step - 1, high))) for a in range(low, high + 1, step)] if low is not None else [InputPartition((0, -1))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        con = self._open()
        columns = ", ".join(f'"{n}"' for n in self.names)
        yield from con.execute(f'SELECT {columns} FROM "{self.options["table"]}" WHERE rowid BETWEEN ? AND ?', partition.value)
        con.close()


def attach_sqlite(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Concepts and associations of an older store file, all in the namespace ``default``."""
    spark.dataSource.register(SqliteSource)
    load = lambda table, columns: spark.read.format("sqlite").options(path=path, table=table, columns=columns).load()
    concepts = load("concepts", "id string, metadata string, created_at long, modified_at long, expires_at long")
    edges = load("associations", "from_id string, to_id string, strength double")
    shaped = concepts.select("id", F.get_json_object("metadata", "$.text").alias("text"), F.lit("default").alias("namespace"), F.col("created_at").alias("created_at_us"), F.col("modified_at").alias("updated_at_us"), F.col("expires_at").alias("expires_at_us"), F.col("metadata").alias("metadata_json"))
    return shaped, edges.select(F.col("from_id").alias("src_id"), F.col("to_id").alias("dst_id"), "strength")
