"""The change feed as a stream: filters, envelopes, sinks and periodic purges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.schemas import EVENTS
from ..sources.tables import Store

KINDS = ("ConceptInjected", "ConceptUpdated", "ConceptDeleted", "Associated", "Disassociated", "PatternRecognized", "AttractorFired")


def subscribe(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Change events as a stream of the log folder. Slow readers lose nothing."""
    reader = spark.readStream.schema(EVENTS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def feed(spark: SparkSession, store: Store, files_per_trigger: int | None = None) -> DataFrame:
    """The change events of a store as a stream: :data:`EVENTS` and ``commit``, which ascends with the commits.

    Only what a commit has made count is there, and a query with a checkpoint gets each event once, also after a restart.
    """
    store.state()
    store.release()
    fs, p = store._fs(f"{store.root}/events")
    fs.mkdirs(p)
    reader = spark.readStream.schema(StructType([*EVENTS.fields, StructField("commit", LongType())]))
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{store.root}/events")


def of_kind(kind: str = "all") -> Column:
    if kind != "all" and kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")
    return F.lit(True) if kind == "all" else F.col("kind") == kind


def cloud_events(events: DataFrame, source: str) -> DataFrame:
    """CloudEvents 1.0 envelopes as JSON."""
    data = F.to_json(F.struct("id", "other_id", "score", "namespace"))
    stamp = F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    key = F.sha2(F.concat_ws("|", "kind", "namespace", "id", "other_id", F.col("at").cast("string")), 256)
    return events.select(F.to_json(F.struct(F.lit("1.0").alias("specversion"), key.alias("id"), F.lit(source).alias("source"), F.concat(F.lit("memory."), F.lower("kind")).alias("type"), stamp.alias("time"), F.lit("application/json").alias("datacontenttype"), F.parse_json(data).alias("data"))).alias("event"))


def watch(events: DataFrame, emit: Callable[[DataFrame, int], None], checkpoint: str, kind: str = "all") -> StreamingQuery:
    """Give each micro-batch of matching events to ``emit``; all there is, then stop."""
    return events.where(of_kind(kind)).writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Emitter:
    """What takes the events of a micro-batch; called by :func:`watch`. The plain one drops them."""

    def __call__(self, events: DataFrame, batch: int) -> None:
        return None


class LogEmitter(Emitter):
    """Each event as one line of a logger. Events of a batch come to the driver one partition at a time."""

    def __init__(self, log: Callable[[str], None], source: str = "tesserine") -> None:
        self.log, self.source = log, source

    def __call__(self, events: DataFrame, batch: int) -> None:
        for row in cloud_events(events, self.source).toLocalIterator():
            self.log(row.event)


class PostEmitter(Emitter):
    """Envelopes given to ``post`` (such as an HTTP client's) where they are, a list of JSON texts at a time."""

    def __init__(self, post: Callable[[list[str]], None], source: str = "tesserine", batch: int = 64) -> None:
        self.post, self.source, self.batch = post, source, batch

    def __call__(self, events: DataFrame, batch: int) -> None:
        post, step = self.post, self.batch

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sent = 0
            for b in batches:
                rows = b.column(0).to_pylist()
                for at in range(0, len(rows), step):
                    post(rows[at : at + step])
                sent += len(rows)
            yield pa.RecordBatch.from_arrays([pa.array([sent], pa.int64())], ["sent"])

        cloud_events(events, self.source).mapInArrow(send, "sent long").agg(F.sum("sent")).collect()


def counted(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", at: str = "ts") -> DataFrame:
    """Events by window and kind, late rows dropped after ``late``."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), "kind").agg(F.count(F.lit(1)).alias("n"))


def purge_every(ticks: DataFrame, purge: Callable[[], int], checkpoint: str, seconds: int) -> StreamingQuery | None:
    """Run ``purge`` at an interval; 0 turns it off."""
    if not seconds:
        return None
    return ticks.writeStream.foreachBatch(lambda _, __: purge()).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
