"""State and timers in a stream: rows that expire, and attempts that fail, each kept where its key is.

Both run on Spark's stateful operator with event time, so a row's expiry is noticed by the task that has it when the
watermark passes it, without a scan of the table. The session needs a state store that can hold timers:
``spark.sql.streaming.stateStore.providerClass`` as in :data:`PROVIDER`.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Parts of the state of :func:`expiries`.
BUCKETS = 1024

_HELD = pa.schema([("namespace", pa.string()), ("id", pa.string()), ("seq", pa.int64()), ("us", pa.int64()), ("told", pa.int64())])
_EXPIRED = T.StructType([T.StructField("namespace", T.StringType()), T.StructField("id", T.StringType()), T.StructField("expires_at", T.TimestampType())])
_SILENT = T.StructType([T.StructField("namespace", T.StringType()), T.StructField("query", T.StringType()), T.StructField("attempts", T.LongType()), T.StructField("at", T.TimestampType())])


def _us(t: pd.Timestamp) -> int:
    return t.value // 1000


def _time(us: int) -> datetime:
    return datetime.fromtimestamp(us // 1_000_000, timezone.utc) + timedelta(microseconds=us % 1_000_000)


def _timer(us: int) -> int:
    """The first millisecond, which is what timers know, that is not before a time."""
    return -(-us // 1000)


class _Expiry(StatefulProcessor):
    """The times at which a bucket's rows expire; one timer for the first of them.

    A call of the state costs far more than a row, so a bucket's rows are one value: for each row its ``seq``, when it
    expires in microseconds, and from which millisecond of the watermark on that is told (both null: never, or told).
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", T.StructType([T.StructField("timer", T.LongType()), T.StructField("rows", T.BinaryType())]))

    def _read(self) -> tuple[int | None, dict[tuple, tuple]]:
        got = self.held.get()
        if got is None:
            return None, {}
        rows = pa.ipc.open_stream(bytes(got[1])).read_all()
        namespace, id_, seq, us, told = (c.to_pylist() for c in rows.columns)
        return got[0], dict(zip(zip(namespace, id_, strict=True), zip(seq, us, told, strict=True), strict=True))

    def _write(self, before: int | None, rows: dict[tuple, tuple], fired: bool) -> None:
        timer = min((told for _, _, told in rows.values() if told is not None), default=None)
        if before is not None and before != timer and not fired:
            self.handle.deleteTimer(before)
        if timer is not None and (before != timer or fired):
            self.handle.registerTimer(timer)
        columns = [*zip(*rows, strict=True), *zip(*rows.values(), strict=True)]
        table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _HELD, strict=True)], schema=_HELD)
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, _HELD) as to:
            to.write_table(table)
        self.held.update((timer, out.getvalue().to_pybytes()))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        timer, held = self._read()
        # a time that has passed is due at once
        soon = timerValues.getCurrentWatermarkInMs() + 1
        before = {}
        for batch in rows:
            for namespace, id_, n, at in zip(batch["namespace"], batch["id"], batch["seq"], batch["expires_at"], strict=True):
                row = (namespace, id_)
                was = held.get(row)
                if was is None or n >= was[0]:  # the latest write counts, in whatever order they come
                    before.setdefault(row, was)
                    held[row] = (int(n), None if pd.isna(at) else _us(at), None)
        for row, was in before.items():
            seq, us, _ = held[row]
            if us is not None:
                held[row] = (seq, us, was[2] if was is not None and was[1] == us else max(_timer(us), soon))
        if before:
            self._write(timer, held, False)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        timer, held = self._read()
        now = timerValues.getCurrentWatermarkInMs()
        up = [(row, us) for row, (_, us, told) in held.items() if told is not None and told <= now]
        for row, _ in up:
            held[row] = (held[row][0], None, None)
        self._write(timer, held, True)
        return iter([pd.DataFrame({"namespace": [r[0] for r, _ in up], "id": [r[1] for r, _ in up], "expires_at": [_time(us) for _, us in up]})] if up else [])

    def close(self) -> None:
        pass


def expiries(writes: DataFrame, late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """``namespace``, ``id`` and ``expires_at`` of rows whose time is up, each once, as the watermark passes it.

    ``writes`` is a stream of ``namespace``, ``id``, ``seq`` (a number that ascends with the writes of a row), ``at`` (event
    time of the write) and ``expires_at`` (null: never, or deleted). Of several writes of a row the one with the greatest
    ``seq`` counts, also if it comes first. Writes later than ``late`` behind the newest are dropped. State is kept by
    ``buckets`` hashes of rows, each read and written as one, so their number should follow that of the rows (some
    thousand a bucket); it can't change while a checkpoint lives.
    """
    rows = writes.select("namespace", "id", F.col("seq").cast("long"), F.col("at").cast("timestamp"), F.col("expires_at").cast("timestamp")).withWatermark("at", late)
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64("namespace", "id"), F.lit(buckets)).cast("int"))
    return dealt.groupBy("_bucket").transformWithStateInPandas(_Expiry(), _EXPIRED, "Append", "EventTime")


class _Attempts(StatefulProcessor):
    """Failed attempts of a text at one revision, forgotten after some time without one."""

    def __init__(self, attempts: int, seconds: int) -> None:
        self.attempts, self.us = attempts, 1_000_000 * seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("revision", T.LongType()), T.StructField("n", T.LongType()), T.StructField("us", T.LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        revision, n, last = self.seen.get() if self.seen.exists() else (None, 0, None)
        before, out = last, []
        batch = pd.concat(list(rows)).sort_values(["at", "revision", "found"], kind="stable")
        for at, r, found in zip(batch["at"], batch["revision"], batch["found"], strict=True):
            us = _us(at)
            if found:
                revision, n, last = None, 0, None
                continue
            fresh = last is not None and revision == r and us - last < self.us
            revision, n, last = int(r), n + 1 if fresh else 1, us
            if n == self.attempts:
                out.append((key[0], key[1], n, _time(us)))
        if before is not None and before != last:
            self.handle.deleteTimer(_timer(before + self.us))
        if last is None:
            self.seen.clear()
        else:
            self.seen.update((revision, n, last))
            if before != last:
                self.handle.registerTimer(max(_timer(last + self.us), timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"namespace": pd.Series([x[0] for x in out], dtype=str), "query": pd.Series([x[1] for x in out], dtype=str), "attempts": pd.Series([x[2] for x in out], dtype="int64"), "at": pd.to_datetime([x[3] for x in out], utc=True)})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        if self.seen.exists() and _timer(self.seen.get()[2] + self.us) <= expiredTimerInfo.getExpiryTimeInMs():
            self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def silenced(asked: DataFrame, attempts: int = 3, seconds: int = 300, late: str = "0 seconds") -> DataFrame:
    """``namespace``, ``query``, ``attempts`` and ``at`` of the attempt from which on a text need not be searched again.

    ``asked`` is a stream of ``namespace``, ``query``, ``revision``, ``at`` and ``found``. Attempts that found nothing count
    up while they are of one revision and less than ``seconds`` apart; one that found something ends the count. State is
    dropped when its time is up. Rows later than ``late`` behind the newest are dropped.
    """
    rows = asked.select("namespace", "query", F.col("revision").cast("long"), F.col("at").cast("timestamp"), F.col("found").cast("boolean")).withWatermark("at", late)
    return rows.groupBy("namespace", "query").transformWithStateInPandas(_Attempts(attempts, seconds), _SILENT, "Append", "EventTime")
