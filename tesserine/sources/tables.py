"""Versioned tables in a folder, and tables that cut the lineage of iterative plans."""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def checkpoint_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the context's own checkpoint folder; with a local master alone else a new one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tesserine-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and read back."""
    return _step(df)[0]


@contextmanager
def passing(df: DataFrame) -> Iterator[DataFrame]:
    """:func:`cut` for as long as a block runs; what is read from it must have been written by then."""
    rows, path = _step(df)
    try:
        yield rows
    finally:
        remove(df.sparkSession, path)


def _step(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/steps/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _fs(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def load_json(spark: SparkSession, path: str) -> dict:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def put_json(spark: SparkSession, path: str, content: dict) -> bool:
    """Make a small file appear whole under a new name; False if the name is taken."""
    folder = path.rpartition("/")[0]
    fs, aside = _fs(spark, f"{folder}/.{uuid.uuid4().hex}")
    out = fs.create(aside)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    to = _fs(spark, path)[1]
    if not fs.exists(to) and fs.rename(aside, to):
        return True
    fs.delete(aside, False)
    return False


class ConcurrentWrite(RuntimeError):
    """Another writer changed a table that a commit was made from."""


class Commit:
    """Changes of several tables that count together or not at all.

    Rows are written at once, to folders that no reader looks at; :meth:`Store.publish` makes them count by one file that
    names them all. ``read_at`` is the commit that the changes were made from, if they must not count when a table of
    theirs has changed since.
    """

    def __init__(self, store: Store, read_at: int | None = None) -> None:
        self.store, self.read_at, self.number = store, read_at, 0
        self.record: dict = {"parts": [], "counts": {}}

    def __enter__(self) -> Commit:
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        if kind is None:
            self.number = self.store.publish(self.record, self.read_at)

    def upsert(self, table: str, rows: DataFrame, keys: list[str] | None = None) -> None:
        """Rows of a table. Of such that share ``keys`` (a mistake of the writer) the first in column order stays."""
        if keys:
            # only keys are dealt out; rows are where some repeat, and then those alone
            twice = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
            if not twice.isEmpty():
                same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
                rest = [c for c in rows.columns if c not in keys]
                first = F.row_number().over(Window.partitionBy(*keys).orderBy(*(rest or keys)))
                one = rows.join(twice, same, "left_semi").withColumn("_r", first).where("_r = 1").drop("_r")
                rows = rows.join(twice, same, "left_anti").unionByName(one)
        self._add(table, rows, False)

    def delete(self, table: str, keys: DataFrame) -> None:
        """Tombstones; further columns don't matter."""
        self._add(table, keys, True)

    def _add(self, table: str, rows: DataFrame, deleted: bool) -> None:
        folder, n = self.store.written(table, rows.withColumn("_deleted", F.lit(deleted)))
        if n:
            self.record["parts"].append([table, folder, n])
        self.record.setdefault("touched", []).append(table)

    def events(self, rows: DataFrame) -> None:
        """Rows of the change feed."""
        folder, n = self.store.written("staged", rows)
        if n:
            self.record.setdefault("events", []).append(folder)

    def count(self, name: str) -> None:
        """One more change of what ``name`` stands for."""
        self.record["counts"][name] = self.record["counts"].get(name, 0) + 1


class Store:
    """Tables as append-only change logs under one folder, seen through the latest row of each key.

    A write is a folder of Parquet files of its own. A commit is one small file, ``commits/<n>.json``, that names the folders
    of all tables it changes; it appears by a rename, so readers see all of it or nothing. Its number is claimed by creating
    a file, which only one writer can; a claim whose writer is gone is taken over after ``claim_seconds``. Every
    ``STATE_EVERY`` commits the sum of all so far is written beside them, so a reader opens one file and the few after it.

    The latest row of a key wins, and a tombstone removes it. Which row that is, is found from keys and commit numbers of the
    logs alone: wide columns are only read where they count, and never shuffled. ``tidy`` merges logs when there are many of
    them, and writes a new base, clustered by key, when they hold a share of it. A large first log is the base as it stands.
    What went before is left to running readers until ``vacuum``.

    Rows for the change feed appear as ``events/commit=<n>``, also by a rename, after their commit counts. If a writer is
    lost in between, the next commit (or :meth:`release`) does it.
    """

    #: Commits between two sums; logs of a table that are merged; share of the base that logs may hold.
    STATE_EVERY, MOST_LOGS, SHARE = 32, 16, 0.25
    #: Rows of all logs of a table up to which their keys are sent to every executor.
    BROADCAST_ROWS = 1_000_000
    #: Bytes of files that one task sorts for a new base.
    SORTED_BYTES = 16 << 20

    def __init__(self, spark: SparkSession, root: str, claim_seconds: float = 10.0) -> None:
        self.spark, self.root, self.claim_seconds = spark, root.rstrip("/"), claim_seconds
        self._read: dict[int, dict] = {}

    # -- files

    def _fs(self, path: str):  # noqa: ANN202
        return _fs(self.spark, path)

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _names(self, folder: str) -> list[str]:
        return names(self.spark, f"{self.root}/{folder}")

    def _load(self, name: str) -> dict:
        return load_json(self.spark, f"{self.root}/commits/{name}")

    def _put(self, name: str, content: dict) -> bool:
        return put_json(self.spark, f"{self.root}/commits/{name}", content)

    def _create(self, name: str) -> bool:
        """Create an empty file; False if it is there. Only one of several writers gets True."""
        fs, p = self._fs(f"{self.root}/commits/{name}")
        fs.mkdirs(p.getParent())
        if fs.getUri().getScheme() == "file":  # Hadoop's own call looks first and writes then
            return self.spark._jvm.java.io.File(p.toUri().getPath()).createNewFile()
        try:
            return fs.createNewFile(p)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise

    def written(self, table: str, rows: DataFrame) -> tuple[str, int]:
        """A new folder with rows, which no reader looks at yet, and how many they are."""
        folder, seen = uuid.uuid4().hex, Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.root}/{table}/{folder}")
        return folder, seen.get["n"]

    # -- commits

    @staticmethod
    def _added(state: dict, record: dict) -> dict:
        """The state after a commit."""
        n = record["n"]
        state = {"n": n, "tables": dict(state["tables"]), "counts": dict(state["counts"]), "touched": dict(state["touched"])}
        for i, (table, folder, rows) in enumerate(record.get("parts", [])):
            old = state["tables"].get(table, {"base": None, "logs": []})
            state["tables"][table] = {**old, "logs": [*old["logs"], [folder, n * 1000 + i, rows]]}
        for table, folder, upto, rows, kind in record.get("merged", []):
            old = state["tables"][table]
            after = [x for x in old["logs"] if x[1] > upto]
            if kind != "log":  # a base that was a log is marked: it is not clustered
                state["tables"][table] = {"base": [folder, rows, upto, *(["adopted"] if kind == "adopted" else [])], "logs": after}
            else:
                state["tables"][table] = {**old, "logs": [[folder, upto, rows], *after]}
        for table in record.get("touched", []):
            state["touched"][table] = n
        for table in record.get("dropped", []):
            state["tables"].pop(table, None)
            state["touched"].pop(table, None)
        for name, by in record.get("counts", {}).items():
            state["counts"][name] = state["counts"].get(name, 0) + by
        return state

    def state(self) -> dict:
        """What counts now: the folders of each table, counters, and the last commit of each table."""
        names = self._names("commits")
        sums = [int(x.split(".")[0]) for x in names if x.endswith(".state")]
        last = max(sums, default=0)
        state = self._load(f"{last}.state") if last else {"n": 0, "tables": {}, "counts": {}, "touched": {}}
        commits = sorted(int(x.split(".")[0]) for x in names if x.endswith(".json"))
        for n in commits:
            if n > last:
                if n not in self._read:
                    self._read[n] = self._load(f"{n}.json")
                state = self._added(state, self._read[n])
        self._read = {n: r for n, r in self._read.items() if n > last}
        return state

    def commit(self, read_at: int | None = None) -> Commit:
        return Commit(self, read_at)

    def _claim(self, n: int) -> bool:
        """The right to write commit ``n``; False if another writer has written it meanwhile."""
        for k in range(1000):
            if self._create(f"{n}.claim{k}"):
                return True
            until = time.monotonic() + self.claim_seconds
            while time.monotonic() < until:
                if self._exists(f"{self.root}/commits/{n}.json"):
                    return False
                time.sleep(0.02)
        raise ConcurrentWrite(f"commit {n} can't be claimed")

    def publish(self, record: dict, read_at: int | None = None, needs: Callable[[dict], bool] | None = None) -> int:
        """Make a record count, under the number after the last."""
        while True:
            state = self.state()
            if read_at is not None and any(state["touched"].get(t, 0) > read_at for t in record.get("touched", [])):
                raise ConcurrentWrite(f"tables have changed since commit {read_at}")
            if needs is not None and not needs(state):
                raise ConcurrentWrite("what was to be merged is no longer there")
            n = state["n"] + 1
            if self._claim(n) and self._put(f"{n}.json", {"n": n, **record}):
                break
        self.release()
        if n % self.STATE_EVERY == 0:
            self._put(f"{n}.state", self.state())
            for name in self._names("commits"):
                number = name.split(".")[0]
                if number.isdigit() and int(number) <= n - self.STATE_EVERY:
                    fs, p = self._fs(f"{self.root}/commits/{name}")
                    fs.delete(p, False)
        return n

    def release(self) -> None:
        """Show the events of commits that count and whose writer has not done so."""
        staged = set(self._names("staged"))
        for n, record in self._read.items() if staged else ():
            for i, folder in enumerate(record.get("events", [])):
                if folder in staged:
                    fs, to = self._fs(f"{self.root}/events/commit={n * 1000 + i}")
                    fs.mkdirs(to.getParent())
                    fs.rename(self._fs(f"{self.root}/staged/{folder}")[1], to)

    def revision(self, table: str) -> int:
        """The last commit that changed a table."""
        return self.state()["touched"].get(table, 0)

    def counter(self, name: str) -> int:
        return self.state()["counts"].get(name, 0)

    def upsert(self, table: str, rows: DataFrame, keys: list[str] | None = None) -> int:
        with self.commit() as c:
            c.upsert(table, rows, keys)
        return c.number

    def delete(self, table: str, keys: DataFrame) -> int:
        with self.commit() as c:
            c.delete(table, keys)
        return c.number

    # -- reading

    def _scan(self, table: str, folders: list[str], schema: T.StructType) -> DataFrame:
        full = T.StructType([*schema.fields, T.StructField("_deleted", T.BooleanType())])
        return self.spark.read.schema(full).parquet(*[f"{self.root}/{table}/{f}" for f in folders])

    def _newest(self, table: str, logs: list[list], schema: T.StructType, keys: list[str]) -> tuple[DataFrame, DataFrame]:
        """Rows of logs that count, tombstones included, and the keys that logs speak of. Only keys are dealt out."""
        rows, n = self._scan(table, [f for f, _, _ in logs], schema), [n for _, _, n in logs]
        few = sum(n) <= self.BROADCAST_ROWS
        if len(logs) == 1:  # a log has a key once, or as often as a tombstone
            told = rows.select(*keys).distinct()
            return rows, F.broadcast(told) if few else told
        order = F.create_map(*[F.lit(x) for folder, at, _ in logs for x in (folder, at)])
        rows = rows.withColumn("_order", F.element_at(order, F.regexp_extract("_metadata.file_path", "/([0-9a-f]{32})/[^/]*$", 1)))
        last = rows.groupBy(*keys).agg(F.max("_order").alias("_order"))
        if not few and sum(n) - max(n) <= self.BROADCAST_ROWS:
            # many rows of which few can be outdone: those few keys travel, and wide rows stay where they are
            older = rows.select(*keys, "_order").distinct().withColumn("_last", F.max("_order").over(Window.partitionBy(*keys)))
            older = older.where("_order < _last").select(*keys, "_order")
            return rows.join(F.broadcast(older), [*keys, "_order"], "left_anti").drop("_order"), last.drop("_order")
        last = F.broadcast(last) if few else last
        return rows.join(last, [*keys, "_order"], "left_semi").drop("_order"), last.drop("_order")

    def read(self, table: str, schema: T.StructType, keys: list[str], state: dict | None = None) -> DataFrame:
        """The table as of now, or of a ``state``."""
        own = (state or self.state())["tables"].get(table)
        if own is None:
            return self.spark.createDataFrame([], schema)
        base = self._scan(table, [own["base"][0]], schema).select(*schema.fieldNames()) if own["base"] else None
        if not own["logs"]:
            return base
        rows, told = self._newest(table, own["logs"], schema, keys)
        rows = rows.where("not _deleted").select(*schema.fieldNames())
        return rows if base is None else base.join(told, keys, "left_anti").unionByName(rows)

    def changed(self, table: str, schema: T.StructType, keys: list[str], since: int, state: dict) -> DataFrame | None:
        """Keys that commits after ``since`` wrote or removed, and maybe some more; None where a new base hides them."""
        own = state["tables"].get(table)
        if own is None or (own["base"] and own["base"][2] >= 1000 * (since + 1)):
            return None
        logs = [f for f, at, _ in own["logs"] if at >= 1000 * (since + 1)]
        if not logs:
            return self.spark.createDataFrame([], T.StructType([schema[k] for k in keys]))
        return self._scan(table, logs, schema).select(*keys).distinct()

    # -- upkeep

    def _merge(self, table: str, schema: T.StructType, keys: list[str], state: dict, kind: str) -> int:
        own = state["tables"].get(table)
        if own is None or not (own["logs"] or own["base"][3:]):
            return state["n"]
        upto = own["logs"][-1][1] if own["logs"] else own["base"][2]
        if kind == "base":
            rows = self.read(table, schema, keys, state).withColumn("_deleted", F.lit(False))
            bytes_ = sum(self._bytes(f"{table}/{f}") for f in [*([own["base"][0]] if own["base"] else []), *(x[0] for x in own["logs"])])
            many = -(-bytes_ // self.SORTED_BYTES)  # what a task sorts does not grow with the table
            rows = (rows.repartitionByRange(many, *keys) if many > 8 else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys)
        else:
            rows = self._newest(table, own["logs"], schema, keys)[0]
        folder, n = self.written(table, rows)
        if not n and kind != "base":
            return state["n"]
        there = [x[0] for x in own["logs"]]
        same = lambda now: now["tables"].get(table, {}).get("base") == own["base"] and [x[0] for x in now["tables"][table]["logs"]][: len(there)] == there
        return self.publish({"merged": [[table, folder, upto, n, kind]]}, needs=same)

    def _adopt(self, table: str, schema: T.StructType, log: list) -> None:
        """Make the only log the base, without a copy; one that holds tombstones stays a log."""
        folder, upto, n = log
        if not self._scan(table, [folder], schema).where("_deleted").isEmpty():
            return
        alone = lambda now: (t := now["tables"].get(table, {})).get("base", folder) is None and t["logs"][0][0] == folder
        try:
            self.publish({"merged": [[table, folder, upto, n, "adopted"]]}, needs=alone)
        except ConcurrentWrite:
            pass

    def compact(self, table: str, schema: T.StructType, keys: list[str]) -> int:
        """Write the current view as the new base. Writes that go on meanwhile stay on top of it."""
        return self._merge(table, schema, keys, self.state(), "base")

    def tidy(self, table: str, schema: T.StructType, keys: list[str]) -> None:
        """Keep logs few and small beside the base; another writer may do so first."""
        state = self.state()
        own = state["tables"].get(table, {"base": None, "logs": []})
        rows, base = sum(n for _, _, n in own["logs"]), own["base"][1] if own["base"] else 0
        if own["base"] is None and len(own["logs"]) == 1 and rows > self.BROADCAST_ROWS:
            return self._adopt(table, schema, own["logs"][0])
        if len(own["logs"]) < 2 or (len(own["logs"]) < self.MOST_LOGS and rows <= self.BROADCAST_ROWS):
            return
        try:
            self._merge(table, schema, keys, state, "base" if rows > self.SHARE * base else "log")
        except ConcurrentWrite:
            pass  # the other writer's merge does as well

    def vacuum(self, table: str) -> None:
        """Remove folders that the current state does not name. Writers of the table must have ended."""
        own = self.state()["tables"].get(table, {"base": None, "logs": []})
        used = {*[x[0] for x in own["logs"]], *([own["base"][0]] if own["base"] else [])}
        for name in self._names(table):
            if name not in used:
                fs, p = self._fs(f"{self.root}/{table}/{name}")
                fs.delete(p, True)

    def _bytes(self, folder: str) -> int:
        fs, p = self._fs(f"{self.root}/{folder}")
        return int(fs.getContentSummary(p).getLength())

    def size(self) -> int:
        """Bytes of all files."""
        fs, p = self._fs(self.root)
        return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0

    def drop(self, table: str) -> None:
        self.publish({"dropped": [table]})

    def backup(self, path: str) -> None:
        fs, p = self._fs(self.root)
        util = self.spark._jvm.org.apache.hadoop.fs.FileUtil
        util.copy(fs, p, self._fs(path)[0], self._fs(path)[1], False, True, self.spark._jsc.hadoopConfiguration())

    def restore(self, path: str) -> None:
        fs, p = self._fs(self.root)
        fs.delete(p, True)
        self._read.clear()
        Store(self.spark, path).backup(self.root)


def manifest(files: dict[str, dict], options: dict, run_id: str | None = None, exported_at: str = "") -> str:
    return json.dumps({"schema_version": 1, "generator": "tesserine", "run_id": run_id or str(uuid.uuid4()), "exported_at": exported_at, "files": files, "options": options}, indent=2, sort_keys=True)
