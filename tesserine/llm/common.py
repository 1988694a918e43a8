"""Reading tables, the shared working folder, and row plumbing for the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the byte kernels; bounds their temporaries.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver see.

    It is read from ``spark.checkpoint.dir``. Where that is unset the context's own checkpoint folder is used. With
    neither, a local master (tests, a laptop) gets a new folder; a cluster is an error, for no folder of the driver's
    machine is shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
        return base.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tesserine-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    """The folder of this application's tables."""
    return f"{shared_dir(spark)}/tesserine/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage with a table that survives the loss of executors, and keeps
    column pruning, which ``checkpoint()`` would not. Results read it lazily;
    :func:`clean` removes all tables of the application when they are done with.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(df: DataFrame) -> None:
    """Remove a table made by :func:`stored` when nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


class Scratch:
    """Tables that one operator stores on the way and drops when its last one is written."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []

    def stored(self, df: DataFrame, tag: str) -> DataFrame:
        self.made.append(stored(df, tag))
        return self.made[-1]

    def drop(self) -> None:
        while self.made:
            drop_stored(self.made.pop())


def clean(spark: SparkSession) -> None:
    """Remove every table that operators of this application stored. Results not yet written are lost with them."""
    _delete(spark, _own_dir(spark))


def carried(docs: DataFrame, taken: list[str]) -> tuple[DataFrame, list[str]]:
    """Pack the columns of ``docs`` that are not in ``taken`` into one struct ``_row``.

    Operators add columns under fixed names; an input column of the same name is
    replaced by the operator's. Packing keeps every other name from clashing with
    working columns.
    """
    low = {t.lower() for t in taken}
    rest = [c for c in docs.columns if c.lower() not in low]
    packed = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(1).alias("_none"))
    return docs.withColumn("_row", packed), rest


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
