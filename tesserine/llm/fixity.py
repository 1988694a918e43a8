"""Fixity audit of WARC replicas by Merkle trees over ordered offset ranges.

A record's digest is the SHA-256 of its bytes. The records that begin in one range
of ``RANGE`` bytes of an archive file, in the order of their offsets, are hashed
into a leaf; ``FANOUT`` neighbouring nodes are hashed into the node above, up to
one root for each file. Replicas compare roots first and then only the children of
nodes that differ, down to the records. Ranges are cut by offset, so a missing or
changed record disturbs its own branch and no other.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

RANGE = 1 << 16
FANOUT = 16


def warc_record(uri: Column, payload: Column) -> Column:
    """A WARC/1.0 resource record as text; a null payload is an empty one."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def digest_of(record: Column) -> Column:
    """SHA-256 of a record's bytes; a null record has that of no bytes."""
    return F.sha2(F.coalesce(record, F.lit("")), 256)


_HEAD = re.compile(rb"WARC/1\.[01]\r\n(?:[^\r\n]+\r\n)*?[Cc]ontent-[Ll]ength: *([0-9]+)\r\n(?:[^\r\n]+\r\n)*\r\n")
_MEMBER = b"\x1f\x8b\x08"
_AFTER = b"\r\n\r\n"


def _member_end(data: bytes, start: int) -> int | None:
    """Where the gzip member at ``start`` ends, if it is sound and holds a record; its content is thrown away in parts."""
    unpack, at, head = zlib.decompressobj(31), start, b""
    try:
        while not unpack.eof:
            part = data[at : at + (1 << 16)]
            if not part:
                return None
            at += len(part)
            while True:
                out = unpack.decompress(part, 1 << 20)
                head = head or out[:7]
                part = unpack.unconsumed_tail
                if not part:
                    break
    except zlib.error:
        return None
    return at - len(unpack.unused_data) if head.startswith(b"WARC/1.") else None


def _plain_end(data: bytes, start: int) -> int | None:
    head = _HEAD.match(data, start)
    end = head and head.end() + int(head[1]) + len(_AFTER)
    return end if end and data[end - len(_AFTER) : end] == _AFTER else None


def stretches(data: bytes) -> Iterator[tuple[int, int, bool]]:
    """``start``, ``end`` and soundness of the records of a WARC file, gzip members or plain.

    What can't be read as a record goes as one unsound stretch up to the next place that can, so damage stays where it is.
    """
    packed = data[:3] == _MEMBER
    end_of, mark, step = (_member_end, _MEMBER, 0) if packed else (_plain_end, _AFTER + b"WARC/1.", len(_AFTER))
    at = 0
    while at < len(data):
        end = end_of(data, at)
        if end:
            yield at, end, True
        else:
            next_ = data.find(mark, at + 1)
            while next_ >= 0 and end_of(data, next_ + step) is None:
                next_ = data.find(mark, next_ + 1)
            end = next_ + step if next_ >= 0 else len(data)
            yield at, end, False
        at = end


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files (gzip members or plain) below ``path``: ``archive`` (the file's name), ``offset``, ``size``,
    ``digest`` of the bytes as they stand in the file, and ``sound``. Two copies of a folder can be given to :func:`audit`.

    Spark hands a file to a task whole, so a file may have 2 GB at most and must fit a worker; archives are cut into
    files of about 1 GB by convention, and smaller ones are better here. An empty file has no records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_py()
                rows = [(a, b - a, hashlib.sha256(memoryview(data)[a:b]).hexdigest(), ok) for a, b, ok in stretches(data)]
                cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
                name = pa.array([batch.column(0)[i].as_py()] * len(rows), pa.string())
                yield pa.RecordBatch.from_arrays([name, *[pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)]], ["archive", "offset", "size", "digest", "sound"])

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    return files.mapInArrow(run, "archive string, offset long, size long, digest string, sound boolean")


def packed_files(records: DataFrame, archive: str = "archive", order: str = "order", record: str = "record", compress: bool = True) -> DataFrame:
    """``archive`` and ``content``: the bytes of one WARC file for each archive, its records in order, each a gzip member
    of its own if wanted. An archive's records must fit a worker; a null record is left out."""

    def pack(rows: pa.Table) -> pa.Table:
        made = [r.encode() if isinstance(r, str) else r for r in rows.sort_by("order").column("record").to_pylist() if r is not None]
        content = b"".join(gzip.compress(r, mtime=0) if compress else r for r in made)
        return pa.table([rows.column("archive").slice(0, 1), pa.array([content], pa.binary())], ["archive", "content"])

    rows = records.select(F.col(archive).cast("string").alias("archive"), F.col(order).alias("order"), F.col(record).alias("record"))
    return rows.groupBy("archive").applyInArrow(pack, "archive string, content binary")


def leaves(records: DataFrame, archive: str = "archive", offset: str = "offset", record: str = "record") -> DataFrame:
    """``archive``, ``offset`` and ``digest`` of each record; a null offset is 0. Rows may bring their ``digest`` in
    place of the record, so that records need not be moved to learn their offsets.

    Rows that repeat a record at an offset are one record. Different records at one offset are all kept.
    """
    digest = F.col("digest") if "digest" in records.columns else digest_of(F.col(record))
    return records.select(F.col(archive).cast("string").alias("archive"), F.coalesce(F.col(offset).cast("long"), F.lit(0)).alias("offset"), digest.alias("digest")).distinct()


def _hashed(nodes: DataFrame, width: int) -> DataFrame:
    """Nodes above ``nodes`` (``archive``, ``at``, ``hash``), each over ``width`` neighbouring places."""
    up = nodes.withColumn("up", F.floor(F.col("at") / width)).groupBy("archive", "up").agg(F.array_sort(F.collect_list(F.struct("at", "hash"))).alias("children"))
    text = F.concat_ws("|", F.transform("children", lambda c: F.concat(c["at"].cast("string"), F.lit(":"), c["hash"])))
    return up.select("archive", F.col("up").alias("at"), F.sha2(text, 256).alias("hash"))


def tree(records: DataFrame, depth: int) -> list[DataFrame]:
    """Levels from the records (``at`` is the offset) to the roots, ``depth`` levels above the leaves."""
    levels = [records.select("archive", F.col("offset").alias("at"), F.col("digest").alias("hash"))]
    levels.append(stored(_hashed(levels[0], RANGE), "merkle"))
    for _ in range(depth):
        levels.append(stored(_hashed(levels[-1], FANOUT), "merkle"))
    return levels


def depth_for(*replicas: DataFrame) -> int:
    """Levels above the leaves that bring every file to one root."""
    top = 0
    for r in replicas:
        top = max(top, r.agg(F.max("offset")).first()[0] or 0)
    at, depth = top // RANGE, 0
    while at:
        at, depth = at // FANOUT, depth + 1
    return depth


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """``archive`` and ``at`` of the nodes that the sides don't hold alike."""
    x, y = a.select("archive", "at", F.col("hash").alias("x")), b.select("archive", "at", F.col("hash").alias("y"))
    return x.join(y, ["archive", "at"], "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("archive", "at")


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Records on which two replicas (``archive``, ``offset``, and ``record`` or ``digest``) differ: ``archive``, ``offset``,
    ``first_digest``, ``second_digest`` and ``damage``: ``changed``, ``missing`` (from the second) or ``extra``.

    Where one offset holds several different records on a side, the sorted digests are joined by a comma. Replicas
    alike, and empty ones, give no rows. A null archive name is a file of that name.
    """
    named = lambda r: stored(leaves(r).withColumn("archive", F.coalesce("archive", F.lit(""))).groupBy("archive", "offset").agg(F.array_join(F.array_sort(F.collect_set("digest")), ",").alias("digest")), "leaves")
    a, b = named(first), named(second)
    depth = depth_for(a, b)
    left, right = tree(a, depth), tree(b, depth)
    bad = _differing(left[-1], right[-1])
    for level in range(depth, -1, -1):  # children of differing nodes only
        width = FANOUT if level else RANGE
        below = [side[level].withColumn("up", F.floor(F.col("at") / width)).join(bad.select("archive", F.col("at").alias("up")), ["archive", "up"], "left_semi") for side in (left, right)]
        if level:
            bad = stored(_differing(*below), "bad")
    x = below[0].select("archive", "at", F.col("hash").alias("first_digest"))
    y = below[1].select("archive", "at", F.col("hash").alias("second_digest"))
    both = x.join(y, ["archive", "at"], "full_outer").where(~F.col("first_digest").eqNullSafe(F.col("second_digest")))
    damage = F.when(F.col("second_digest").isNull(), "missing").when(F.col("first_digest").isNull(), "extra").otherwise("changed")
    return both.select("archive", F.col("at").alias("offset"), "first_digest", "second_digest", damage.alias("damage"))
