"""Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups, and a proof for each row.

Ranks come from histograms of the digits of the key, not from a sort of the table. A group's rows are counted by the
first bits of their keys; sums over smaller digits, level by level, give the rank at which each bucket begins, and rows
are put in order inside buckets of some thousand rows. A bucket that holds more is counted again by further bits, and
one value that holds more by the bits of the leaf, so that neither clustered nor repeated keys fill a task.

The rank in base ``fanout`` is the path of a leaf from the root. Rows whose paths share all but the last ``levels``
digits form a block, are hashed together up to one node, and those nodes again, until one is left. Proofs go the other
way: a block gets the siblings above it once and hands them on, so a proof is never stored for a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

FANOUT = 2
#: Nodes that are hashed in one block at most.
BLOCK = 1024
#: Rows that a bucket of keys holds on average, and at most before it is counted by more bits.
BUCKET, HEAVY = 2048, 8192
#: Bits of a digit of the histograms, and by how many bits a heavy bucket is divided at least.
DIGIT, FINER = 12, 8
#: Heavy buckets up to which they are sent to every executor (64 bytes each).
BROADCAST_HEAVY = 100_000

_TOP = 1 << 63
_ABOVE = "array<struct<left:string,right:string>>"
_GROUP = ["_null", "_group"]


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*fields: Column) -> Column:
    """Digest of a row: each field as ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    spelt = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in spelt]), 256)


def depth_of(n: int, fanout: int) -> int:
    """Levels above ``n`` leaves."""
    depth, room = 0, 1
    while room < n:
        depth, room = depth + 1, room * fanout
    return depth


def _first_bits(key: Column, bits: int, low: int) -> Column:
    """The first bits of a signed 64-bit key, ascending from 1 at ``low``; 0 for null."""
    if not bits:
        return F.lit(0).cast("long")
    return F.coalesce(F.shiftrightunsigned(key.bitwiseXOR(F.lit(-_TOP)), 64 - bits) - F.lit(((low + _TOP) >> (64 - bits)) - 1), F.lit(0).cast("long"))


def _starts(counts: DataFrame, by: list[str], most: int) -> DataFrame:
    """``counts`` (``by``, ``_node`` up to ``most``, ``_count``) and ``_start``, the rows of the group in smaller nodes.

    Sums run over the digits of one parent only; the parents' own starts come from the level above.
    """
    up = counts.withColumn("_up", F.shiftright("_node", DIGIT))
    before = F.coalesce(F.sum("_count").over(Window.partitionBy(*by, "_up").orderBy("_node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if most >> DIGIT == 0:
        return up.withColumn("_start", before).drop("_up")
    parents = up.groupBy(*by, F.col("_up").alias("_node")).agg(F.sum("_count").alias("_count"))
    above = _starts(parents, by, most >> DIGIT).select(*by, F.col("_node").alias("_up"), F.col("_start").alias("_base"))
    return up.withColumn("_start", before).join(above, [*by, "_up"]).withColumn("_start", F.col("_start") + F.col("_base")).drop("_up", "_base")


def ranked(rows: DataFrame, by: list[str], keys: list[Column], order: list[Column], least: int = 0) -> DataFrame:
    """``rows`` with ``_rank`` from 0 in the order ``order`` within ``by``, and ``_n``, the rows of the group.

    ``keys`` are 64-bit numbers that ascend as ``order`` does, later ones where earlier ones tie; the last should tell
    all rows apart. ``rows`` must be a table that reads alike each time. Groups must not be null.
    """
    key = keys[0]
    n, low, high = rows.agg(F.count(F.lit(1)), F.min(key), F.max(key)).first()
    if not by and n <= BUCKET:
        return rows.withColumn("_n", F.lit(n).cast("long")).withColumn("_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long") - 1)
    low, high = low or 0, high or 0
    bits = least
    while bits < 63 and ((high + _TOP) >> (64 - bits) if bits else 0) - ((low + _TOP) >> (64 - bits) if bits else 0) + 1 < n / BUCKET:
        bits += 1
    most = (((high + _TOP) >> (64 - bits)) - ((low + _TOP) >> (64 - bits)) + 1) if bits else 0
    rows = rows.withColumn("_node", _first_bits(key, bits, low))
    counts = stored(rows.groupBy(*by, "_node").agg(F.count(F.lit(1)).alias("_count")), "digits")
    starts = _starts(counts, by, most)
    if "_n" not in rows.columns:
        whole = counts.groupBy(*by).agg(F.sum("_count").alias("_n")) if by else counts.agg(F.sum("_count").alias("_n"))
        starts = starts.join(whole, by) if by else starts.withColumn("_n", F.lit(n).cast("long"))
    starts = stored(starts, "starts")
    added = ["_start", *(["_n"] if "_n" in starts.columns else [])]
    heavy = starts.where(F.col("_count") > HEAVY)
    many = heavy.count()
    parts = []
    if many:
        few = heavy.select(*by, "_node", *added)
        rows = stored(rows.join(F.broadcast(few) if many <= BROADCAST_HEAVY else few, [*by, "_node"], "left"), "heavy")
        below = rows.where(F.col("_start").isNotNull()).withColumnsRenamed({"_start": f"_start{len(by)}", "_node": f"_node{len(by)}"})
        then = (keys, min(63, bits + FINER)) if bits < 63 else (keys[1:], 0)
        deep = ranked(below, [*by, f"_node{len(by)}"], then[0], order, then[1])
        parts.append(deep.withColumn("_rank", F.col("_rank") + F.col(f"_start{len(by)}")).drop(f"_start{len(by)}", f"_node{len(by)}"))
        rows = rows.where(F.col("_start").isNull()).drop(*added)
    placed = rows.join(starts.where(F.col("_count") <= HEAVY).select(*by, "_node", *added), [*by, "_node"])
    inside = F.row_number().over(Window.partitionBy(*by, "_node").orderBy(*order))
    light = placed.withColumn("_rank", F.col("_start") + inside - 1).drop("_start", "_node")
    return reduce(lambda a, b: a.unionByName(b), parts, light)


def _levels(nodes: list[str], levels: int, fanout: int) -> list[list[str]]:
    out = [nodes]
    for _ in range(levels):
        out.append([digest(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def _siblings(levels: list[list[str]], at: int, fanout: int) -> list[tuple[str, str]]:
    """What stands left and right of a node in its run, level by level, below the top one."""
    out = []
    for nodes in levels[:-1]:
        first = at - at % fanout
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + fanout])))
        at //= fanout
    return out


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = digest(left, leaf, right)
    return leaf


def _hexes(packed: bytes) -> list[str]:
    text = packed.hex()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


@dataclass(frozen=True)
class _Shape:
    fanout: int
    block: int = BLOCK

    @property
    def per(self) -> int:
        """Levels of a block."""
        return max(1, depth_of(self.block + 1, self.fanout) - 1)

    @property
    def width(self) -> int:
        return self.fanout**self.per

    def of(self, n: int, tier: int) -> int:
        """Levels that blocks of a tier have in a tree of ``n`` leaves."""
        return max(0, min(self.per, depth_of(n, self.fanout) - tier * self.per))


@dataclass(frozen=True)
class Tree:
    """Blocks of each tier, from the leaves up: ``by``, ``_n``, ``_at``, ``hash`` of the top node, ``hashes`` of the lowest ones."""

    tiers: list[DataFrame]
    by: list[str]
    shape: _Shape

    def roots(self) -> DataFrame:
        return self.tiers[-1].select(*self.by, "hash")


def _blocks(nodes: DataFrame, by: list[str], tier: int, shape: _Shape) -> DataFrame:
    """Blocks over ``nodes`` (``by``, ``_n``, ``_at``, ``hash``, and for leaves ``key`` and ``claim``)."""
    leaves = "claim" in nodes.columns

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_at")
        packed = b"".join(rows.column("hash").to_pylist())
        top = _levels(_hexes(packed), shape.of(rows.column("_n")[0].as_py(), tier), shape.fanout)[-1]
        cols = {b: rows.column(b).slice(0, 1) for b in by} | {"_n": rows.column("_n").slice(0, 1), "_at": pa.array([rows.column("_at")[0].as_py() // shape.width], pa.int64()), "hash": pa.array([bytes.fromhex(top[0])], pa.binary()), "hashes": pa.array([packed], pa.binary())}
        if leaves:
            cols |= {"keys": pa.array([rows.column("key").to_pylist()], pa.list_(pa.int64())), "claims": pa.array([rows.column("claim").to_pylist()], pa.list_(pa.binary()))}
        return pa.table(cols)

    kinds = dict(nodes.dtypes)
    schema = ", ".join([*[f"{b} {kinds[b]}" for b in by], "_n long, _at long, hash binary, hashes binary", *(["keys array<long>, claims array<binary>"] if leaves else [])])
    return nodes.groupBy(*by, F.floor(F.col("_at") / shape.width).alias("_block")).applyInArrow(run, schema)


def grown(nodes: DataFrame, by: list[str], shape: _Shape) -> Tree:
    """The trees over ranked nodes; each tier shrinks by some thousand."""
    tiers = [stored(_blocks(nodes, by, 0, shape), "trie")]
    most = tiers[0].agg(F.max("_n")).first()[0] or 0
    while most > shape.width ** len(tiers):
        tiers.append(stored(_blocks(tiers[-1].select(*by, "_n", "_at", "hash"), by, len(tiers), shape), "trie"))
    return Tree(tiers, by, shape)


def _handed_on(tree: Tree, tier: int, above: DataFrame) -> DataFrame:
    """``above`` the nodes below a tier's blocks: ``by``, ``_at``, ``above``, and what else ``above`` has for them."""
    shape, by = tree.shape, tree.by
    kept = [c for c in above.columns if c not in ("_at", "above")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                n, at, packed, path = (batch.column(c)[r].as_py() for c in ("_n", "_at", "hashes", "above"))
                levels = _levels(_hexes(packed), shape.of(n, tier), shape.fanout)
                own = [[{"left": a, "right": b} for a, b in _siblings(levels, i, shape.fanout)] + path for i in range(len(levels[0]))]
                one = pa.table({c: batch.column(c).slice(r, 1) for c in kept}).take([0] * len(own))
                cols = [one.column(c).combine_chunks() for c in kept]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([at * shape.width + i for i in range(len(own))], pa.int64()), pa.array(own, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))], [*kept, "_at", "above"])

    kinds = dict(above.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in kept], f"_at long, above {_ABOVE}"])
    joined = tree.tiers[tier].select(*by, "_n", "_at", "hashes").join(above, [*by, "_at"])
    return joined.mapInArrow(run, schema)


def _lowest(tree: Tree, above: DataFrame) -> DataFrame:
    """Above the blocks of the lowest tier."""
    for tier in range(len(tree.tiers) - 1, 0, -1):
        above = stored(_handed_on(tree, tier, above), "paths")
    return above


_PROVED = "key long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, n_siblings int"


def _proved(tree: Tree, above: DataFrame) -> DataFrame:
    shape, by = tree.shape, tree.by

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                n, packed, keys, claims, path, subroot, root = (batch.column(c)[r].as_py() for c in ("_n", "hashes", "keys", "claims", "above", "subroot", "root"))
                levels = _levels(_hexes(packed), shape.of(n, 0), shape.fanout)
                path = [(x["left"], x["right"]) for x in path]
                rest, known = "".join(a + b for a, b in path), sum(len(a + b) for a, b in path) // 64
                proofs, roots, counts = [], [], []
                for i, leaf in enumerate(levels[0]):
                    own = _siblings(levels, i, shape.fanout)
                    proofs.append(digest(*[a + b for a, b in own], rest))
                    counts.append(known + sum(len(a) + len(b) for a, b in own) // 64)
                    claim = claims[i]
                    roots.append(fold(fold(leaf if claim is None else claim.hex(), own), path))
                size = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(levels[0]), pa.array([subroot] * size), pa.array([root] * size), pa.array(proofs), pa.array(roots), pa.array([x == root for x in roots]), pa.array(counts, pa.int32())],
                    ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "n_siblings"],
                )

    joined = tree.tiers[0].select(*by, "_n", "_at", "hashes", "keys", "claims").join(above, [*by, "_at"])
    return joined.mapInArrow(run, _PROVED)


def _pieces(text: str, size: Callable[[], int]) -> list[Column]:
    """A text's bytes as numbers of seven bytes each, which ascend as the texts do."""
    piece = lambda i: F.conv(F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), 7 * i + 1, 7)), 14, "0"), 16, 10).cast("long")
    return [piece(i) for i in range(max(1, -(-size() // 7)))]


def build(rows: DataFrame, key: str, group: str, fields: list[str], claim: Column | None = None, fanout: int = FANOUT, block: int = BLOCK) -> DataFrame:
    """Leaf, subroot, root and proof of each row, and what its claimed leaf proves.

    A leaf is the digest of ``fields``. Per ``group``, leaves ascend by ``key``; every ``fanout`` consecutive nodes (the last
    run: fewer, even one) become their digest, until one is left. The groups' roots, by group, likewise give the root.
    Returns ``key``, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (of the siblings' digests, level by level to the root,
    left to right), ``n_siblings``, ``folded_root`` (from the ``claim``, a leaf as :func:`leaf_of` gives it, or from the own
    leaf where that is null) and ``verified`` (``folded_root`` is the root).

    Keys are whole numbers; null keys come first, and rows that share a key ascend by leaf. A null group is a group, before
    all others. Rows that repeat are leaves of their own. An empty table gives an empty result. Only ``key``, ``group`` and
    ``fields`` are read, so further columns, of whatever name, change nothing.
    """
    leaf = leaf_of(*[F.col(f"`{f}`") for f in fields])
    named = F.col(f"`{group}`").cast("string")
    packed = rows.select(
        named.isNull().alias("_null"), F.coalesce(named, F.lit("")).alias("_group"), F.col(f"`{key}`").cast("long").alias("key"), F.unhex(leaf).alias("hash"),
        (F.unhex(claim) if claim is not None else F.lit(None).cast("binary")).alias("claim"), F.monotonically_increasing_id().alias("_number"),
    )
    packed = stored(packed, "leaves")
    bits = lambda at: F.conv(F.hex(F.substring("hash", at, 7)), 16, 10).cast("long")
    # the last bit of a key is not among the 63 that are counted
    keys = [F.col("key"), F.col("key").bitwiseAND(F.lit(1)) * 2, *[bits(at) for at in (1, 8, 15, 22)], bits(29), F.col("_number")]
    leaves = ranked(packed, _GROUP, keys, [F.col("key"), F.col("hash"), F.col("_number")]).select(*_GROUP, "_n", F.col("_rank").alias("_at"), "hash", "key", "claim")
    shape = _Shape(fanout, block)
    tree = grown(leaves, _GROUP, shape)
    tops = stored(tree.roots(), "subroots")
    longest = lambda: tops.agg(F.max(F.octet_length("_group"))).first()[0] or 0
    # the null group is told apart from the empty one by the order, not by these numbers
    order = [F.col("_null").desc(), F.col("_group")]
    groups = stored(ranked(tops, [], [F.when(F.col("_null"), None).otherwise(p) for p in _pieces("_group", longest)], order), "groups")
    over = grown(groups.select("_n", F.col("_rank").alias("_at"), "hash"), [], shape)
    top = over.roots().first()
    root = top[0].hex() if top else ""
    above = over.tiers[-1].select("_at", F.array().cast(_ABOVE).alias("above"))
    above = _handed_on(over, 0, _lowest(over, above))
    joined = groups.join(above.withColumnRenamed("_at", "_rank"), "_rank")
    above = joined.select(*_GROUP, F.lit(0).cast("long").alias("_at"), "above", F.lower(F.hex("hash")).alias("subroot"), F.lit(root).alias("root"))
    return _proved(tree, _lowest(tree, above))
