"""Components of documents linked by the Jaccard similarity of their word shingles.

A size-aware join. Shingles are ordered from rare to frequent by their document
frequency over the whole corpus. Two sets that reach the threshold share a shingle
in the first ``n - ceil(t n) + 1`` of each, and two shingles in one more. Small
sets enumerate their subsets of two shingles of that prefix as keys; large sets
scan the inverted lists of single ones. The boundary is the size at which the
cost of both is least: subsets to enumerate on one side; on the other entries in
lists, and shingles whose lists are scanned.

Sets that share a key are joined by stars, not by pairs, into candidate groups. A
group is then decided exactly from its inverted lists: overlaps of one set with
all others are counted in one scan, and only sets outside of the largest known
component are scanned further, for a link inside a component changes nothing.
Groups of any size are dealt out in bounded parts.

Documents with equal sets are one class from the start; only classes are compared.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chunks, kernel
from .common import Scratch, stored
from .components import components

SHINGLE = 5
#: The threshold as a fraction of whole numbers: 100 * overlap >= 75 * union.
NUMERATOR, DENOMINATOR = 75, 100
#: Classes that one task compares. Larger groups are compared part by part.
GROUP = 1024
#: Parts that the sets of a large group are spread over while they meet its hub.
SALTS = 64


def needed(n: int, num: int = NUMERATOR, den: int = DENOMINATOR) -> int:
    """Least overlap of a set of ``n`` with any set that it links to."""
    return -(-num * n // den)


class _Sets:
    """Shingle sets of a chunk's texts: hashes, and ``first[i]:first[i + 1]`` those of text ``i``, ascending."""

    def __init__(self, texts: list[bytes | None], k: int) -> None:
        t = kernel.Texts(texts, lower=True)
        words = t.hashes()
        windows = kernel.window_hashes(words, k)
        parts, size = [], []
        for a, b in zip(t.first[:-1].tolist(), t.first[1:].tolist(), strict=True):
            if b - a >= k:
                own = np.unique(windows[a : b - k + 1])
            elif b > a:  # fewer words: the whole sequence is the one shingle
                own = kernel.mix(kernel.window_hashes(words[a:b], b - a) + np.uint64(b - a))
            else:
                own = words[:0]
            parts.append(own)
            size.append(len(own))
        self.hashes = np.concatenate(parts) if parts else words
        self.first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def _class_of_frequency(total: np.ndarray) -> np.ndarray:
    """0 for a shingle of one document, then four steps for each doubling."""
    return np.where(total < 2, 0, np.minimum(255, 1 + np.floor(4 * np.log2(np.maximum(total, 2)))))


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


_SHINGLED = "_key long, cls binary, n long, prefix array<long>, n_first int, cost long, shared array<long>"


def _shingled(dealt: chunks.Chunks, k: int, num: int, den: int) -> DataFrame:
    """For each document its class, size, the shared shingles of its prefix and, if there are such, all its shared shingles."""
    bits = dealt.bits
    df = chunks.answered(chunks.ask(dealt, lambda texts: chunks.narrow(_Sets(texts, k).hashes, bits)), _class_of_frequency, 1, 1, dealt)

    def prefixes(rows: pa.Table, codes: pa.Table) -> pa.Table:
        sets = _Sets(kernel.binaries(rows.column("_text")), k)
        n_rows = len(sets.first) - 1
        code = chunks.codes_of(codes, 1)[chunks.narrow(sets.hashes, bits).where] if len(sets.hashes) else np.empty(0, np.uint8)
        cls, size, prefix, n_first, cost, shared = [], [], [], [], [], []
        for i in range(n_rows):
            h, c = sets.hashes[sets.first[i] : sets.first[i + 1]], code[sets.first[i] : sets.first[i + 1]]
            n = len(h)
            size.append(n)
            cls.append(blake2b(h.tobytes(), digest_size=16).digest() if n else None)
            alone = n - int(np.count_nonzero(c))
            p = n - needed(n, num, den) + 1
            if alone >= p + 1 or not n:
                prefix.append(None), n_first.append(0), cost.append(0), shared.append(None)
                continue
            order = np.lexsort((h, c))[alone : p + 1]
            prefix.append(h[order].view(np.int64))
            n_first.append(max(0, p - alone))
            # a row for each list that it stands in, and the shingles that a scan counts
            cost.append(max(0, p - alone) + int(np.count_nonzero(c)))
            shared.append(h[c > 0].view(np.int64))
        lists = pa.list_(pa.int64())
        return pa.table(
            [rows.column("_row").combine_chunks().field(0) if isinstance(rows.column("_row"), pa.ChunkedArray) else rows.column("_row").field(0), pa.array(cls, pa.binary()), pa.array(size, pa.int64()), pa.array(prefix, lists), pa.array(n_first, pa.int32()), pa.array(cost, pa.int64()), pa.array(shared, lists)],
            ["_key", "cls", "n", "prefix", "n_first", "cost", "shared"],
        )

    return chunks.again(dealt, df, prefixes, _SHINGLED)


def boundary(classes: DataFrame) -> int:
    """The set size up to which subsets are cheaper than scans, from cost sums for each power of two of sizes."""
    m = F.size("prefix")
    rows = classes.groupBy(F.floor(F.log2("n")).alias("octave")).agg(F.sum(m * (m - 1) / 2).alias("subsets"), F.sum("cost").alias("scans")).orderBy("octave").collect()
    best, size = None, 0
    for k in range(-1, len(rows)):
        total = sum(r.subsets for r in rows[: k + 1]) + sum(r.scans for r in rows[k + 1 :])
        if best is None or total < best:
            best, size = total, (1 << (int(rows[k].octave) + 1)) - 1 if k >= 0 else 0
    return size


def _candidates(scratch: Scratch, classes: DataFrame, small: int, num: int, den: int) -> DataFrame:
    """Star edges between classes that share a key."""
    # a large set can link to a small one of at least its share of the boundary
    lists = classes.where((F.col("n") * den >= small * num) | (F.col("n") == 1)).select("cls", F.explode(F.slice("prefix", 1, F.greatest("n_first", F.lit(0)))).alias("a")).select("cls", "a", F.lit(None).cast("long").alias("b"))
    few = classes.where((F.col("n") <= small) & (F.col("n") > 1))
    pairs = few.select("cls", "prefix", F.posexplode("prefix").alias("i", "a")).select("cls", "a", F.explode(F.slice("prefix", F.col("i") + 2, F.size("prefix"))).alias("b"))
    pairs = pairs.select("cls", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    keys = lists.unionByName(pairs).select("cls", F.xxhash64("a", F.coalesce("b", F.lit(0))).alias("key"))
    # written first: a very common key is one skewed partition of a join of scans, which Spark splits, while it can't where
    # the aggregate feeds the join. Few hubs are sent to all executors instead.
    hubs = scratch.stored(keys.groupBy("key").agg(F.min("cls").alias("hub"), F.max("cls").alias("last")).where(F.col("hub") != F.col("last")).select("key", "hub"), "hubs")
    return keys.join(hubs, "key").where(F.col("cls") != F.col("hub")).select(F.col("cls").alias("a"), F.col("hub").alias("b")).distinct()


class _Union:
    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def roots(self) -> np.ndarray:
        while True:
            then = self.up[self.up]
            if (then == self.up).all():
                return then
            self.up = then


def linked(n: np.ndarray, sets: list[np.ndarray], asked: np.ndarray, num: int, den: int) -> np.ndarray:
    """Component (as the lowest member number) of each set, by links between ``asked`` sets and all sets.

    One scan of the inverted lists of a set's shingles counts its overlap with every other set.
    """
    size = np.array([len(s) for s in sets])
    union = _Union(len(sets))
    if not size.sum():
        return union.roots()
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.concatenate([[0], np.cumsum(size)])
    order = np.argsort(token, kind="stable")
    holder = np.repeat(np.arange(len(sets)), size)[order]
    begin = np.concatenate([[0], np.cumsum(np.bincount(token))])
    todo = set(np.flatnonzero(asked).tolist())
    while todo:
        roots = union.roots()
        labels, members = np.unique(roots, return_counts=True)
        largest = labels[np.argmax(members)]
        # links inside of the largest component add nothing, and others are found from their other end
        outside = [i for i in todo if roots[i] != largest] if members.max() > 1 else list(todo)
        if not outside:
            if asked.all():
                break
            outside = list(todo) if len(labels) > 1 else []
            if not outside:
                break
        i = min(outside)
        todo.discard(i)
        own = token[first[i] : first[i + 1]]
        lo, count = begin[own], begin[own + 1] - begin[own]
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)])[:-1], count) + np.arange(count.sum())
        overlap = np.bincount(holder[at], minlength=len(sets))
        a = union.root(i)
        for j in np.flatnonzero(den * overlap >= num * (n[i] + n - overlap)).tolist():
            b = union.root(j)
            if b != a:
                union.up[max(a, b)] = min(a, b)
                a = min(a, b)
    return union.roots()


_EDGES = "a binary, b binary"


def _decided(groups: DataFrame, num: int, den: int, *by: str) -> DataFrame:
    """Edges from each class of a group (rows ``cls``, ``n``, ``shared``, ``asked``) to the lowest class it is linked to."""

    def decide(group: pa.Table) -> pa.Table:
        group = group.sort_by("cls")
        cls = group.column("cls").to_pylist()
        lists = group.column("shared").combine_chunks()
        flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        sets = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        root = linked(group.column("n").to_numpy(), sets, group.column("asked").to_numpy(zero_copy_only=False), num, den)
        return pa.table([pa.array(cls, pa.binary()), pa.array([cls[r] for r in root], pa.binary())], ["a", "b"])

    return groups.groupBy(*by).applyInArrow(decide, _EDGES)


def _verified(scratch: Scratch, classes: DataFrame, candidates: DataFrame, num: int, den: int) -> DataFrame:
    """``node`` and ``label`` of the classes that have a true link."""
    group = components(candidates).withColumnRenamed("node", "cls").withColumnRenamed("label", "group")
    # sizes and hubs are written before they meet the rows of their group, of which one may have a great share
    sizes = scratch.stored(group.groupBy("group").agg(F.count(F.lit(1)).alias("members")), "sizes")
    sets = scratch.stored(classes.select("cls", "n", "shared").join(group.join(sizes, "group"), "cls").withColumn("asked", F.lit(True)), "sets")
    small = _decided(sets.where(F.col("members") <= GROUP), num, den, "group").select(F.col("a").alias("node"), F.col("b").alias("label"))
    large = sets.where(F.col("members") > GROUP)
    if large.isEmpty():
        return small

    # every set of a large group meets the group's hub first
    hubs = large.groupBy("group").agg(F.min("cls").alias("cls")).join(large.select("cls", F.col("n").alias("hub_n"), F.col("shared").alias("hub_shared")), "cls").withColumnRenamed("cls", "hub")
    hubs = scratch.stored(hubs, "hubs").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = large.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int"))
    overlap = F.size(F.array_intersect("shared", "hub_shared"))
    met = salted.join(hubs, ["group", "salt"]).select("group", "cls", "hub", "n", "shared", "members", (den * overlap >= num * (F.col("n") + F.col("hub_n") - overlap)).alias("linked"))
    met = scratch.stored(met, "met")
    star = met.where("linked").select(F.col("cls").alias("a"), F.col("hub").alias("b"))

    # what the hub leaves open is compared with the whole group, part by part
    rest = met.where(~F.col("linked"))
    left = scratch.stored(rest.groupBy("group").agg(F.count(F.lit(1)).alias("open")), "open")
    part = lambda n: F.pmod(F.xxhash64("cls"), F.ceil(F.col(n) / GROUP)).cast("int")
    parts = lambda n: F.sequence(F.lit(0), (F.ceil(F.col(n) / GROUP) - 1).cast("int"))
    asked = rest.join(left, "group").select("group", "cls", "n", "shared", part("open").alias("x"), F.explode(parts("members")).alias("y"), F.lit(True).alias("asked"))
    # an open set of the same task stands there once
    other = met.join(left, "group").withColumn("own", F.when(~F.col("linked"), part("open"))).select("group", "cls", "n", "shared", "own", F.explode(parts("open")).alias("x"), part("members").alias("y"))
    other = other.where(F.col("own").isNull() | (F.col("own") != F.col("x"))).select("group", "cls", "n", "shared", "x", "y", F.lit(False).alias("asked"))
    grid = _decided(asked.unionByName(other), num, den, "group", "x", "y").where(F.col("a") != F.col("b"))
    return small.unionByName(components(star.unionByName(grid)))


#: Bytes of a node: a mark of null, the class's smallest key, its digest.
_MARK, _KEY = 1, 8


def _node(low: Column, cls: Column) -> Column:
    """A class as bytes that sort by its smallest key, a null key last, and then by its digest.

    The smallest node of a component so tells the component's id, and no join by component is needed to find it.
    """
    plain = F.unhex(F.lpad(F.hex(F.coalesce(low, F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), 16, "0"))
    return F.concat(F.when(low.isNull(), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))), plain, cls)


def _key_of(node: Column) -> Column:
    """The smallest key of a node."""
    key = F.conv(F.hex(F.substring(node, 1 + _MARK, _KEY)), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    return F.when(F.hex(F.substring(node, 1, _MARK)) == "00", key)


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id`` (smallest key reachable by links) of each document.

    Keys are whole numbers. Null and empty texts, and texts without a word, have an empty set and link with nothing:
    their component is their own key. Documents of equal sets always link. Repeated rows are documents of one
    component. A null key counts as none; a component of null keys alone has a null id. Ties have no effect.
    """
    packed = docs.select(F.struct(F.col(key).cast("long").alias("_key")).alias("_row"), F.col(text).cast("string").alias("_text"))
    dealt = chunks.deal(packed, F.col("_row._key"))
    sets = stored(_shingled(dealt, k, num, den), "shingled")
    classes = sets.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("_key").alias("low"))
    # the rows of a class are alike but for the key
    chosen = sets.where(F.size("prefix") > 0).join(classes, (sets.cls == classes.cls) & (sets._key.eqNullSafe(classes.low)), "left_semi").dropDuplicates(["cls"])
    scratch = Scratch()
    chosen = scratch.stored(chosen.select(_node(F.col("_key"), F.col("cls")).alias("cls"), "n", "prefix", "n_first", "cost", "shared"), "classes")
    labels = _verified(scratch, chosen, _candidates(scratch, chosen, boundary(chosen), num, den), num, den)
    digest = F.substring("node", 1 + _MARK + _KEY, 16)
    labels = labels.select(digest.alias("cls"), F.struct(_key_of(F.col("label")).alias("id")).alias("found"))
    # written, so that the join with the rows of a class that has a great share of them is one that Spark can split
    by_class = stored(classes.join(labels, "cls", "left").select("cls", F.when(F.col("found").isNotNull(), F.col("found.id")).otherwise(F.col("low")).alias("component_id")), "labels")
    scratch.drop()
    rows = sets.select(F.col("_key").alias(key), "cls", F.col("n").alias("n_shingles"))
    linked_ = rows.where(F.col("cls").isNotNull()).join(by_class, "cls").select(key, "n_shingles", "component_id")
    return linked_.unionByName(rows.where(F.col("cls").isNull()).select(key, "n_shingles", F.col(key).alias("component_id")))
