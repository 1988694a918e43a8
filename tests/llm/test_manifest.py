"""Manifests against a tree built in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tesserine.llm import manifest, queries
from tests.compare import same

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS])


def tree(nodes, fanout):
    """The top, and for each node the siblings left and right of it, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            first = p - p % fanout
            paths[i].append(("".join(nodes[first:p]), "".join(nodes[p + 1 : first + fanout])))
        nodes, at = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)], [p // fanout for p in at]
    return nodes[0], paths


def brute(rows, fanout=2):
    groups, out = {}, []
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own = {}
    for g in names:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        own[g] = tree([leaf(r) for r in groups[g]], fanout)
    root, above = tree([own[g][0] for g in names], fanout)
    for k, g in enumerate(names):
        for r, path in zip(groups[g], own[g][1], strict=True):
            path = path + above[k]
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            now = leaf({**r, "n_chars": None if r["n_chars"] is None else r["n_chars"] + 1} if tampered else r)
            for a, b in path:
                now = h(a, now, b)
            out.append((r["doc_id"], leaf(r), own[g][0], root, h(*[a + b for a, b in path]), now, now == root))
    return sorted(map(repr, out))


def built(docs, **how):
    tampered = manifest.leaf_of(*[F.col("n_chars") + 1 if f == "n_chars" else F.col(f) for f in FIELDS])
    made = manifest.build(docs, "doc_id", "lang", FIELDS, F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, tampered), **how)
    return sorted(repr(tuple(r)) for r in made.select("key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def table(spark, rows):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)


def made_up(n, ids, seed=1):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", "a", "é b", "x" * 300])
    return [{"doc_id": rng.choice(ids), "text": text(), "lang": rng.choice([None, "", "de", "de", "de", "ü"]), "source": rng.choice([None, "s"]), "n_chars": rng.choice([None, 1, 2])} for _ in range(n)]


@pytest.mark.parametrize("fanout", [2, 3])
def test_nulls_ties_and_repeated_rows(spark, fanout):
    rows = made_up(60, [None, 0, 1, 1, -5, 2**62, -(2**63), 2**63 - 1, *range(20)])
    assert built(table(spark, rows), fanout=fanout, block=4) == brute(rows, fanout)


@pytest.mark.parametrize("ids", [[7], [None, 3], [1, 2, 2**40, 2**40 + 1, 2**61], list(range(500))])
def test_heavy_buckets_are_counted_by_more_bits(spark, ids, monkeypatch):
    """One number, null numbers, clusters that lie far apart, and rows that repeat, in buckets of a few rows."""
    monkeypatch.setattr(manifest, "BUCKET", 8)
    monkeypatch.setattr(manifest, "HEAVY", 32)
    monkeypatch.setattr(manifest, "DIGIT", 2)
    rows = made_up(150, ids, 2)
    rows += rows[:40] * 2
    assert built(table(spark, rows)) == brute(rows)


def test_many_groups(spark, monkeypatch):
    monkeypatch.setattr(manifest, "BUCKET", 4)
    monkeypatch.setattr(manifest, "HEAVY", 8)
    rows = made_up(120, list(range(50)), 3)
    for i, r in enumerate(rows):
        r["lang"] = f"a rather long common name {i % 37}" if i % 3 else r["lang"]
    assert built(table(spark, rows), block=4) == brute(rows)


def test_empty_single_and_clashing_names(spark):
    assert built(table(spark, [])) == []
    rows = made_up(1, [5])
    clashing = table(spark, rows).withColumns({c: F.lit(9) for c in ("key", "hash", "_n", "_rank", "leaf", "root", "_group")})
    assert built(clashing) == brute(rows)


def test_against_sql(spark, sf):
    same(spark, sf, queries.QUERIES["op12_merkle_manifest"], queries.ORACLE_SQL["op12_merkle_manifest"])
