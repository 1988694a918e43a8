"""Induced suffix sorting, and removal of repeated byte strings, against counts of all strings."""

import random
from collections import Counter

import numpy as np
import pytest

from tesserine.llm import induced, queries, repeats
from tests.compare import same


def stretches(rng):
    for _ in range(rng.randint(1, 5)):
        letters = b"abcd"[: rng.choice([1, 2, 3, 4])]
        s = bytes(rng.choice(letters) for _ in range(rng.randint(1, 60)))
        yield s + s[: rng.randint(1, 20)] * rng.randint(0, 3)


def test_suffix_order_and_common_prefixes():
    rng = random.Random(1)
    for _ in range(150):
        parts = list(stretches(rng))
        text = np.frombuffer(b"\0" + b"".join(p + b"\0" for p in parts), np.uint8)
        whole, before, seen = text.tobytes(), None, []
        for at, common in induced.sorted_suffixes(text, 30, rng.choice([1, 1 << 20])):
            for p, n in zip(at.tolist(), common.tolist(), strict=True):
                suffix = whole[p : whole.index(0, p)]
                if before is not None:
                    k = next((k for k in range(min(len(suffix), len(before))) if suffix[k] != before[k]), min(len(suffix), len(before)))
                    assert min(k, 30) == n and suffix[:30] <= before[:30]
                before = suffix
                seen.append(p)
        assert sorted(seen) == [i for i, b in enumerate(whole) if b]


def test_repeated_places():
    rng = random.Random(2)
    for _ in range(150):
        parts, n = [*stretches(rng), b""], rng.choice([1, 2, 3, 5, 8, 12])
        count = Counter(p[i : i + n] for p in parts for i in range(len(p) - n + 1))
        expected = [[i for i in range(len(p) - n + 1) if count[p[i : i + n]] > 1] for p in parts]
        assert [x.tolist() for x in induced.repeated(parts, n, rng.choice([1, 1 << 20]))] == expected


def brute(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = [False] * (len(t) + 1)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(t)))
        yield len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone, strict=False) if not g)


@pytest.mark.parametrize("few", [1, 1000])
def test_documents(spark, few):
    """Shared passages, near copies, repeats inside a text, null and empty texts, ties and repeated rows."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    passage = "".join(word() for _ in range(30))
    rows = []
    for i in range(60):
        own = "".join(word() for _ in range(rng.randint(0, 60)))
        kind = i % 6
        text = [own, own + passage + own[:50], passage[: rng.randint(30, 150)] + own, own + own, "ab" * rng.randint(1, 60), passage[: 40 + i] + "x" + passage[40 + i :]][kind]
        rows.append((i // 2 if i % 7 else None, text, 1))
    rows += [(1, None, 1), (2, "", 1), (3, "é" * 100, 1), *rows[:5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")
    length = 40
    got = repeats.deduplicate(docs, length=length, few=few).select("doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept", "removed").collect()
    texts = [(r[1] or "").encode() for r in rows]
    expected = [(r[0], r[1], *b) for r, b in zip(rows, brute(texts, length), strict=True)]
    assert sorted(repr((*r[:5], bytes(r.kept))) for r in got) == sorted(map(repr, expected))
    assert all(len(r.removed) == r.n_spans and sum(x.n for x in r.removed) == r.n_removed for r in got)


def test_empty_table(spark):
    assert repeats.deduplicate(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_against_sql(spark, sf):
    same(spark, sf, queries.QUERIES["op11_suffix_array_dedup"], queries.ORACLE_SQL["op11_suffix_array_dedup"])
