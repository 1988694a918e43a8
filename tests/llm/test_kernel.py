import random
import re

import numpy as np
import pyarrow as pa

from tesserine.llm import kernel, rans
from tesserine.llm.packing import CapacityTree, best_fit_decreasing

BLANK = re.compile(rb"[^\x20\x09-\x0D]+")


def texts(seed, n=40):
    r = random.Random(seed)
    alphabet = "ab Z\n\t\r\x0b\x0cé日 .,_9\x1c\x85"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))).encode() for _ in range(n)] + [b"", None]


def test_words_agree_with_the_contract():
    own = texts(1)
    t = kernel.Texts(own)
    for i, raw in enumerate(own):
        words = BLANK.findall(raw or b"")
        assert [t.data[a:b] for a, b in zip(t.starts[t.first[i] : t.first[i + 1]], t.ends[t.first[i] : t.first[i + 1]], strict=True)] == words
        assert words == (raw or b"").split()


def test_hashes_tell_words_and_windows_apart():
    t = kernel.Texts(texts(2, 300))
    words = [t.data[a:b] for a, b in zip(t.starts, t.ends, strict=True)]
    for lane in (0, 1):
        h = t.hashes(lane)
        assert len(set(zip(words, h.tolist(), strict=True))) == len(set(words)) == len(set(h.tolist()))
        w = kernel.window_hashes(h, 3)
        runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        assert len(set(zip(runs, w.tolist(), strict=True))) == len(set(runs)) == len(set(w.tolist()))


def test_one_long_word_hashes_like_itself_elsewhere():
    long = b"x" * (3 << 20) + b"y"
    t = kernel.Texts([b"a " + long, long + b" b", long[:-1] + b"z"])
    h = t.hashes()
    assert h[1] == h[2] != h[4]


def test_windows_stay_in_their_text():
    t = kernel.Texts([b"a b c", b"", b"d e", b"f g h i"])
    assert t.windows(3).tolist() == [0, 5, 6]


def test_slices_are_whole():
    batch = pa.RecordBatch.from_pydict({"i": list(range(10)), "t": ["x" * n for n in (0, 5, 100, 1, 1, 1, 0, 0, 50, 2)]})
    seen = [(i, t) for part, ts in kernel.slices(iter([batch]), "t", 60) for i, t in zip(part.column(0).to_pylist(), ts, strict=True)]
    assert [i for i, _ in seen] == list(range(10)) and [len(t) for _, t in seen] == [0, 5, 100, 1, 1, 1, 0, 0, 50, 2]


def brute(lengths, capacity):
    left, out = [], []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in left if r >= n]
        if fits:
            r = min(fits)
            left.remove(r)
        else:
            r = capacity
        left.append(r - n)
    return sorted(left)


def test_packing_is_best_fit_decreasing():
    for seed in range(120):
        r = random.Random(seed)
        capacity = r.choice([7, 10, 64, 4096])
        lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 200))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        bins = {}
        for run in best_fit_decreasing(counts, capacity):
            for k in range(run.n):
                bins.setdefault(run.bin + k // run.each, []).append((run.fill + (k % run.each) * run.length, run.length))
        for own in bins.values():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
        assert sorted(capacity - sum(n for _, n in own) for own in bins.values()) == brute(lengths, capacity)


def test_capacity_tree():
    tree = CapacityTree(100)
    assert tree.tightest(1) is None
    tree.set(40, True), tree.set(7, True), tree.set(100, True)
    assert [tree.tightest(n) for n in (1, 7, 8, 40, 41, 100)] == [7, 7, 40, 40, 100, 100]
    tree.set(40, False)
    assert tree.tightest(8) == 100


def test_segments_round_trip():
    for n in (0, 1, 31, 32, 33, 65_536, 65_537, 150_000):
        r = np.random.default_rng(n)
        docs = [d.astype("<u4").tobytes() for d in np.array_split(np.minimum(r.zipf(1.2, n), 49_407), 7)]
        s = rans.Segment(rans.encode(docs))
        assert list(s.documents()) == docs
        for k in range(len(s.index)):
            assert s.block(k).tobytes() == b"".join(docs)[4 * rans.BLOCK * k : 4 * rans.BLOCK * (k + 1)]


def test_a_segment_of_very_many_symbols():
    ids = np.random.default_rng(0).permutation(700_000).astype("<u4")
    ids = np.concatenate([ids, np.zeros(300_000, "<u4")])
    assert rans.scale_for(700_000) > rans.SCALE
    assert list(rans.Segment(rans.encode([ids.tobytes(), b"", ids[:9].tobytes()])).documents()) == [ids.tobytes(), b"", ids[:9].tobytes()]


def test_a_damaged_segment_is_noticed():
    data = bytearray(rans.encode([np.arange(5000, dtype="<u4").tobytes()]))
    data[len(data) // 2] ^= 1
    for checked in (True, False):
        try:
            list(rans.Segment(bytes(data), checked).documents())
        except (ValueError, IndexError):
            continue
        raise AssertionError("damage was not noticed")
