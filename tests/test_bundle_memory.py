"""What a task holds while it counts the bits of vectors."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tesserine.functions import hypervector as hv


def batch(n, keys, signs):
    vectors = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, (n, hv.WORDS))
    key = np.arange(n) % keys
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * hv.WORDS, pa.int32()), pa.array(vectors.reshape(-1)))
    return vectors, key, pa.RecordBatch.from_arrays([pa.array(key.astype(str)), lists, pa.array(signs, pa.int64())], ["key", "v", "sign"])


def test_counts_hold_a_few_rows(monkeypatch):
    for keys, signs in ((3, np.ones(3000)), (900, np.where(np.arange(3000) % 7, 1, -1))):
        vectors, key, given = batch(3000, keys, signs)
        tracemalloc.start()
        got, least = {}, 0
        for part in hv._partial_counts(iter([given]), hv.WORDS):
            assert part.num_rows <= hv.ANSWERED
            least += part.num_rows
            for k, n, row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), range(part.num_rows), strict=True):
                if int(k) in (0, 1, keys - 1):
                    got[int(k)] = n, part.column(2)[row].values.to_numpy()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert least == keys and peak < 64 << 20  # all bits as numbers are 246 MB
        for k, (n, counts) in got.items():
            own = key == k
            bits = np.unpackbits(vectors[own].view(np.uint8), axis=1, bitorder="little").astype(np.int64)
            assert n == signs[own].sum() and (counts == signs[own].astype(np.int64) @ bits).all()
