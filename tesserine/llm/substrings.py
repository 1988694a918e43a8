"""Removal of word windows that stand more than once in the corpus.

Each window of ``window`` consecutive words of a text has a rolling Rabin-Karp
hash of 64 bits. Spark counts them over all documents in two passes: the first on
as many bits as a bucket number and 32 more, which leaves nearly every unique
window out, the second on 128 bits (two rolling hashes in different bases) for the
windows that the first saw twice. Windows that the second pass saw twice are
repeated; those of a text that touch or overlap merge into maximal intervals.
Windows are judged on the input, not on what is left.
"""

from __future__ import annotations

from dataclasses import replace
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chunks, kernel
from .common import carried

WINDOW = 35


class _Windows:
    """Windows of a chunk's texts."""

    def __init__(self, texts: list[bytes | None], window: int) -> None:
        self.n, self.texts = window, kernel.Texts(texts)
        self.at = self.texts.windows(window)
        self.first = kernel.window_hashes(self.texts.hashes(), window)[self.at] if len(self.at) else np.empty(0, np.uint64)

    def covered(self, which: np.ndarray) -> np.ndarray:
        """Words that the windows numbered ``which`` cover."""
        n = len(self.texts.starts)
        at = self.at[which]
        step = np.bincount(at, minlength=n + self.n + 1) - np.bincount(at + self.n, minlength=n + self.n + 1)
        return np.cumsum(step)[:n] > 0

    def open(self, codes: np.ndarray, bits: int) -> np.ndarray:
        """Windows that the first pass saw twice."""
        return np.flatnonzero(codes[chunks.narrow(self.first, bits).where]) if len(self.at) else np.empty(0, np.int64)

    def exact(self, which: np.ndarray, bits: int) -> chunks.Distinct:
        """128-bit keys of some windows. Only words that they cover are hashed again."""
        t = self.texts
        words = np.zeros(len(t.starts), np.uint64)
        used = np.flatnonzero(self.covered(which))
        words[used] = kernel.span_hashes(t.buf, t.starts[used], t.ends[used], lane=1)
        second = kernel.window_hashes(words, self.n, lane=1)[self.at[which]] if len(which) else np.empty(0, np.uint64)
        return chunks.wide(second, self.first[which], bits)


def _twice(total: np.ndarray) -> np.ndarray:
    return total >= 2


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, verbatim: bool = False) -> DataFrame:
    """``docs`` with ``text`` reduced to the words kept (joined by one space), ``n_words`` before, ``n_removed``, and
    ``removed`` (array of first word and number of words of each maximal interval).

    With ``verbatim``, texts that lose nothing keep their white space. Input columns of those names are replaced. A
    null text counts as empty and becomes an empty text (with ``verbatim`` it stays null). Texts shorter than a window
    lose nothing. Repeated rows are each other's repeats. An empty table gives an empty result.
    """
    added = ["n_words", "n_removed", "removed"]
    packed, rest = carried(docs, [*added, text])
    packed = packed.select("_row", F.col(text).cast("string").alias("_text"), F.col(key).alias("_key"))
    dealt = chunks.deal(packed, F.col("_key"))
    dealt = replace(dealt, rows=dealt.rows.drop("_key"))
    bits = dealt.bits

    first = chunks.answered(chunks.ask(dealt, lambda texts: chunks.narrow(_Windows(texts, window).first, bits)), _twice, 1, 1, dealt)

    def reopened(texts: list[bytes | None], codes: pa.Table) -> chunks.Distinct:
        own = _Windows(texts, window)
        return own.exact(own.open(chunks.codes_of(codes, 1), bits), bits)

    second = chunks.answered(chunks.sending(dealt, first, reopened), _twice, 2, 2, dealt)

    interval = pa.struct([("first", pa.int64()), ("n", pa.int64())])
    row = dealt.rows.schema["_row"]
    span = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("n", T.LongType())]))
    schema = T.StructType([row, T.StructField("_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", span)])

    def cut(rows: pa.Table, codes: pa.Table) -> pa.Table:
        texts = kernel.binaries(rows.column("_text"))
        own = _Windows(texts, window)
        t = own.texts
        which = own.open(chunks.codes_of(codes, 1), bits)
        gone = np.zeros(len(t.starts), bool)
        if len(which):
            code = chunks.codes_of(codes, 2)
            which = which[code[own.exact(which, bits).where] > 0]
            gone = own.covered(which)
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[t.first[1:]] - total[t.first[:-1]]
        kept, spans = [], []
        for i, raw in enumerate(texts):
            a, b = int(t.first[i]), int(t.first[i + 1])
            if removed[i]:
                own_gone = gone[a:b]
                kept.append(b" ".join(compress((raw or b"").split(), ~own_gone)))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], own_gone.view(np.int8), [0]])))
                spans.append([{"first": int(x), "n": int(y - x)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
            else:
                kept.append(raw if verbatim else b" ".join((raw or b"").split()))
                spans.append([])
        return pa.table(
            [rows.column("_row"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(np.diff(t.first), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(interval))],
            ["_row", "_text", *added],
        )

    out = chunks.again(dealt, first.unionByName(second), cut, schema)
    return out.select(*[F.col("_row")[c].alias(c) for c in rest], F.col("_text").alias(text), *added)
