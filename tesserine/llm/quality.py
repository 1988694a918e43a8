"""Quality rules as a short-circuit cascade.

Each rule rejects a document on one or two features of its text. On a sample the
order is built rule by rule: of the rules left, the one comes next that rejects most
per second of those rows that the rules before it kept, where features that are
already there cost nothing. Rules then run in that order, each only on the rows that
all before it kept. The order changes the time only: a document is kept when no rule rejects it, whichever
comes first, so a biased or empty sample is harmless.

Nulls count as empty texts. Empty texts have zero for each feature and fall to
``too_short``. Repeated rows are judged one by one. Texts are never cut.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .common import carried

SYMBOLS = kernel._lut(set(b"#*$%&|<>"))
UPPER = kernel._lut(set(range(0x41, 0x5B)))
BANGS = kernel._lut(set(b"!"))

#: Rows that :func:`plan` times the rules on, files that they come from, and bytes of the longest. They fix the order of
#: the rules and nothing else.
SAMPLE_ROWS, SAMPLE_FILES, SAMPLE_BYTES = 1000, 8, 16 << 10


class Features:
    """Features of some texts, each computed when first asked for."""

    def __init__(self, texts: list[bytes | None]) -> None:
        self.source = texts
        self._texts: kernel.Texts | None = None
        self._made: dict[str, np.ndarray] = {}
        self._of: tuple[Features, np.ndarray] | None = None

    @property
    def texts(self) -> kernel.Texts:
        if self._texts is None:
            self._texts = kernel.Texts(self.source)
        return self._texts

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._made:
            self._made[name] = self._of[0][name][self._of[1]] if self._of and name[0] != "(" else getattr(self, f"_{name}")()
        return self._made[name]

    def only(self, rows: np.ndarray) -> Features:
        """Some of the rows. While they are most of the rows whose words are known, those are used again."""
        top, at = self._of or (self, np.arange(len(self.source)))
        out = Features([self.source[i] for i in rows])
        out._made = {k: v[rows] for k, v in self._made.items() if k[0] != "("}
        if 2 * len(rows) >= len(top.source):
            out._of = top, at[rows]
        return out

    def alike(self) -> Features:
        """The same rows with all that is known of them; what is asked of one stays unknown to the other."""
        out = Features(self.source)
        out._texts, out._made = self._texts, dict(self._made)
        if self._of:
            out._of = self._of[0].alike(), self._of[1]
        return out

    def _n_words(self) -> np.ndarray:
        return np.diff(self.texts.first)

    def _word_chars(self) -> np.ndarray:
        return self.texts.count(kernel.WORD_CHAR)

    def _n_symbols(self) -> np.ndarray:
        return self.texts.count(SYMBOLS)

    def _n_upper(self) -> np.ndarray:
        return self.texts.count(UPPER)

    def _n_bangs(self) -> np.ndarray:
        return self.texts.count(BANGS)

    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Owner and hash of each line that has a word."""
        t = self.texts
        lo, hi = kernel.spans(t.buf, kernel.NOT_NEWLINE)
        has = np.searchsorted(t.starts, lo) < np.searchsorted(t.starts, hi)
        lo, hi = lo[has], hi[has]
        return np.searchsorted(t.offsets, lo, "right") - 1, kernel.span_hashes(t.buf, lo, hi)

    def _n_lines(self) -> np.ndarray:
        return np.bincount(self["(lines)"][0], minlength=len(self.source))

    def _n_dup_lines(self) -> np.ndarray:
        owner, h = self["(lines)"]
        _, at = np.unique(_within(owner, h), return_index=True)
        return self["n_lines"] - np.bincount(owner[at], minlength=len(self.source))

    def _n_repeat_words(self) -> np.ndarray:
        t = self.texts
        at = t.windows(3)
        if not len(at):
            return np.zeros(len(self.source), np.int64)
        key = _within(t.owner()[at], kernel.window_hashes(t.hashes(), 3)[at])
        order = np.argsort(key)
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        size = np.diff(np.append(np.flatnonzero(new), len(key)))
        twice = at[order[np.repeat(size > 1, size)]]
        step = np.bincount(twice, minlength=len(t.starts) + 3) - np.bincount(twice + 3, minlength=len(t.starts) + 3)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(step)[: len(t.starts)] > 0)])
        return covered[t.first[1:]] - covered[t.first[:-1]]


setattr(Features, "_(lines)", Features._lines)


def _within(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hashes that agree only inside one text."""
    return kernel.mix(h ^ kernel.mix(owner.astype(np.uint64) + np.uint64(1)))


@dataclass(frozen=True)
class Rule:
    """``rejects`` takes the features by name and returns a boolean for each row."""

    name: str
    rejects: Callable[[Features], np.ndarray]


TOO_SHORT = Rule("too_short", lambda f: f["n_words"] < 50)
REPETITIVE = Rule("repetitive", lambda f: 100 * f["n_repeat_words"] > 50 * f["n_words"])
#: Production rules. Integer comparisons only, so SQL can state them exactly.
RULES = (
    TOO_SHORT,
    REPETITIVE,
    Rule("symbols", lambda f: 100 * f["n_symbols"] > 10 * f["n_words"]),
    Rule("duplicate_lines", lambda f: 100 * f["n_dup_lines"] > 50 * f["n_lines"]),
    Rule("shouting", lambda f: 100 * f["n_upper"] > 50 * f["word_chars"]),
    Rule("exclamations", lambda f: 100 * f["n_bangs"] > 30 * f["n_words"]),
    Rule("word_length", lambda f: (f["word_chars"] > 12 * f["n_words"]) | (f["word_chars"] < 2 * f["n_words"])),
)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def ordered(texts: list[bytes | None], rules: tuple[Rule, ...], features: tuple[str, ...] = ()) -> tuple[Rule, ...]:
    """Rules by rejection per cost over ``texts``, each measured on the rows that those before it keep.

    ``features`` are there anyway and cost nothing. Ties, as on no rows, stay in the order given.
    """
    left, out, now = list(rules), [], Features(texts)
    for f in features:
        now[f]
    while left:
        best: tuple[float, Rule, np.ndarray] | None = None
        for rule in left:
            own = now.alike()
            began = time.perf_counter()
            no = rule.rejects(own)
            value = float(np.count_nonzero(no)) / max(time.perf_counter() - began, 1e-9)
            if best is None or value > best[0]:
                best = value, rule, no
        left.remove(best[1])
        out.append(best[1])
        best[1].rejects(now)  # what it computes is there for the next
        if best[2].any():
            now = now.only(np.flatnonzero(~best[2]))
    return tuple(out)


def sampled(docs: DataFrame, text: str, rows: int = SAMPLE_ROWS) -> list[bytes]:
    """Texts of at most ``rows`` rows: the first of some files that lie far apart, or of all rows where those don't come
    straight from files. Only these files are opened, and no further than it takes."""
    names = sorted({f.rsplit("/", 1)[-1] for f in docs.inputFiles()})
    chosen = names[:: max(1, -(-len(names) // SAMPLE_FILES))]
    text_ = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("t")
    some = lambda rows_, n: [bytes(r.t) for r in rows_.select(text_).where(F.octet_length("t") <= SAMPLE_BYTES).limit(n).collect()]
    if len(chosen) > 1:
        try:
            return [t for name in chosen for t in some(docs.where(F.col("_metadata.file_name") == name), rows // len(chosen))]
        except AnalysisException:
            pass  # rows of a join or of a computed table have no file
    return some(docs, rows)


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS, features: tuple[str, ...] = ()) -> tuple[Rule, ...]:
    """Rules by rejection per cost, the highest first, as a bounded sample of rows estimates them."""
    return ordered(sampled(docs, text, sample_rows), rules, features)


def judge(feats: Features, rules: tuple[Rule, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of the rule that rejected it (-1: kept), and how many rules it went through."""
    n = len(feats.source)
    by, seen = np.full(n, -1), np.zeros(n, np.int32)
    alive, now = np.arange(n), feats
    for k, rule in enumerate(rules):
        if not len(alive):
            break
        seen[alive] += 1
        no = rule.rejects(now)
        by[alive[no]] = k
        if no.any():
            keep = np.flatnonzero(~no)
            alive, now = alive[keep], now.only(keep)
    return by, seen


def cascade(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    text: str = "text",
    features: tuple[str, ...] = (),
    order: tuple[Rule, ...] | None = None,
) -> DataFrame:
    """``docs`` with ``kept`` (boolean), ``rejected_by`` (rule or null), ``n_rules`` (rules run on the row)
    and the named features.

    Input columns of those names are replaced. No row is dropped. A null text is
    kept as null and judged as empty. An empty table gives an empty result. The
    features named are computed for every row, rejected or not; others only where
    a rule that is reached needs them.
    """
    order = order or plan(docs, rules, text, features=features)
    added = ["kept", "rejected_by", "n_rules", *features]
    packed, rest = carried(docs, added)
    packed = packed.select("_row", F.col(text).cast("string").alias("_text"))
    schema = T.StructType([packed.schema["_row"], T.StructField("kept", T.BooleanType()), T.StructField("rejected_by", T.StringType()), T.StructField("n_rules", T.IntegerType()), *[T.StructField(f, T.LongType()) for f in features]])
    names = [r.name for r in order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in kernel.slices(batches, "_text"):
            feats = Features(texts)
            made = [pa.array(feats[f], pa.int64()) for f in features]
            by, seen = judge(feats, order)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(by < 0), pa.array([None if k < 0 else names[k] for k in by], pa.string()), pa.array(seen, pa.int32()), *made],
                ["_row", *added],
            )

    out = packed.mapInArrow(run, schema)
    return out.select(*[F.col("_row")[c].alias(c) for c in rest], *added)


def accepted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their own columns unchanged."""
    flag: Column = F.col("_verdict.kept")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"), F.col(text).cast("string").alias("_t"))
    judged = cascade(whole, rules, "_t").select("_all", F.struct("kept").alias("_verdict"))
    return judged.where(flag).select(*[F.col("_all")[c].alias(c) for c in docs.columns])
