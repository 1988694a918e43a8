"""Licence scan by a positional index of rare words.

Every licence template is a list of words. One pass over all documents counts in how
many of them each template word occurs (its document frequency); the vocabulary is
fixed by the templates, so the counts are some thousand numbers at any size. The
index holds, for each template, the postings (template, place) of its words of
highest inverse document frequency, and of the highest of its key phrases, which no
text with the licence can lack. A second pass takes the words of each text that
the index holds, looks their postings up, and intersects them by relative position:
each occurrence votes for the shift ``place in text - place in template``, and where
different words of a template meet at shifts that lie close together, words added or
left out between them, is a candidate. In it every mandatory key phrase of the
template must stand, in order; each first key phrase makes one notice. Its score is
the share of the template's words that stand in the stretch in order (their longest
common subsequence).

Base phrases are counted apart from this, at all places.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .common import carried
from .licence_texts import TAG, TEMPLATES, Template


#: Phrases of the contract and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Words of highest IDF that a template is looked up by; of a short one half of its words.
RARE_WORDS = 8
#: Words that may be added or left out between two words that vote for one candidate.
GAP = 16

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[str]:
    """Words of a text by the contract: A-Z lower-cased, runs of letters, digits and signs beyond ASCII."""
    return _WORD.findall(text.translate(_SMALL))


_SMALL = {c: c + 32 for c in range(0x41, 0x5B)}


class _Index:
    """Vocabulary, phrases, and with ``idf`` the postings of rare words, all as small arrays."""

    def __init__(self, templates: tuple[Template, ...], phrases: dict[str, str], idf: np.ndarray | None = None) -> None:
        self.templates, self.phrases = templates, phrases
        lists = [words_of(t.text) for t in templates]
        self.words = sorted({w for own in lists for w in own} | {w for t in templates for k in t.keys for w in words_of(k)} | {w for p in phrases for w in words_of(p)})
        joined = kernel.Texts([" ".join(self.words).encode()], kernel.ALNUM)
        h = joined.hashes()
        self.order = np.argsort(h)
        self.sorted = h[self.order]
        self.number = {w: i for i, w in enumerate(self.words)}
        self.phrase_codes = [(self._codes(words_of(p)), label) for p, label in phrases.items()]
        self.template_codes = [self._codes(own) for own in lists]
        self.key_codes = [[self._codes(words_of(k)) for k in t.keys] for t in templates]
        # where the first and last key phrases stand in their template
        self.before = [_first(c, k[0]) for c, k in zip(self.template_codes, self.key_codes, strict=True)]
        self.after = [len(c) - _first(c, k[-1]) - len(k[-1]) for c, k in zip(self.template_codes, self.key_codes, strict=True)]
        self.identifiers = self._identifiers()
        if idf is None:
            return
        rows = []
        for k, codes in enumerate(self.template_codes):
            rarest = lambda own, n: own[np.lexsort((own, -idf[own]))][:n].tolist()
            own, keys = np.unique(codes), [np.unique(key) for key in self.key_codes[k]]
            # words that a text may lack, and two that it must have side by side, as they stand in the first key phrase
            rare = {*rarest(own, min(RARE_WORDS, len(own) // 2)), *rarest(keys[0], 2), *(c for key in keys[1:] for c in rarest(key, 1))}
            rows += [(c, k, int(at)) for c in rare for at in np.flatnonzero(codes == c)]
        rows.sort()
        self.post_template, self.post_place = (np.array([r[i] for r in rows], np.int64) for i in (1, 2))
        self.n_posts = np.bincount([r[0] for r in rows], minlength=len(self.words))
        self.first_post = np.cumsum(self.n_posts) - self.n_posts
        #: Different rare words that have to meet; the first key phrase alone has as many.
        self.least = np.array([min(2, len(np.unique(keys[0]))) for keys in self.key_codes])

    def _identifiers(self) -> dict[tuple[int, ...], str]:
        """Identifiers of tag lines by their words."""
        n = len(words_of(TAG))
        tags = [(t.label, c) for t, c in zip(self.templates, self.template_codes, strict=True) if words_of(t.text)[:n] == words_of(TAG)]
        return {tuple(c[n:].tolist()): label for label, c in tags}

    def expression(self, codes: np.ndarray, at: int) -> Iterator[tuple[int, int, str]]:
        """Place, words and label of each identifier that ``or`` and ``and`` join to the one that ends at ``at``."""
        joins = {self.number.get("or"), self.number.get("and")}
        longest = max(map(len, self.identifiers), default=0)
        while at < len(codes) and int(codes[at]) in joins:
            own = next((n for n in range(longest, 0, -1) if tuple(codes[at + 1 : at + 1 + n].tolist()) in self.identifiers), 0)
            if not own:
                return
            yield at + 1, own, self.identifiers[tuple(codes[at + 1 : at + 1 + own].tolist())]
            at += 1 + own

    def _codes(self, words: list[str]) -> np.ndarray:
        return np.array([self.number[w] for w in words])

    def code(self, h: np.ndarray) -> np.ndarray:
        """Numbers of vocabulary words, -1 for others."""
        at = np.searchsorted(self.sorted, h)
        at[at == len(self.sorted)] = 0
        return np.where(self.sorted[at] == h, self.order[at], -1)

    def candidates(self, code: np.ndarray, owner: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Text, template, and the first and last word of the stretches where rare words of the template meet."""
        held = np.flatnonzero(code >= 0)
        held = held[self.n_posts[code[held]] > 0]
        n = self.n_posts[code[held]]
        post = np.repeat(self.first_post[code[held]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = np.repeat(held, n)
        template, text = self.post_template[post], owner[at]
        shift = at - first[text] - self.post_place[post]
        order = np.lexsort((shift, template, text))
        text, template, shift, word = text[order], template[order], shift[order], code[at][order]
        if not len(text):
            return
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (template[1:] != template[:-1]) | (shift[1:] - shift[:-1] > GAP)
        begin = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        kinds = np.bincount(np.unique(group * len(self.words) + word) // len(self.words), minlength=len(begin))
        end = np.append(begin[1:], len(text)) - 1
        for g in np.flatnonzero(kinds >= self.least[template[begin]]).tolist():
            i, k = int(text[begin[g]]), int(template[begin[g]])
            size = int(first[i + 1] - first[i])
            yield i, k, max(0, int(shift[begin[g]]) - GAP), min(size, int(shift[end[g]]) + len(self.template_codes[k]) + GAP)

    def notices(self, k: int, codes: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int]]:
        """First word and words met of each notice of template ``k`` in the stretch ``lo .. hi`` of a text.

        A notice is a first key phrase and the nearest next ones after it, before the next first one.
        """
        part, template, keys = codes[lo:hi], self.template_codes[k], self.key_codes[k]
        none = np.zeros(len(part), np.int8)
        places = [_runs(part, none, key) for key in keys]
        if not all(len(p) for p in places):
            return
        starts = places[0].tolist()
        for s, next_ in zip(starts, [*starts[1:], len(part)], strict=True):
            at, end = s, s + len(keys[0])
            for key, own in zip(keys[1:], places[1:], strict=True):
                j = int(np.searchsorted(own, end))
                if j == len(own):
                    return
                at, end = int(own[j]), int(own[j]) + len(key)
            if at >= next_ and len(keys) > 1:
                continue
            x, y = max(0, lo + s - self.before[k] - GAP), min(len(codes), lo + end + self.after[k] + GAP)
            own = codes[x:y]
            exact = lo + s - self.before[k]
            whole = exact >= 0 and np.array_equal(codes[exact : exact + len(template)], template)
            back = 0
            while back < min(self.before[k], lo + s) and codes[lo + s - back - 1] == template[self.before[k] - back - 1]:
                back += 1
            yield lo + s - back, len(template) if whole else _common(template, own)


def _first(codes: np.ndarray, phrase: np.ndarray) -> int:
    """Where a phrase stands in a template; 0 where it does not."""
    at = _runs(codes, np.zeros(len(codes), np.int8), phrase)
    return int(at[0]) if len(at) else 0


def _common(template: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, a row of bits for each word of the text."""
    where: dict[int, int] = {}
    for i, c in enumerate(template.tolist()):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(template)) - 1
    row = full
    for c in text.tolist():
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(template) - row.bit_count()


def _runs(codes: np.ndarray, owner: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Places where the phrase's words stand consecutively in one text."""
    n = len(phrase)
    at = np.flatnonzero(codes == phrase[0])
    at = at[at + n <= len(codes)]
    for k in range(1, n):
        at = at[codes[at + k] == phrase[k]]
    return at[owner[at] == owner[at + n - 1]]


def frequencies(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> tuple[int, dict[str, int]]:
    """Documents, and documents that hold each vocabulary word, over all of ``docs``."""
    index = _Index(templates, phrases)
    v = len(index.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(v, np.int64), 0
        for _, texts in kernel.slices(batches, "_text"):
            t = kernel.Texts(texts, kernel.ALNUM, lower=True)
            code = index.code(t.hashes())
            has = code >= 0
            pair = np.unique(t.owner()[has] * v + code[has])
            found += np.bincount(pair % v, minlength=v)
            n += len(t)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(v), -1)), pa.array(np.append(found, n))], ["word", "df"])

    rows = docs.select(F.col(text).cast("string").alias("_text")).mapInArrow(count, "word long, df long").groupBy("word").agg(F.sum("df").alias("df")).collect()
    df = {r.word: r.df for r in rows}
    return df.get(-1, 0), {w: df.get(i, 0) for i, w in enumerate(index.words)}


def scan(
    docs: DataFrame,
    text: str = "text",
    templates: tuple[Template, ...] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    counts: tuple[int, dict[str, int]] | None = None,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_base`` (places of base phrases), ``first_word`` and ``last_word`` (their
    smallest and largest start, in words from 0, else null), ``base_labels`` and ``labels`` (distinct, sorted,
    comma-joined; empty if none), ``score`` (largest share of a template's words met at an alignment, 1.0 for a
    whole notice, 0.0 for none) and ``notices`` (array of label, first word, words met).

    Input columns of those names are replaced. A null text counts as empty and has no words, labels or notices.
    Repeated rows and ties are each reported. A notice is reported once for each place of its first key phrase. After the
    identifier of a tag line, those that ``OR`` or ``AND`` join to it are labels and notices too.
    """
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"]
    total, df = counts or frequencies(docs, text, templates, phrases)
    plain = _Index(templates, phrases)
    index = _Index(templates, phrases, np.array([log((1 + total) / (1 + df.get(w, 0))) for w in plain.words]))
    packed, rest = carried(docs, added)
    packed = packed.select("_row", F.col(text).cast("string").alias("_text"))
    notice = T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("n_met", T.LongType())])
    kinds = [T.LongType()] * 4 + [T.StringType()] * 2 + [T.DoubleType(), T.ArrayType(notice)]
    schema = T.StructType([packed.schema["_row"], *[T.StructField(n, k) for n, k in zip(added, kinds, strict=True)]])
    arrow = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_met", pa.int64())]))]

    tags = set(index.identifiers.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in kernel.slices(batches, "_text"):
            t = kernel.Texts(texts, kernel.ALNUM, lower=True)
            code, owner = index.code(t.hashes()), t.owner()
            n = len(t)
            base, labels = np.zeros(n, np.int64), [set() for _ in range(n)]
            first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            for phrase, label in index.phrase_codes:
                at = _runs(code, owner, phrase)
                own = owner[at]
                place = at - t.first[own]
                base += np.bincount(own, minlength=n)
                np.minimum.at(first, own, place)
                np.maximum.at(last, own, place)
                for i in np.unique(own).tolist():
                    labels[i].add(label)
            every, score, notices = [set(x) for x in labels], np.zeros(n), [[] for _ in range(n)]
            told: set[tuple[int, int, int]] = set()
            for i, k, lo, hi in index.candidates(code, owner, t.first):
                for place, met in index.notices(k, code[t.first[i] : t.first[i + 1]], lo, hi):
                    if (i, k, place) in told:
                        continue
                    told.add((i, k, place))
                    label = index.templates[k].label
                    every[i].add(label)
                    notices[i].append({"label": label, "first_word": place, "n_met": met})
                    score[i] = max(score[i], met / len(index.template_codes[k]))
                    if label in tags:
                        own = code[t.first[i] : t.first[i + 1]]
                        for at, words, other in index.expression(own, place + len(index.template_codes[k])):
                            every[i].add(other)
                            notices[i].append({"label": other, "first_word": at, "n_met": words})
            for x in notices:
                x.sort(key=lambda m: (m["first_word"], m["label"]))
            cols = [
                np.diff(t.first), base, [None if b < 0 else int(a) for a, b in zip(first, last, strict=True)], [None if b < 0 else int(b) for b in last],
                [",".join(sorted(x)) for x in labels], [",".join(sorted(x)) for x in every], score, notices,
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, a) for c, a in zip(cols, arrow, strict=True)]], ["_row", *added])

    out = packed.mapInArrow(run, schema)
    return out.select(*[F.col("_row")[c].alias(c) for c in rest], *added)
