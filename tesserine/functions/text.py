"""Tokenizers, stable hashes and the text encoder."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import md5
import re
from math import sin

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hypervector import WORDS, Adder, majorities, majority, rotated

#: The white space of every tokenizer here; both engines of a comparison read it alike.
SPACE = r"[ \t\n\r\x0B\f]+"


def tokenize(text: Column, code_aware: bool = False, lowercase: bool = True) -> Column:
    """Words between white space; ``code_aware`` also splits at ``_ - . /`` and ``::``. No empty tokens."""
    text = F.lower(text) if lowercase else text
    pattern = rf"::|[_\-./]|{SPACE}" if code_aware else SPACE
    return F.filter(F.split(F.coalesce(text, F.lit("")), pattern), lambda t: t != "")


def tokenize_search(text: Column, code_aware: bool = False) -> Column:
    return tokenize(text, code_aware)


def stem(token: Column) -> Column:
    """Without a final ``ing`` or ``ed`` where over two letters remain; ``ved`` becomes ``ve``."""
    n = F.length(token)
    but = lambda k: F.substr(token, F.lit(1), n - k)
    return (
        F.when(token.endswith("ing") & (n > 5), but(3))
        .when(token.endswith("ved") & (n > 4), but(1))
        .when(token.endswith("ed") & (n > 4), but(2))
        .otherwise(token)
    )


def tokenize_keywords(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and ``-`` of over one byte, stemmed."""
    runs = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\-]+"), lambda t: F.length(t) > 1)
    return F.transform(runs, stem)


@dataclass(frozen=True)
class Words:
    """A tokenizer for :func:`counted`: the column that it reads (binary), what finds the words of one text, and what
    changes them, in place, once they are counted."""

    text: Column
    found: Callable[[bytes], list[bytes]]
    then: Callable[[dict[bytes, int]], None] | None = None

    @staticmethod
    def plain(text: Column, code_aware: bool = False) -> Words:
        """The words of :func:`tokenize`."""
        # bytes are split at the white space of SPACE
        return Words(F.lower(F.coalesce(text, F.lit(""))).cast("binary"), _code_words if code_aware else bytes.split)

    @staticmethod
    def keywords(text: Column) -> Words:
        """The words of :func:`tokenize_keywords`."""
        return Words(F.lower(F.coalesce(text, F.lit(""))).cast("binary"), _keywords, _stemmed)


def _code_words(text: bytes) -> list[bytes]:
    return re.sub(rb"::|[_\-./]", b" ", text).split()


_BLANK = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789-" else 32 for c in range(256))


def _keywords(text: bytes) -> list[bytes]:
    return text.translate(_BLANK).split()


def _stemmed(times: dict[bytes, int]) -> None:
    """:func:`stem` of counted words; those of one byte go."""
    moved = [(t, times.pop(t)) for t in [t for t in times if t[-1] in b"gd" or len(t) < 2]]
    for t, n in moved:
        if t.endswith(b"ing") and len(t) > 5:
            t = t[:-3]
        elif t.endswith(b"ved") and len(t) > 4:
            t = t[:-1]
        elif t.endswith(b"ed") and len(t) > 4:
            t = t[:-2]
        if len(t) > 1:
            times[t] = times.get(t, 0) + n


def counted(docs: DataFrame, tokens: Column | Words, id_: str = "id") -> DataFrame:
    """Each row's ``id``, its number of words ``dl``, and ``words``: each different one with the times (``tf``) that it stands there.

    Rows are counted where they are read; a word of a text leaves its task once.
    """
    given = docs.select(F.col(id_).alias("id"), (tokens.text if isinstance(tokens, Words) else tokens).alias("tokens"))
    found, then = (tokens.found, tokens.then) if isinstance(tokens, Words) else (None, None)
    schema = T.StructType([given.schema["id"], T.StructField("dl", T.IntegerType()), T.StructField("words", T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                dl, terms, tfs, ends = [], [], [], [0]
                for own in part.column(1).to_pylist():
                    times = Counter(found(own) if found else own or ())
                    if then:
                        then(times)
                    dl.append(None if own is None else sum(times.values()))
                    terms += times
                    tfs += times.values()
                    ends.append(len(terms))
                named = pa.array(terms, pa.binary()).cast(pa.string()) if found else pa.array(terms, pa.string())
                each = pa.StructArray.from_arrays([named, pa.array(tfs, pa.int64())], ["term", "tf"])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(dl, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)], ["id", "dl", "words"])

    return given.mapInArrow(count, schema)


# Words that say nothing about a text's topic.
STOPWORDS = ("a", "an", "the", "is", "am", "are", "my", "me", "i", "you", "your", "what", "which", "did", "do", "does", "after", "where", "number", "should")


def overlap_ratio(query: Column, document: Column) -> Column:
    """Share of the query's tokens (repeats count, stopwords don't) that the document has; 0 without such tokens."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    own = F.filter(query, lambda t: ~F.array_contains(stop, t))
    # both are made once a row here; inside a lambda they would be made again for each token
    share = lambda x: F.when(F.size(x["own"]) > 0, F.size(F.filter(x["own"], lambda t: F.array_contains(x["document"], t))) / F.size(x["own"])).otherwise(F.lit(0.0))
    return F.transform(F.array(F.struct(own.alias("own"), document.alias("document"))), share)[0]


def normalize(query: Column) -> Column:
    """Without white space at the ends, in small letters."""
    return F.lower(F.regexp_replace(query, r"(?U)^\s+|\s+$", ""))


#: Offset and prime of the 64-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a_all(texts: list[bytes]) -> list[int]:
    """:func:`fnv1a` of many texts: a step takes the next byte of each that is still that long, the longest first."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    flat = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
    first = np.cumsum(sizes) - sizes
    h = np.full(len(texts), FNV_OFFSET, np.uint64)
    prime, most = np.uint64(FNV_PRIME), int(sizes[0]) if len(sizes) else 0
    for at in range(most):
        n = int(np.searchsorted(-sizes, -at, "left"))  # texts of over ``at`` bytes
        if n < 4:  # a few long texts go on one by one
            for i in range(n):
                x = int(h[i])
                for b in flat[first[i] + at : first[i] + sizes[i]].tolist():
                    x = ((x ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
                h[i] = x
            break
        h[:n] = (h[:n] ^ flat[first[:n] + at]) * prime
    out = [0] * len(texts)
    for i, x in zip(order, h.tolist(), strict=True):
        out[i] = x
    return out


@F.pandas_udf(T.StringType())
def stable_hash(text: pd.Series) -> pd.Series:
    """FNV-1a of the UTF-8 bytes, as 16 hexadecimal digits."""
    made = fnv1a_all([(t or "").encode() for t in text])
    return pd.Series([None if t is None else f"{h:016x}" for t, h in zip(text, made, strict=True)], dtype=object)


def absence_id(query: Column) -> Column:
    return F.concat(F.lit("absence:"), stable_hash(normalize(query)))


@F.pandas_udf(T.StringType())
def scoped_absence_id(scope: pd.Series, query: pd.Series) -> pd.Series:
    """Id within a scope: the hash of the scope's length (8 bytes, little-endian), the scope and the query."""
    made = fnv1a_all([len(s.encode()).to_bytes(8, "little") + s.encode() + q.encode() for s, q in zip(scope, query, strict=True)])
    return pd.Series([f"absence:{h:016x}" for h in made], dtype=object)


def to_sentence(subject: Column, predicate: Column, object_: Column) -> Column:
    return F.concat_ws(" ", subject, predicate, object_)


def to_context(summary: Column, facts: Column) -> Column:
    """A summary line and a list of facts."""
    return F.concat(F.lit("Summary: "), summary, F.lit("\nFacts:\n"), F.array_join(F.transform(facts, lambda f: F.concat(F.lit("- "), f)), "\n"))


def estimated_tokens(text: Column) -> Column:
    """Words over 0.75, rounded up."""
    return F.ceil(F.size(tokenize(text)) / 0.75)


def preview(text: Column, n: int = 200) -> Column:
    return F.substring(text, 1, n)


def word_vector(token: str, prefix: str = "hv") -> np.ndarray:
    """:func:`tesserine.functions.hypervector.seeded` of one token, in memory."""
    digests = b"".join(md5(f"{prefix}:{token}:{i}".encode()).digest() for i in range(WORDS // 2))
    return np.frombuffer(digests, ">u8").astype(np.uint64)


#: Turns and constants of the 64 steps of MD5, as its standard has them; which word of the block each step takes.
_TURNS = [t for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in row * 4]
_SINES = [int(abs(sin(i + 1)) * (1 << 32)) for i in range(64)]
_TAKEN = [(m * i + c) % 16 for m, c, at in ((1, 0, 0), (5, 1, 16), (3, 5, 32), (7, 0, 48)) for i in range(at, at + 16)]
_BEGIN = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_blocks(block: list[np.ndarray | None], shape: tuple[int, ...]) -> np.ndarray:
    """MD5 digests of messages of one block each: ``block`` has its 16 little-endian words (arrays that broadcast to
    ``shape``, or none where a word is zero in all), the result four words a message."""
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _BEGIN)
    f = np.empty(shape, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        if (word := block[_TAKEN[i]]) is not None:
            f += word
        f += np.uint32(_SINES[i])
        # the first word is not needed any more: its memory takes the new one
        np.left_shift(f, np.uint32(_TURNS[i]), out=a)
        f >>= np.uint32(32 - _TURNS[i])
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    return np.stack([x + np.uint32(y) for x, y in zip((a, b, c, d), _BEGIN, strict=True)], axis=-1)


#: Tokens whose digests are made at once: 10 240 messages, so that all stays in the cache.
HASHED = 128


def word_vectors(tokens: list[str], prefix: str = "hv") -> np.ndarray:
    """:func:`word_vector` of many tokens, one row each. A message of at most 55 bytes is one block of MD5."""
    out, places = np.empty((len(tokens), WORDS), np.uint64), WORDS // 2
    begun = [f"{prefix}:{t}:".encode() for t in tokens]
    short = [i for i, b in enumerate(begun) if len(b) + len(str(places - 1)) <= 55]
    short.sort(key=lambda i: len(begun[i]))
    for at in range(0, len(short), HASHED):
        some = short[at : at + HASHED]
        one = np.frombuffer(b"".join(begun[i].ljust(56, b"\0") for i in some), np.uint8).reshape(-1, 56)
        sizes = np.array([len(begun[i]) for i in some])
        # only the words that hold digits differ from place to place
        low, high = int(sizes[0]) // 4, (int(sizes[-1]) + 2) // 4 + 1
        ends = np.repeat(one[:, None, 4 * low : 4 * high], places, axis=1)
        for n in np.unique(sizes).tolist():
            a, b = np.searchsorted(sizes, [n, n + 1])
            ends[a:b, :, n - 4 * low : n - 4 * low + 3] = _ENDS
        block = [np.ascontiguousarray(w)[:, None] for w in one.view("<u4")[:, :low].T]
        block += [np.ascontiguousarray(ends.view("<u4")[..., k]) for k in range(high - low)]
        block += [None] * (14 - high) + [((sizes[:, None] + _DIGITS) * 8).astype(np.uint32), None]
        out[some] = _md5_blocks(block, (len(some), places)).view(">u8").reshape(len(some), WORDS)
    for i in set(range(len(tokens))).difference(short):
        out[i] = word_vector(tokens[i], prefix)
    return out


#: The digits of each place with the bit that ends a message, and how many digits they are.
_ENDS = np.array([list((str(i).encode() + b"\x80").ljust(3, b"\0")) for i in range(WORDS // 2)], np.uint8)
_DIGITS = np.array([len(str(i)) for i in range(WORDS // 2)], np.int64)


@lru_cache(maxsize=50_000)
def _word_vector(token: str) -> np.ndarray:
    return word_vector(token)


def _tokens(text: str, code_aware: bool, lowercase: bool) -> list[str]:
    import re

    text = text.lower() if lowercase else text
    return [t for t in re.split(rf"::|[_\-./]|{SPACE}" if code_aware else SPACE, text) if t]


def _runs(text: str, n: int) -> Counter:
    """The runs of ``n`` characters and how often each stands; none outside 1 to 32."""
    return Counter(text[i : i + n] for i in range(len(text) - n + 1)) if 1 <= n <= 32 else Counter()


def ngram_vector(text: str, n: int) -> np.ndarray:
    """Majority of the vectors of all runs of ``n`` characters; zero outside 1 to 32 or for shorter texts."""
    runs = _runs(text, n)
    return majority((_word_vector(r) for r in runs), runs.values())


def encode_text(text: str, stride: int = 1, ngrams: int | None = None, code_aware: bool = False, lowercase: bool = True) -> np.ndarray:
    """Majority of the tokens' vectors, each rotated by its place times ``stride``; with ``ngrams`` joined (by
    conjunction, the majority of two) with the text's character runs. No tokens: zero. One token: its own vector."""
    tokens = _tokens(text, code_aware, lowercase)
    if not tokens:
        return np.zeros(WORDS, np.uint64)
    own = _word_vector(tokens[0]) if len(tokens) == 1 else majority(rotated(_word_vector(t), (i * stride) % (64 * WORDS)) for i, t in enumerate(tokens))
    if not ngrams:
        return own
    return majority([own, ngram_vector(text.lower() if lowercase else text, ngrams)])


#: Texts that are encoded at once: their sums take 40 KB each.
TEXTS = 64


@lru_cache(maxsize=1)
def _adder() -> Adder:
    return Adder(word_vectors)


#: Bits of a character in the number that stands for a run of at most ``NUMBERED`` of them.
CHARACTER, NUMBERED = 21, 3


def _run_counts(text: str, n: int) -> tuple[list, np.ndarray]:
    """:func:`_runs` with short runs as numbers: the different ones, and how often each stands."""
    if not 1 <= n <= NUMBERED or len(text) < n:
        runs = _runs(text, n)
        return list(runs), np.array(list(runs.values()), np.int64)
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    numbers = codes[: len(codes) - n + 1]
    for k in range(1, n):
        numbers = numbers << CHARACTER | codes[k : len(codes) - n + 1 + k]
    runs, times = np.unique(numbers, return_counts=True)
    return runs.tolist(), times


def _run_vectors(runs: list, n: int) -> np.ndarray:
    if n > NUMBERED:
        return word_vectors(runs)
    return word_vectors(["".join(chr(r >> CHARACTER * k & (1 << CHARACTER) - 1) for k in reversed(range(n))) for r in runs])


@lru_cache(maxsize=1)
def _run_adder(n: int) -> Adder:
    return Adder(lambda runs: _run_vectors(runs, n))


def encode_texts(texts: list[str], stride: int = 1, ngrams: int | None = None, code_aware: bool = False, lowercase: bool = True) -> np.ndarray:
    """:func:`encode_text` of many texts, one row each."""
    if len(texts) > TEXTS:
        return np.concatenate([encode_texts(texts[i : i + TEXTS], stride, ngrams, code_aware, lowercase) for i in range(0, len(texts), TEXTS)])
    adder, tokens = _adder(), [_tokens(t, code_aware, lowercase) for t in texts]
    n = np.array([len(t) for t in tokens], np.int64)
    own = majorities(adder.sums(((i, t, 1) for i, t in enumerate(tokens)), len(texts), stride), n)
    if not ngrams:
        return own
    runs = _run_adder(ngrams)
    for i, text in enumerate(texts):
        if n[i]:
            names, times = _run_counts(text.lower() if lowercase else text, ngrams)
            own[i] &= majorities(runs.weighed(names, times)[None], times.sum(keepdims=True))[0]
    return own


def encoder(stride: int = 1, ngrams: int | None = None, code_aware: bool = False) -> Callable[[Column], Column]:
    """:func:`encode_text` over Arrow batches. Null texts are encoded as empty."""

    @F.pandas_udf("array<bigint>")
    def encode(texts: pd.Series) -> pd.Series:
        made = encode_texts([t or "" for t in texts], stride, ngrams, code_aware) if len(texts) else np.zeros((0, WORDS), np.uint64)
        return pd.Series(list(made.view(np.int64)), dtype=object)

    return encode
