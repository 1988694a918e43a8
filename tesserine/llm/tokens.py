"""Token ids of whole texts, by the ``tokenizers`` library and one vocabulary file.

``word_bpe_49k.json`` drops white space, splits the rest into pieces (letters, single
digits, other signs, a few English endings) and merges inside each piece alone.
Texts repeat pieces far more than they differ: the pieces of some texts are found and
told apart together, by 64-bit hashes, and each worker keeps a bounded memory of
pieces, by their bytes, that the library has encoded. Only texts whose normal form and split are
certain (ASCII and Latin-1 letters, no other control characters, no special tokens)
go this way; all others go to the library whole. So do all texts under any other file:
the way by pieces is taken only where the file's own steps are the ones it stands for.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np

from .kernel import HELD, span_hashes

#: Pieces that one worker remembers; two generations of this size bound its memory.
REMEMBER = 250_000
#: Pieces given to the library in one call, and characters of texts that are split together.
_CALL, _TOGETHER = 5_000, 1 << 20

_PLAIN = re.compile(r"[\t\n\x0b\x0c\r -~À-ÿ]*")
_LETTERS = "a-zß-öø-ÿ"
_ENDING = re.compile(r"'(?:s|t|re|ve|m|ll|d)")
_GAP = re.compile(r"\s")
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+")


# The steps of a file whose texts may be split here.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def splits_here(path: str) -> bool:
    """Does the file normalise and split texts by the steps that :class:`Encoder` follows itself?"""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    plain = all(not t["normalized"] and not t["single_word"] and not t["lstrip"] and not t["rstrip"] for t in made["added_tokens"])
    return (
        made["normalizer"] == _NORMALIZER and made["pre_tokenizer"] == _SPLITTER and made["model"]["type"] == "BPE" and not made["model"]["dropout"]
        and made["truncation"] is None and plain
    )


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_LETTER, _DIGIT, _SIGN = 1, 2, 3
# kinds of bytes: white space, letters and all bytes beyond ASCII, digits, other signs
_KIND = np.array([0 if b in b" \t\n\x0b\x0c\r" else _DIGIT if 0x30 <= b <= 0x39 else _LETTER if b >= 0x80 or 0x61 <= b <= 0x7A else _SIGN for b in range(256)], np.uint8)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, as the library gives them."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path = path
        self.split = splits_here(path)
        # the library's merges, for pieces that are normal and split already
        self.piece = Tokenizer.from_file(path)
        self.piece.normalizer = normalizers.Sequence([])
        self.piece.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.special = tuple(t.content for t in self.piece.get_added_tokens_decoder().values())
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @cached_property
    def library(self):  # noqa: ANN201
        """The library's own tokenizer, for texts that need all of it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _learn(self, pieces: list[bytes]) -> None:
        if len(self.new) + len(pieces) > REMEMBER:
            self.new, self.old = {}, self.new
        for at in range(0, len(pieces), _CALL):
            part = pieces[at : at + _CALL]
            # one sequence of many words: its ids and the word of each are two lists instead of an object for each word
            made = self.piece.encode([p.decode() for p in part], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(made.ids, "<u4").tobytes()
            ends = np.cumsum(np.bincount(np.array(made.word_ids), minlength=len(part)) * 4).tolist()
            self.new.update(zip(part, map(ids.__getitem__, map(slice, [0, *ends], ends)), strict=False))

    def _known(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of different pieces; the library is asked for those not remembered, together."""
        ids = list(map(self.new.get, pieces))
        if None in ids:
            held = [(i, self.old.get(pieces[i])) for i, v in enumerate(ids) if v is None]
            self._learn([pieces[i] for i, v in held if v is None])
            new = self.new
            for i, v in held:
                ids[i] = new[pieces[i]] if v is None else v
                new[pieces[i]] = ids[i]
        return ids

    def _split(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of texts in small letters that split at white space, at each digit, and where letters and other signs meet."""
        data = "\n".join(texts).encode() + b"\n"
        buf = np.frombuffer(data, np.uint8)
        kind = _KIND[buf]
        # of two bytes the second tells a sign from a letter, and both are of one kind
        sign = np.flatnonzero((buf[:-1] == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7)))
        kind[sign] = kind[sign + 1] = _SIGN
        change = kind[1:] != kind[:-1]
        begins, stops = np.ones(len(kind), bool), np.ones(len(kind), bool)
        digit = kind == _DIGIT
        begins[1:], stops[:-1] = change | digit[1:], change | digit[:-1]
        word = kind != 0
        starts, ends = np.flatnonzero(begins & word), np.flatnonzero(stops & word) + 1
        offsets = np.cumsum([0, *(len(t.encode()) + 1 for t in texts)])
        if not len(starts):
            yield from [b""] * len(texts)
            return
        _, at, inverse = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        own = self._known([data[x:y] for x, y in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        flat, before = np.frombuffer(b"".join(own), "<u4"), np.cumsum(size) - size
        n = size[inverse]
        upto = np.cumsum(n)
        ids = flat[np.repeat(before[inverse] - (upto - n), n) + np.arange(int(upto[-1]))]
        edge = np.concatenate([[0], upto])[np.searchsorted(starts, offsets)].tolist()
        for x, y in zip(edge, edge[1:]):
            yield ids[x:y].tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text in turn. Texts are split together, some of them at a time; long ones are cut at white space."""
        waiting: list[str] = []
        parts: list[int] = []
        size = 0
        for t in texts:
            if not self.split or not _PLAIN.fullmatch(t) or any(s in t for s in self.special):
                yield from self._joined(waiting, parts)
                waiting, parts, size = [], [], 0
                yield array("I", self.library.encode(t, add_special_tokens=False).ids).tobytes()
                continue
            t = t.lower()
            if _ENDING.search(t):
                own = [p.encode() for p in _PIECES.findall(t)]
                every = list(dict.fromkeys(own))
                known = dict(zip(every, self._known(every), strict=True))
                yield from self._joined(waiting, parts)
                waiting, parts, size = [], [], 0
                yield b"".join(map(known.__getitem__, own))
                continue
            cut = _cut(t)
            parts.append(len(cut))
            for part in cut:
                waiting.append(part)
                size += len(part)
            if size >= _TOGETHER:
                yield from self._joined(waiting, parts)
                waiting, parts, size = [], [], 0
        yield from self._joined(waiting, parts)

    def _joined(self, waiting: list[str], parts: list[int]) -> Iterator[bytes]:
        """Ids of the texts that wait, of each as many parts as it was cut into."""
        made = self._some(waiting)
        for n in parts:
            yield next(made) if n == 1 else b"".join(next(made) for _ in range(n))

    def _some(self, waiting: list[str]) -> Iterator[bytes]:
        lo = size = 0
        for i, part in enumerate(waiting):
            size += len(part)
            if size >= _TOGETHER or i == len(waiting) - 1:
                yield from self._split(waiting[lo : i + 1])
                lo, size = i + 1, 0


def _cut(text: str) -> list[str]:
    """A text in parts of about ``_TOGETHER`` characters, cut at white space; a longer run without it is one part."""
    if len(text) <= 2 * _TOGETHER:
        return [text]
    out, at = [], 0
    while at < len(text):
        gap = _GAP.search(text, at + _TOGETHER)
        end = gap.start() if gap else len(text)
        out.append(text[at:end])
        at = end
    return out


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; it lives until the worker turns to other work."""
    if path not in HELD:
        HELD[path] = Encoder(path)
    return HELD[path]
