"""Ids of whole texts by the tokenizers library, at the cost of one library call per distinct word."""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from collections.abc import Sequence

import numpy as np

#: Control characters that str.split() takes for white space and the library doesn't.
_CONTROL = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")

def _class(kind: str) -> str:
    """The Latin characters of a kind, for a pattern's brackets."""
    return "".join(re.escape(chr(c)) for c in range(33, 0x250) if unicodedata.category(chr(c))[0] == kind)


def _stays(c: str) -> bool:
    """Whether a character lower-cases to one letter of its own range, so that the word rule's classes below hold afterwards."""
    return len(c.lower()) == 1 and ord(c.lower()) < 0x250 and unicodedata.normalize("NFC", c) == c


#: Latin texts: normalisation leaves them alone, and their letters lower-case one by one without leaving the range.
_LATIN = re.compile("[\t-\r -~\x85" + "".join(re.escape(chr(c)) for c in range(0xA0, 0x250) if c not in (0xAD, 0x131) and _stays(chr(c))) + "]*")
#: The vocabulary's own rule for words, after lower-casing, for Latin texts.
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^\\s{_class('L')}{_class('N')}]+")
_VISIBLE = re.compile("[!-~]+")
CACHE_WORDS = 400_000
LONG_WORD = 64
#: The letters that stand for bytes in vocabulary files: printable Latin-1 stands for itself, the rest follows from U+0100.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: b for b in _PRINTABLE} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}
_encoders: dict[str, WordIds] = {}


class _Parts(dict):
    """Ids of words, found out when first asked for; it starts anew when it's full."""

    def __init__(self, find):
        self.find = find

    def __missing__(self, word: str) -> bytes:
        ids = self.find(word)
        if len(word) <= LONG_WORD:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


class WordIds:
    """For a tokenizer that drops white space, so that the ids of a text are those of its white-space-free chunks in turn.

    The words of a Latin text go straight to the library's model. Of other texts, a batch's unknown chunks are encoded by
    one call, between marks that no chunk contains. Long words and chunks aren't kept.
    """

    MARK = "\x00"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.vocab_size <= 1 << 16 else "<u4")
        self.kind = "HI"[self.dtype.itemsize == 4]
        self.known: dict[str, bytes] = {}
        self.parts = _Parts(self._part_ids)
        self.plain = self._is_plain(path)
        mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    @staticmethod
    def _is_plain(path: str) -> bool:
        """Whether the file's normaliser and word rule are those that _part_ids() applies itself."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        rules = [x.get("pattern", {}).get("Regex") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        word_rule = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        return steps == ["NFC", "Replace", "Lowercase"] and rules == [word_rule, None]

    def _part_ids(self, part: str) -> bytes:
        shown = part if _VISIBLE.fullmatch(part) else part.encode().decode("latin-1").translate(_BYTE_LETTERS)
        ids = [t.id for t in self.tokenizer.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}{self.kind}", *ids)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        joined = [w for w in words if self.mark is not None and self.MARK not in w]
        new = {w: self._ids(w).tobytes() for w in words.difference(joined)}
        for k in range(0, len(joined), 20_000):
            part = joined[k : k + 20_000]
            ids = self._ids(f" {self.MARK} ".join(part))
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(part) - 1:
                raise ValueError("the tokenizer doesn't keep marks apart")
            raw, size = ids.tobytes(), self.dtype.itemsize
            ends = [*(cuts * size).tolist(), len(raw)]
            starts = [0, *((cuts + 1) * size).tolist()]
            new.update(zip(part, (raw[a:b] for a, b in zip(starts, ends, strict=True)), strict=True))
        return new

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Each text's ids as little-endian bytes of self.dtype; a null text is empty."""
        out: list[bytes] = [b""] * len(texts)
        chunks: dict[int, list[str]] = {}
        part_ids = self.parts.__getitem__
        for k, t in enumerate(texts):
            if not t:
                continue
            if self.plain and _LATIN.fullmatch(t) and "<|" not in t:
                out[k] = b"".join(map(part_ids, _PARTS.findall(t.lower())))
            else:
                chunks[k] = _SPACE.split(t) if _CONTROL.search(t) else t.split()
        if chunks:
            known = self.known
            every = set().union(*chunks.values())
            every.discard("")
            new = {w for w in every if w not in known}
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
                new = every
            if new:
                known.update(self._learn(new))
            known[""] = b""
            for k, words in chunks.items():
                out[k] = b"".join(map(known.__getitem__, words))
            for w in [w for w in new if len(w) > LONG_WORD]:
                known.pop(w, None)
        return out


def encoder(path: str) -> WordIds:
    """This worker's encoder of a vocabulary file, with what it has learned."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]
