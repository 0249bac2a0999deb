"""Byte-level BPE by a token automaton: merges become gadgets, words run through its tables, labels decode."""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quill.llm import common

CACHE_WORDS = 300_000
LONG_WORD = 64
PAIRS = 2_000_000
#: Byte states after which the transition table starts anew; a word's own states may come on top.
STATES = 150_000
_SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: White space is split as the vocabulary's rule does it; runs of other characters, with a blank before, are split further.
_CHUNKS = re.compile(f" ?[^{_SPACES}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
_automata: dict[str, Automaton] = {}


def _letters() -> dict[str, int]:
    """The characters that stand for bytes in vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    """A deterministic automaton over tokens that accepts exactly the token sequences that the merges leave, and its byte tables.

    It starts as one state with an arc for each byte. The gadget of merge k, (a, b) -> c, splits the state behind a from its
    likes and takes its arc b away at k; gives every state with an arc a an arc c beside it; and lets c end where b ends, in
    a fork of that state as it was before k. Each state is thus the state behind one last token. A state is kept as what it
    was forked from and when, an arc as what it was added beside and when, and an arc's removal as its time, so the automaton
    takes space in proportion to the merges; arc() resolves an arc along these records.

    Exactly one accepted token sequence spells a word, its encoding, and so does one for each of its prefixes. So the
    automaton composed with the labels' spelling is deterministic over bytes: a byte state holds, for each place from which a
    token is still being spelled, the spelling's node and the token state at that place, and names the one token that ends
    here. run() makes one look-up in the transition table a byte; rows of the table are filled when a word first comes to
    them, as all words have infinitely many, and the table starts anew at STATES states. The accepted sequence is read off
    backwards from the tokens that ended at each place; nothing is tried twice.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _letters()
        if model["type"] != "BPE" or model.get("end_of_word_suffix") or model.get("ignore_merges") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE vocabulary without normaliser or word ends is needed")
        vocab = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels: list[bytes] = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for text, k in vocab.items():
            self.labels[k] = bytes(letters[c] for c in text)
        for text, k in special.items():
            self.labels[k] = text.encode()
        self.special = special
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        n = len(self.labels)
        self.born = [-1] * n
        self.left, self.right = [-1] * n, [-1] * n
        self.removed: dict[int, int] = {}
        self.n = n
        self._compile(vocab, model["merges"])
        ordinary = set(vocab.values())
        self.alone: dict[int, bool] = {}
        self.token = {self.labels[k]: k for k in sorted(ordinary, key=self.born.__getitem__) if (self.born[k] >= 0 or len(self.labels[k]) == 1) and self._made(k)}
        self.steps: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for label, k in self.token.items():
            at = 0
            for byte in label:
                at = self.steps.setdefault(at << 8 | byte, len(self.ends))
                if at == len(self.ends):
                    self.ends.append(-1)
            self.ends[at] = k
        self.leads = {key >> 8 for key in self.steps}
        self.arcs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self._clear()
        import regex

        self.rule = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def _compile(self, vocab: dict[str, int], merges: list) -> None:
        """One gadget a merge, in order."""
        for k, pair in enumerate(merges):
            x, y = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = vocab[x], vocab[y], vocab[x + y]
            if self.born[a] >= k or self.born[b] >= k or self.left[c] >= 0:
                raise ValueError(f"merge {k} comes before its parts, or makes a token again")
            self.removed[a * self.n + b] = k
            self.left[c], self.right[c], self.born[c] = a, b, k

    def arc(self, x: int, y: int) -> bool:
        """Whether the state behind token x has an arc y."""
        key = x * self.n + y
        found = self.arcs.get(key)
        if found is None:
            found = self._resolve(x, y, 1 << 60)
            if len(self.arcs) >= PAIRS:
                self.arcs.clear()
            self.arcs[key] = found
        return found

    def _resolve(self, x: int, y: int, until: int) -> bool:
        """The arc y of the state behind x once merges up to the time until are in, along the gadgets' records."""
        born, removed, n = self.born, self.removed, self.n
        while True:
            gone = removed.get(x * n + y)
            if gone is not None and gone <= until:
                return False
            bx, by = born[x], born[y]
            if bx < 0 and by < 0:
                return True
            if by > bx:
                y, until = self.left[y], by  # the arc stands beside its left part's, once that merge is in
            elif bx > by:
                x, until = self.right[x], bx - 1  # the state is a fork of its right part's, before that merge
            else:
                x, y, until = self.right[x], self.left[y], bx - 1

    def _clear(self) -> None:
        """The byte automaton's start: nothing is spelled yet, and any token may come."""
        self.states: dict[tuple, int] = {((0, -1),): 0}
        self.holds: list[tuple] = [((0, -1),)]
        self.last: list[int] = [-1]
        self.table: dict[int, int] = {}

    def _fill(self, state: int, byte: int) -> int:
        """One entry of the transition table: the byte state that a byte leads to."""
        steps, ends, places, token = self.steps, self.ends, [], -1
        for node, before in self.holds[state]:
            to = steps.get(node << 8 | byte)
            if to is None:
                continue
            t = ends[to]
            if t >= 0 and (before < 0 or self.arc(before, t)):
                token = t
            if to in self.leads:
                places.append((to, before))
        if token < 0:
            raise ValueError("a byte without a token")
        key = (*places, (0, token))
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.holds)
            self.holds.append(key)
            self.last.append(token)
        self.table[state << 8 | byte] = to
        return to

    def run(self, word: bytes) -> list[int]:
        """The ids of one word: a look-up a byte, then the tokens' labels back from the word's end."""
        if len(self.holds) > STATES:
            self._clear()
        table, state, path = self.table, 0, []
        for byte in word:
            to = table.get(state << 8 | byte)
            if to is None:
                to = self._fill(state, byte)
            state = to
            path.append(to)
        out, at, last, labels = [], len(word), self.last, self.labels
        while at:
            t = last[path[at - 1]]
            out.append(t)
            at -= len(labels[t])
        return out[::-1]

    def _made(self, t: int) -> bool:
        """Whether a token's gadget added any arc: its parts are made, and the state behind the left had the right's arc by then."""
        known = self.alone.get(t)
        if known is None:
            k = self.born[t]
            known = k < 0 or (self._made(self.left[t]) and self._made(self.right[t]) and self._resolve(self.left[t], self.right[t], k - 1))
            self.alone[t] = known
        return known

    def _learn(self, chunk: str) -> bytes:
        """The ids of a new chunk, by its words; both are kept unless they are long."""
        words, out = self.words, []
        if len(words) >= CACHE_WORDS:
            words.clear()
        for w in self.rule.findall(chunk):
            ids = words.get(w)
            if ids is None:
                raw = self.run(w.encode())
                ids = struct.pack(f"<{len(raw)}I", *raw)
                if len(w) <= LONG_WORD:
                    words[w] = ids
            out.append(ids)
        ids = b"".join(out)
        if len(chunk) <= LONG_WORD:
            words[chunk] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """A text's ids as little-endian 32-bit integers; names of special tokens in it are those tokens."""
        if not text:
            return b""
        words, out = self.words, []
        for k, part in enumerate(self.marks.split(text) if self.marks else [text]):
            if k % 2:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            for chunk in _CHUNKS.findall(part):
                ids = words.get(chunk)
                if ids is None:
                    ids = self._learn(chunk)
                out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs in turn; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def automaton(path: str) -> Automaton:
    """This worker's automaton of a vocabulary file, with the words it has met."""
    if path not in _automata:
        _automata[path] = Automaton(path)
    return _automata[path]


def _round_trips(batches: Iterable[pa.RecordBatch], path: str, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    a = automaton(path)
    for part in common.rows_of(batches):
        rows = []
        for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            ids = a.encode(text)
            rows.append((doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(a.decode(ids).encode()).hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


def _tokens(batches: Iterable[pa.RecordBatch], path: str, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    a = automaton(path)
    for part in common.rows_of(batches):
        ids = [np.frombuffer(a.encode(t), "<u4").tolist() for t in part.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, type=arrow[1].type)], schema=arrow)


def _texts(batches: Iterable[pa.RecordBatch], path: str, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    a = automaton(path)
    for part in common.rows_of(batches):
        texts = [a.decode(np.array(ids or [], dtype="<u4").tobytes()) for ids in part.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, type=pa.string())], schema=arrow)


def _mapped(df: DataFrame, f, schema: str, path: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    common.ship(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(lambda b: f(b, path, arrow), schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of each whole text. Null and empty texts have no ids; rows stay as many, repeated ones too; other columns are left out."""
    return _mapped(docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")), _tokens, "doc_id long, ids array<int>", path)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and text of each row of ids; null ids give an empty text."""
    return _mapped(tokens.select(tokens["doc_id"].cast("long"), tokens["ids"].cast("array<int>")), _texts, "doc_id long, text string", path)


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """Digests of each whole text's ids and of the text decoded from them. Null and empty texts: no ids, the empty text's digests."""
    return _mapped(docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")), _round_trips, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", path)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(common.table(spark, sf_dir, "documents"), f"{common.TOKENIZERS}/byte_bpe_50k.json")
