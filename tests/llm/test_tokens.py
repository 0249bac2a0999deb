"""Packing, the BPE automaton and token files against the tokenizers library and round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quill.llm import bpe, packing, rans
from quill.llm.word_ids import WordIds

WORD, BYTE = "/opt/tokenizers/word_bpe_49k.json", "/opt/tokenizers/byte_bpe_50k.json"
ALPHABET = ["a", "B", "é", "é", " ", "\n", "\x1c", "\x85", "　", "\x00", "<|endoftext|>", "<|startoftext|>", "'s", "7", "٣", "İ", "ß", "漢", "!!", ".", "̸", "Σ", " ", "😀", "​", " the", "ing"]
ROWS = [(5, "one two three"), (1, None), (2, ""), (9, "word " * 9000), (5, "one two three"), (None, "no id"), (7, " <|endoftext|> x"), (3, "é漢字\n\n tab\t")]


def strings(n, seed=3, most=12):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most))) for _ in range(n)]


def frame(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "'x' as start", "1 as sequence_id", "'y' as tie", "'z' as ids")


def test_word_ids_are_the_librarys():
    own, lib = WordIds(WORD), Tokenizer.from_file(WORD)
    texts = strings(1500) + ["", None, "word-" * 500]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, own.dtype).tolist() == lib.encode(t or "", add_special_tokens=False).ids


def test_word_ids_of_every_latin_character():
    """Each character of the quick path, upper and lower, beside marks, digits and letters."""
    own, lib = WordIds(WORD), Tokenizer.from_file(WORD)
    texts = []
    for c in {x for k in range(0x250) for x in (chr(k), chr(k).upper(), chr(k).lower())}:
        texts += [f"'{c}", f"d'{c}tat", f'"{c}a"', f"({c}li)", f".{c}", f"-{c}-", f"a{c}b", f"7{c}7", f"{c}{c}'s", f" {c} ", f"A{c}(B"]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, own.dtype).tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_word_ids_of_random_strings_over_all_planes():
    own, lib = WordIds(WORD), Tokenizer.from_file(WORD)
    rng = random.Random(11)
    reach = [0x80, 0x250, 0x600, 0x3000, 0xD800, 0x110000]
    texts = []
    for _ in range(100_000):
        top = rng.choice(reach)
        texts.append("".join(chr(k) if not 0xD800 <= (k := rng.randrange(top if rng.random() < 0.7 else 0x80)) < 0xE000 else "x" for _ in range(rng.randint(1, 8))))
    wrong = [t for k in range(0, len(texts), 5000) for t, ids, e in zip(texts[k : k + 5000], own.encode(texts[k : k + 5000]), lib.encode_batch(texts[k : k + 5000], add_special_tokens=False), strict=True) if np.frombuffer(ids, own.dtype).tolist() != e.ids]
    assert not wrong, wrong[:5]


def test_automaton_is_the_librarys():
    own, lib = bpe.Automaton(BYTE), Tokenizer.from_file(BYTE)
    rng = random.Random(1)
    texts = strings(1500) + ["".join(rng.choice("etaoin shrdlu") for _ in range(rng.randint(0, 40))) for _ in range(500)] + ["=" * 300, "aaaa" * 50]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids
        assert own.decode(own.encode(t)) == lib.decode(ids, skip_special_tokens=False)


def test_gadgets_leave_exactly_the_merged_sequences():
    """Arcs between all pairs of tokens of a small vocabulary against merging by hand."""
    import json
    import tempfile

    merges = [["a", "b"], ["b", "c"], ["a", "a"], ["ab", "c"], ["aa", "b"], ["c", "c"], ["bc", "c"]]
    vocab = {c: k for k, c in enumerate("abc")}
    for x, y in merges:
        vocab[x + y] = len(vocab)
    spec = {"model": {"type": "BPE", "vocab": vocab, "merges": merges}, "added_tokens": [], "normalizer": None}
    with tempfile.NamedTemporaryFile("w", suffix=".json") as f:
        json.dump(spec, f)
        f.flush()
        a = bpe.Automaton(f.name)

    def merged(text):
        parts = list(text)
        for x, y in merges:
            k = 0
            while k < len(parts) - 1:
                if parts[k] == x and parts[k + 1] == y:
                    parts[k : k + 2] = [x + y]
                k += 1
        return parts

    rng = random.Random(5)
    for _ in range(2000):
        t = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        assert [a.labels[k].decode() for k in a.run(t.encode())] == merged(t)


def test_the_byte_table_is_deterministic_and_bounded(monkeypatch):
    a = bpe.Automaton(BYTE)
    word = "unbelievabilities".encode() * 3
    first, size = a.run(word), len(a.table)
    assert a.run(word) == first and len(a.table) == size  # every step is in the table by then
    state = 0
    for byte in word:
        state = a.table[state << 8 | byte]
    assert a.last[state] == first[-1]
    monkeypatch.setattr(bpe, "STATES", 10)
    assert a.run(word) == first and a.run(b"x") and len(a.holds) <= 2 and a.run(word) == first


def test_round_trips(spark):
    lib = Tokenizer.from_file(BYTE)
    got = sorted(map(tuple, bpe.round_trips(frame(spark), BYTE).collect()), key=str)
    want = []
    for doc, t in ROWS:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.round_trips(frame(spark).limit(0), BYTE).count() == 0
    again = bpe.decode(bpe.encode(frame(spark), BYTE), BYTE).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in again) == sorted((str(d), t or "") for d, t in ROWS)


def test_best_fill_is_the_best():
    from collections import Counter
    from itertools import product

    rng = random.Random(2)
    for _ in range(200):
        count = Counter(rng.choices(range(1, 20), k=rng.randint(0, 6)))
        room = rng.randint(1, 40)
        taken = packing.best_fill(count, room)
        assert all(0 < k <= count[n] for n, k in taken.items())
        best = max(s for s in (sum(n * k for n, k in zip(count, ks, strict=True)) for ks in product(*(range(c + 1) for c in count.values()))) if s <= room)
        assert sum(n * k for n, k in taken.items()) == best


def test_packing_keeps_every_id_once(spark):
    rows = [*ROWS, *((100 + k, "some words here " * (k % 97)) for k in range(400))]
    got = packing.pack(frame(spark, rows).repartition(3), WORD, 2).collect()
    lib = Tokenizer.from_file(WORD)
    ids = {}
    for doc, t in rows:
        ids.setdefault(doc, []).append(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    size = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == size.get(r["sequence_id"], 0) and r["length"] > 0
        size[r["sequence_id"]] = r["offset"] + r["length"]
        own = [x for x in ids[r["doc_id"]] if len(x) == r["doc_tokens"]]
        assert any(zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in own)
    for doc, all_ids in ids.items():
        assert sum(r["length"] for r in got if r["doc_id"] == doc) == sum(map(len, all_ids))
    assert max(size.values()) <= packing.CAPACITY
    assert all(n == packing.CAPACITY or n & (n - 1) == 0 for n in size.values())
    assert packing.pack(frame(spark).limit(0), WORD, 2).count() == 0


@pytest.mark.parametrize("n,lanes,every", [(1, 512, 128), (511, 512, 1), (5000, 16, 8), (70001, 512, 16)])
def test_rans_round_trip_and_checkpoints(n, lanes, every):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 5000).astype("<u4")
    table = rans.Table(np.bincount(ids, minlength=5000))
    raw = rans.encode_block(ids, table, lanes, every)
    assert rans.decode_block(raw, table).tolist() == ids.tolist()
    own = min(lanes, n)
    for k in range(1, (-(-n // own) - 1) // every + 1):
        assert rans.decode_block(raw, table, k).tolist() == ids[k * every * own :].tolist()
    broken = bytearray(raw)
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        rans.decode_block(bytes(broken), table)


def test_rans_is_small():
    rng = np.random.default_rng(0)
    ids = (rng.zipf(1.5, 200_000) % 3000).astype("<u4")
    counts = np.bincount(ids)
    p = counts[counts > 0] / len(ids)
    entropy = -(p * np.log2(p)).sum() * len(ids) / 8
    assert len(rans.encode_block(ids, rans.Table(counts), 512, 1 << 30)) < 1.02 * entropy + 8 * 512 + 100


def test_token_file(spark):
    lib = Tokenizer.from_file(WORD)
    file = rans.write(frame(spark), WORD, 1, shard=1000)
    got = sorted((r["start"], str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in file.digests().collect())
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0]))
    at, want = 0, []
    for doc, t in order:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((at, str(doc), len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert [r["start"] for r in sorted(file.documents().collect(), key=lambda r: r["start"])] == [w[0] for w in want]
    assert rans.write(frame(spark).limit(0), WORD, 1).digests().count() == 0
