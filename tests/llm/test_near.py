"""Near-duplicate classes, document fingerprints and line dedup against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import xxhash

from quill.llm import graph, lines, simhash


def texts(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 5, 60, 200]))] for _ in range(n // 4)]
    out = []
    for k in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            if words:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append((k, " ".join(words) if k % 7 else "\t".join(words).upper()))
    return out


def plain_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints, radius):
    up = list(range(len(prints)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                up[max(top(i), top(j))] = min(top(i), top(j))
    return [top(k) for k in range(len(prints))]


def test_near_classes(spark):
    rows = [*texts(240), (240, None), (241, ""), (242, "É É é"), (243, " Z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' as fp", "1 as node", "2 as component_id").repartition(3)
    prints = [plain_fingerprint(t) for _, t in rows]
    want = plain_classes(prints, 3)
    got = {r["doc_id"]: (simhash.hex_digits(bytes(r["fp"])), r["component_id"]) for r in simhash.near_classes(docs).collect()}
    assert got == {k: (f"{prints[k]:016x}", want[k]) for k in range(len(rows))}


def test_near_classes_odd_rows(spark):
    docs = spark.createDataFrame([(None, "one"), (None, None), (4, "a b c d"), (4, "a b c d"), (3, "a b c d")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_classes(docs).collect()), key=str)
    assert got == sorted([(None, None), (None, None), (4, 3), (4, 3), (3, 3)], key=str)
    assert simhash.near_classes(docs.limit(0)).count() == 0


def test_large_shard_is_dealt_out(spark, monkeypatch):
    """Many fingerprints that share a band: the shard is split, and every class is found."""
    monkeypatch.setattr(simhash, "SHARD", 64)
    rng = np.random.default_rng(3)
    low = rng.integers(0, 1 << 20, 500, dtype=np.uint64) << np.uint64(16)
    fps = np.unique(np.concatenate([low, low ^ (np.uint64(1) << rng.integers(20, 60, 500).astype(np.uint64))]))
    nodes = spark.createDataFrame([(int(f.astype(np.int64)), bytearray(f.astype("<u8").tobytes())) for f in fps], "node long, fp binary")
    got = {r["node"]: r["root"] for r in graph.components(simhash.block_links(nodes, 1, 4, 16, 3)).collect()}
    ints = [int(f) for f in fps]
    want = plain_classes(ints, 3)
    assert {k: v for k, v in got.items()} == {ints[k]: ints[w] for k, w in enumerate(want) if want.count(w) > 1}


def test_every_pair_of_a_large_front_is_linked(spark):
    """More fingerprints with one front than are compared bit by bit, and pairs that only this front's table can find."""
    rng = np.random.default_rng(12)
    base = np.unpackbits(rng.integers(0, 256, (600, 16), dtype=np.uint8), axis=1, bitorder="little")
    base[:, :32] = 0
    pair = base.copy()
    for block in (1, 2, 3):
        pair[np.arange(600), 32 * block + rng.integers(0, 32, 600)] ^= 1
    fps = np.packbits(np.concatenate([base, pair]), axis=1, bitorder="little").view("<u8")
    found = {tuple(sorted((int(i), int(j)))) for a, b in simhash.shard_links(fps, fps[:0], ~np.zeros(2, dtype=np.uint64), 3) for i, j in zip(a, b, strict=True)}
    assert found == {(k, 600 + k) for k in range(600)}
    nodes = spark.createDataFrame([(k, bytearray(f.tobytes())) for k, f in enumerate(fps)], "node long, fp binary").repartition(3)
    got = {r["node"]: r["root"] for r in graph.components(simhash.within(nodes, 3)).collect()}
    assert got == {k: k % 600 for k in range(1200)}


def test_every_pair_of_a_wide_radius_is_linked():
    """The pipeline's radius: a dense group and unlike texts in one front, against comparing all."""
    rng = np.random.default_rng(13)
    bits = np.concatenate([np.arange(512) < np.arange(300)[:, None], rng.integers(0, 2, (150, 512))]).astype(np.uint8)
    fps = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    want = {(i, j) for i, j in zip(*np.nonzero(simhash.hamming(fps[:, None], fps[None]) <= 102), strict=True) if i > j}
    found = {(max(i, j), min(i, j)) for a, b in simhash.shard_links(fps, fps[:0], ~np.zeros(8, dtype=np.uint64), 102) for i, j in zip(a, b, strict=True)}
    assert found == want and len(want) > 10_000


def crowd(n, seed=4):
    """Fingerprints in clusters of all densities: spread ones, close pairs, and one dense group."""
    rng = np.random.default_rng(seed)
    spread = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    close = spread[: n // 2].copy()
    for _ in range(2):
        close ^= np.uint64(1) << rng.integers(0, 64, len(close)).astype(np.uint64)
    dense = spread[0] ^ sum(np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64) for _ in range(5))
    chain = [int(spread[1])]
    for k in range(60):
        chain.append(chain[-1] ^ (7 << k))
    return np.unique(np.concatenate([spread, close, dense, np.array(chain, dtype=np.uint64)]))[:, None]


def test_shards_and_their_guests_find_every_pair():
    """Each pair within the radius meets in a shard of one of the two trees, and the shard's own search finds it."""
    fps = crowd(700)
    want = {(i, j) for i, j in zip(*np.nonzero(simhash.hamming(fps[:, None], fps[None]) <= 3), strict=True) if i > j}
    found, lived, copies = set(), 0, 0
    for half in simhash.halves(1):
        root, leaves = simhash.tree(fps[::3], half, 3, 24)
        assert leaves > 10
        for _, home, guest in simhash.routed(root, fps):
            lived, copies = lived + len(home), copies + len(guest)
            every = np.concatenate([home, guest])
            for a, b in simhash.shard_links(fps[home], fps[guest], half, 3):
                found |= {(max(i, j), min(i, j)) for i, j in zip(every[a], every[b], strict=True)}
    assert found == want and lived == 2 * len(fps) and 0 < copies < 40 * len(fps)


def test_vantage_links_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 64)
    monkeypatch.setattr(simhash, "SAMPLES_A_LEAF", 8)
    monkeypatch.setattr(simhash, "LEAF", 8)
    fps = crowd(500, 9)
    nodes = spark.createDataFrame([(k, bytearray(f.astype("<u8").tobytes())) for k, f in enumerate(fps)], "node long, fp binary").repartition(4)
    got = {r["node"]: r["root"] for r in graph.components(simhash.vantage_links(nodes, 1, 3)).collect()}
    want = plain_classes([int(f[0]) for f in fps], 3)
    assert got == {k: w for k, w in enumerate(want) if want.count(w) > 1}


def test_stars_and_forests_agree():
    rng = random.Random(7)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]
    a, b = (np.array(x) for x in zip(*pairs, strict=True))
    assert dict(zip(*(x.tolist() for x in graph.stars(a, b)), strict=True)) == dict(graph.forest(pairs))


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(40)]
    star = [(1000, 1001 + k) for k in range(300)]
    edges = spark.createDataFrame([*chain, *star, (5, 5), (5, 4), (2000, 2000)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {1000 + k: 1000 for k in range(301)} | {2000: 2000}
    assert graph.components(edges.limit(0)).count() == 0


def test_components_of_shuffled_chains_take_few_rounds(spark, monkeypatch):
    """Chains whose nodes come in any order, or fall and rise, end in about as many rounds as their length has binary digits."""
    n, written, write = 1000, [], graph.common.materialise
    monkeypatch.setattr(graph.common, "materialise", lambda df, name: written.append(name) or write(df, name))
    shuffled = random.Random(3).sample(range(n), n)
    vee = [*range(n, 2 * n, 2), *range(2 * n - 1, n, -2)]
    edges = spark.createDataFrame([(c[k], c[k + 1]) for c in (shuffled, vee) for k in range(n - 1)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert got == {k: k // n * n for k in range(2 * n)}
    assert written.count("labels") <= 1 + 2 * 14


def test_set_links_are_stars():
    """Sets that only a chain of pairs connects are one class, whose edges all leave its first set."""
    sets = [np.arange(k, k + 50) for k in range(0, 120, 4)]
    assert sorted(simhash.set_links([*sets, np.arange(900, 950)], 0.8)) == [(0, k) for k in range(1, 30)]


def plain_mark(text, n=3):
    """128 bits, by voting on each term's hash and on a mix of it."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    runs = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
    top = (1 << 64) - 1
    out = 0
    for lane in range(2):
        hashes = []
        for r in runs:
            z = xxhash.xxh64_intdigest(r.encode(), seed=42)
            if lane:
                z = z + 0x9E3779B97F4A7C15 & top
                z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & top
                z = (z ^ z >> 27) * 0x94D049BB133111EB & top
                z ^= z >> 31
            hashes.append(z)
        out |= sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << 64 * lane
    return out


def test_near_marks(spark):
    """op7's block tables give the classes that comparing all fingerprints gives, repeated rows and null ids included."""
    rng = np.random.default_rng(2)
    prints = [int.from_bytes(rng.bytes(16), "little") for _ in range(60)]
    prints += [p ^ sum(1 << int(b) for b in rng.choice(128, k, replace=False)) for p in prints[:30] for k in (0, 2, 3, 4)]
    rows = [(None if k == 7 else 1000 - k, f"{p:032x}", "x") for k, p in enumerate(prints)] + [(1000, f"{prints[0]:032x}", "y")]
    marks = spark.createDataFrame(rows, "doc_id long, fingerprint string, near_next string").repartition(3)
    ints = [int(r[1], 16) for r in rows]
    want = plain_classes(ints, 3)
    least = {}
    for w, r in zip(want, rows, strict=True):
        least[w] = min((x for x in (least.get(w), r[0]) if x is not None), default=None)
    got = sorted(map(str, (tuple(r) for r in simhash.near_marks(marks, 3).collect())))
    assert got == sorted(str((*r, least[w])) for w, r in zip(want, rows, strict=True))
    assert simhash.near_marks(marks.limit(0)).count() == 0


def test_document_marks(spark):
    rows = [(2, "abc def ghi jkl " * 20), (None, "first of all"), (3, None), (9, "x" * 41), (10, "abc def ghi jkl " * 20), (11, ""), (4, "é😀" * 30), (20, "last one here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as kind", "3 as tie").repartition(3)
    got = {r["doc_id"]: r for r in simhash.document_marks(docs).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    assert len(got) == len(rows)
    for k, (doc, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        m = len(text) // 4
        new = text[: len(text) - m] + after[:m]
        assert got[doc]["n_chars"] == len(text)
        assert got[doc]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert 0 <= got[doc]["near_edited"] <= 1 and 0 <= got[doc]["near_next"] <= 1
        for column, t in (("fingerprint", text), ("edited_fingerprint", new)):
            assert got[doc][column] == f"{plain_mark(t):032x}"
        for column, t in (("near_edited", new), ("near_next", after)):
            far = (plain_mark(text) ^ plain_mark(t)).bit_count()
            assert abs(got[doc][column] - max(0.0, math.cos(math.pi * far / 128))) < 1e-12
    assert got[2]["fingerprint"] == got[10]["fingerprint"] and got[2]["near_edited"] > 0.8
    alone = simhash.document_marks(docs.filter("doc_id = 2")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0
    assert simhash.document_marks(docs.limit(0)).count() == 0


def test_within_radius(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, (40, 2), dtype=np.uint64)
    rows = [base]
    for bits in (1, 3, 6, 7):
        flipped = np.unpackbits(base.view(np.uint8).reshape(40, 16), axis=1)
        flipped[:, rng.choice(128, bits, replace=False)] ^= 1
        rows.append(np.packbits(flipped, axis=1).view(np.uint64))
    fps = np.concatenate(rows)
    nodes = spark.createDataFrame([(k, bytearray(f.tobytes())) for k, f in enumerate(fps)], "node long, fp binary")
    got = {r["node"]: r["root"] for r in graph.components(simhash.within(nodes, 6)).collect()}
    ints = [int.from_bytes(f.tobytes(), "little") for f in fps]
    want = plain_classes(ints, 6)
    assert got == {k: w for k, w in enumerate(want) if want.count(w) > 1}


def plain_lines(rows, least):
    """Lines covered by a run of at least so many words that stands somewhere earlier, by trying all runs."""
    split = [(t or "").split("\n") for _, t in rows]
    seen, gone = set(), [set() for _ in rows]
    for d, ls in enumerate(split):
        for i in range(len(ls)):
            for j in range(i + 1, len(ls) + 1):
                run = tuple(ls[i:j])
                if sum(len(x.split()) for x in run) >= least:
                    if run in seen:
                        gone[d].update(range(i, j))
                    seen.add(run)
    return ["\n".join(x for k, x in enumerate(ls) if k not in g) if t is not None else None for (_, t), ls, g in zip(rows, split, gone, strict=True)]


def test_line_dedup(spark):
    rng = random.Random(8)
    pool = ["", "a b c", "one two three four", "x", "lorem ipsum dolor sit", "p q", "  ", "alpha beta"]
    rows = [(k, "\n".join(rng.choice(pool) if rng.random() < 0.8 else f"own {rng.random()} line" for _ in range(rng.randint(0, 14)))) for k in range(60)]
    rows += [(60, None), (61, ""), (62, rows[3][1]), (63, "one long line of words " * 5), (64, "tail\n" + "one long line of words " * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "cast(length(text) as long) as n_chars", "1 as start", "2 as __x", "3 as high").repartition(3)
    shorter = [len((t or "").split("\n")) for t in plain_lines(rows, 0)]
    for least in (0, 1, 4, 7, 12):
        found = lines.remove_repeats(docs, least).collect()
        want = plain_lines(rows, least)
        assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in found} == {k: (t, None if t is None else len(t)) for (k, _), t in zip(rows, want, strict=True)}
        for r in found:
            whole, left = rows[r["doc_id"]][1], shorter[r["doc_id"]]
            if whole is not None and r["n_repeated"] < r["n_lines"]:
                assert r["n_repeated"] == r["n_lines"] - left
    assert lines.remove_repeats(docs.limit(0)).count() == 0


def test_suffix_ranks_are_the_suffix_array(spark):
    """At each depth: who stands elsewhere too, who is equal, and the order of all suffixes, by comparing them."""
    rng = random.Random(3)
    texts_ = [[rng.randrange(3) for _ in range(rng.randint(1, 12))] for _ in range(25)]
    ids = {v: (rng.randrange(-99, 99), rng.randrange(-99, 99)) for v in range(3)}
    rows = [(1, d, 0, i, len(t), *ids[v]) for d, t in enumerate(texts_) for i, v in enumerate(t)]
    table = spark.createDataFrame(rows, "known int, doc long, tie long, i int, n int, high long, low long").repartition(3)
    levels = lines.suffix_ranks(table, 8)
    assert len(levels) == 4
    for k, (level, _) in enumerate(levels):
        prefix = {(d, i): [ids[v] for v in t[i : i + 2**k]] for d, t in enumerate(texts_) for i in range(len(t))}
        often = {p: sum(x == q for q in prefix.values()) for p, x in prefix.items()}
        got = {(r["doc"], r["i"]): r["rank"] for r in level.collect()}
        assert set(got) == {p for p, n in often.items() if n > 1}
        ranks = sorted(set(got.values()))
        order = sorted({tuple(prefix[p]) for p in got})
        assert {p: ranks.index(r) for p, r in got.items()} == {p: order.index(tuple(prefix[p])) for p in got}


def test_line_dedup_odd_rows(spark):
    """Null ids come first, repeated rows share a result, one doc_id may have several texts, and a third of all rows may be equal."""
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(None, long), (5, long + "\nown"), (5, "other\n" + long), (5, "other\n" + long), (7, None), (None, None)] + [(9, long)] * 12
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as n_lines", "3 as known", "4 as rank").repartition(4)
    found = lines.remove_repeats(docs)
    assert found.columns == ["doc_id", "text", "known", "rank", "n_lines", "n_removed", "n_repeated"]
    got = sorted(((r["doc_id"], r["text"], r["n_removed"], r["n_repeated"]) for r in found.collect()), key=str)
    want = [(None, long, 0, 0), (5, "own", 1, 1), (5, "other", 1, 1), (5, "other", 1, 1), (7, None, 0, 0), (None, None, 0, 0)] + [(9, "", 1, 1)] * 12
    assert got == sorted(want, key=str)
