"""WARC, exact search, language and toxicity."""

import hashlib
import random

import numpy as np

from quill.llm import langid, topk, toxicity, warc


def test_warc_salvage():
    pages = [(k, f"<p>{k}</p>" * (k * 7)) for k in range(12)]
    parts = [warc.member(warc.record("response", f"http://x/{k}", k, hashlib.sha256(h.encode()).hexdigest(), len(h), h.encode())) for k, h in pages]
    raw = b"".join(parts)
    clean = warc.read(raw)
    assert [r.page for r in clean.records] == list(range(12)) and not clean.gaps
    starts = np.cumsum([0, *map(len, parts)])
    broken = bytearray(raw)
    broken[starts[4] + 30] ^= 0xFF
    del broken[starts[8] : starts[8] + 5]
    got = warc.read(bytes(broken))
    assert [r.page for r in got.records] == [0, 1, 2, 3, 5, 6, 7, 9, 10, 11]
    assert [g[0] for g in got.gaps] == [starts[4], starts[8]] and got.gaps[0][1] == starts[5]
    plain = [warc.record("response", None, k, hashlib.sha256(h.encode()).hexdigest(), len(h), h.encode()) for k, h in pages]
    text = bytearray(b"junk" + b"".join(plain))
    at = text.index(plain[5]) + len(plain[5]) - 10
    text[at] ^= 1
    got = warc.read(bytes(text))
    assert [r.page for r in got.records] == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11] and got.gaps[0][:2] == (0, 4) and len(got.gaps) == 2
    assert warc.read(raw[: starts[3] + 9]).gaps[0][:2] == (starts[3], starts[3] + 9)
    assert warc.read(b"").records == [] and warc.read(b"").gaps == []


def test_warc_table(spark):
    long, rows = "é" * 80, []
    rows = [(7, "http://a", long), (3, None, long), (5, "http://b\r\nX: y", long), (4, "u", "short"), (6, "u", "short"), (8, "u", None), (9, "u", ""), (3, "again", long), (None, "u", long), (10, "u", "z" * 100), (11, "u", "z" * 99), (12, "u", "z" * 99)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'d' as digest", "1 as first").repartition(3)
    got = sorted(map(tuple, warc.digests(warc.write(pages)).collect()), key=str)
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        again = html == long and page not in (3, None)
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert got == sorted(want, key=str)
    assert warc.gaps(warc.write(pages)).count() == 0
    assert warc.digests(warc.write(pages.limit(0))).count() == 0


def test_warc_long_url(spark):
    """A header over 64 KB, also one that grows by its blanks, is read back."""
    rows = [(1, "http://x/" + "a" * 70_000, "<p>one</p>"), (2, "http://x/" + " " * 30_000, "<p>two</p>"), (3, "http://x/3", "<p>three</p>"), (4, "http://x/" + "ab" * (1 << 19), "<p>four</p>"), (5, "u" * (1 << 20), None)]
    archives = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted((r["page_id"], r["payload_bytes"]) for r in warc.digests(archives).collect()) == [(k, len(h or "")) for k, _, h in rows]
    assert warc.gaps(archives).count() == 0


def test_warc_reader_is_linear():
    """Reading takes a time in proportion to the records, and damage in a table of archives loses only what it hits."""
    import time

    def archive(n):
        return b"".join(warc.member(warc.record("response", f"http://x/{k}", k, hashlib.sha256(b"x").hexdigest(), 1, b"x")) for k in range(n))

    took = []
    for n in (2000, 16_000):
        raw, t = archive(n), time.perf_counter()
        assert len(warc.read(raw).records) == n
        took.append(time.perf_counter() - t)
    assert took[1] < 24 * took[0]


def test_warc_table_with_damage(spark):
    rows = [(k, f"http://x/{k}", f"page {k} " * 40) for k in range(30)]
    archives = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), size=4000)
    held = archives.collect()
    assert len(held) > 2
    whole = {r["archive"]: [x.page for x in warc.read(bytes(r["body"])).records] for r in held}
    broken = []
    for r in held:
        raw = bytearray(r["body"])
        if r["archive"] == 1:
            raw[len(raw) // 2] ^= 0xFF
        broken.append((r["part"], r["archive"], raw))
    again = spark.createDataFrame(broken, archives.schema)
    got = {r["page_id"] for r in warc.digests(again).collect()}
    gap = warc.gaps(again).collect()
    assert len(gap) == 1 and gap[0]["archive"] == 1 and 0 <= gap[0]["first"] < gap[0]["end"]
    assert {p for ps in whole.values() for p in ps} - got and ({p for ps in whole.values() for p in ps} - got) < set(whole[1])


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 40)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = random.Random(4)
    rows = [(k, [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(rng.choice([3, 5]))]) for k in range(400)]
    rows += [(450, None), (500, [1.0, None]), (550, [float("nan")]), (600, [float("inf")]), (650, []), (None, [1.0]), (700, [1e30, -1e30])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as label", "2 as cell").repartition(3)
    q = topk.quantised(vectors)
    got = {}
    for r in topk.top_k(q, q.filter("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ok = {k: [int(np.floor(256 * float(np.float32(x)))) for x in v] for k, v in rows if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and k != 700}
    big = int(np.float32(1e30)) * 256
    ok[700] = [(1 << 63) - 1, -(1 << 63)]  # as a long holds it
    want = {}
    for k in ok:
        if k % 50 == 0:
            s = sorted(((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(ok[k], v)))), j) for j, v in ok.items() if j != k))[:5]
            want[k] = [(n + 1, j, -x) for n, (x, j) in enumerate(s)]
    assert big > 1 << 63 and {k: sorted(v) for k, v in got.items()} == want
    assert topk.top_k(q.limit(0), q.limit(0), 5).count() == 0
    few = q.filter("vec_id in (50, 51, 52)")
    assert topk.top_k(few, few.filter("vec_id = 50"), 5).count() == 2


def test_top_k_of_repeated_rows_and_shared_ids(spark, monkeypatch):
    """Copies are ranked as often as they come, a third of all rows too; two vectors of one id are two queries."""
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    rows = [(1, [2, 1])] * 400 + [(50, [1, 0]), (50, [0, 1]), (50, [0, 1])] + [(k, [k % 7, -k]) for k in range(2, 40)]
    v = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(5)
    got = sorted(map(tuple, topk.top_k(v, v.filter("vec_id = 50"), 5).collect()))
    want = []
    for ask in ([1, 0], [0, 1]):
        best = sorted((-sum(a * b for a, b in zip(x, ask)), k) for k, x in rows if k != 50)[:5]
        want += [(50, n + 1, k, -s) for n, (s, k) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_of_sparse_rows(spark):
    """Terms that few rows have are scattered, those of most rows accumulated together; sums beyond doubles are exact."""
    rng = random.Random(6)
    rows = [(k, [rng.randrange(-9, 9)] + [rng.choice([0, 0, 0, 0, 5]) for _ in range(rng.randrange(20))]) for k in range(300)]
    for scale in (1, 1 << 26):
        own = [(k, [x * scale for x in v]) for k, v in rows]
        v = spark.createDataFrame(own, "vec_id long, v array<long>").repartition(3)
        got = {}
        for r in topk.top_k(v, v.filter("vec_id % 50 = 0"), 5).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        for q in range(0, 300, 50):
            best = sorted((-sum(a * b for a, b in zip(x, own[q][1])), k) for k, x in own if k != q)[:5]
            assert sorted(got[q]) == [(n + 1, k, -s) for n, (s, k) in enumerate(best)]


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.train(docs)
    got = langid.identify(docs.select("doc_id", "text", "lang"), net).filter("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "the and of " * 9000), (5, "é")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in langid.identify(odd, net).collect()}
    assert [rows[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3
    assert all(rows[k]["lang_pred"] in net.labels and 0 <= rows[k]["lang_score"] <= 1 for k in (4, 5))
    assert langid.train(docs.limit(0)) is None
    assert langid.identify(odd, None).filter("lang_pred <> 'und'").count() == 0


def test_language_sample_of_unequal_sizes(spark):
    """A small language has all its texts in the sample beside large ones; the large ones have as many as are wanted."""
    large = spark.range(150_000).selectExpr("id as doc_id", "concat('some text ', id) as text", "concat('l', id % 3) as lang")
    small = spark.range(150_000, 150_012).selectExpr("id as doc_id", "concat('autre texte ', id) as text", "'small' as lang")
    rows = small.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").count()
    docs = large.union(small)
    # each of these texts is one window
    assert {k: len(v) for k, v in langid.sample(docs, 9).items()} == {"l0": 9, "l1": 9, "l2": 9, "small": min(9, rows)}
    assert langid.train(docs, 9).labels == ["l0", "l1", "l2", "small"]
    two = spark.range(60_040).selectExpr("id as doc_id", "concat('text ', id) as text", "if(id < 60000, 'much', 'little') as lang")
    assert langid.train(two, 6).labels == ["little", "much"]


def test_network_scores_as_it_trains():
    rng = np.random.default_rng(0)
    net = langid.ByteNet(["a", "b"])
    x = rng.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    assert np.allclose(np.exp(net.log_probs(x, net.tables())), net._forward(x)[0], atol=1e-4)


def test_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(docs, labels)
    held = toxicity.rate(docs.select("doc_id", "text"), model).join(labels, "doc_id").filter("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2").toPandas()
    guess, truth = held["toxic_score"] >= toxicity.THRESHOLD, held["toxic"] == 1
    assert (guess & truth).sum() / truth.sum() > 0.8 and (guess & ~truth).sum() / (~truth).sum() < 0.03
    odd = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert all(0 <= r["toxic_score"] < toxicity.THRESHOLD for r in toxicity.rate(odd, model).collect())
    assert toxicity.train(docs, labels.limit(0)).score("anything") < 0.01


def test_toxicity_with_a_repeated_id(spark, monkeypatch):
    """An id with very many rows takes one place of the sample, whatever order the rows come in."""
    docs = spark.range(400).selectExpr("id as doc_id", "concat(if(id % 2 = 0, 'vile hateful words ', 'kind calm words '), id) as text")
    labels = spark.range(400).selectExpr("id as doc_id", "cast(id % 2 = 0 as int) as toxic")
    copies = spark.range(4000).selectExpr("cast(1 as long) as doc_id", "'kind calm words 1' as text")
    rows = {1: 100, 0: 100}
    texts = []
    fit = toxicity.Classifier.fit.__func__
    monkeypatch.setattr(toxicity.Classifier, "fit", classmethod(lambda cls, found, target, *a: texts.append(len(target)) or fit(cls, found, target, *a)))
    plain = toxicity.train(docs, labels, rows)
    hot = toxicity.train(copies.unionByName(docs), labels.filter("doc_id = 1").union(labels), rows)
    assert texts[0] == texts[1] and plain.weights == hot.weights and plain.bias == hot.bias


def test_label_model_recovers_voters_from_votes_alone():
    """Rates of voters that abstain, and which of them repeat each other, without a label."""
    rng = np.random.default_rng(1)
    y = rng.random(6000) < 0.3
    speaks, right = [0.5, 0.7, 0.6, 0.8], [0.9, 0.75, 0.8, 0.85]
    cols = [np.where(rng.random(6000) < s, np.where(rng.random(6000) < r, y, ~y), -1) for s, r in zip(speaks, right, strict=True)]
    v = np.column_stack([*cols, cols[1], cols[1]]).astype(np.int8)
    model = toxicity.LabelModel(v, 0.3)
    assert np.allclose(model.accuracy, [*right, right[1], right[1]], atol=0.07)
    assert model.corr[1, 4] > 0.9 and model.corr[1, 5] > 0.9 and abs(model.corr[0, 1]) < 0.2
    says = model.says(np.array([[1, 1, 1, 1, 1, 1], [1, 1, 1, 1, -1, -1]], dtype=np.int8))
    assert says[0, 0] > 0.75 and says[0, 1] < 0.4 and says[1, 1] > 0.75 and says[1, 5] == 0
    assert ((model.posterior(v) > 0.5) == y).mean() > 0.85
    assert np.allclose(model.posterior(np.full((1, 6), -1, dtype=np.int8)), model.posterior(np.full((3, 6), -1, dtype=np.int8))[:1])


def test_voters_over_texts():
    texts = ["You are such an idiot, really", "st0p it, 1d10t!", "stuuupid words", "a calm day by the sea", "you may come in", "MORON! what a loser", ""]
    found = [toxicity.terms(t) for t in texts]
    v = toxicity.votes(texts, found, [["sea"]])
    english, learned, address, hidden, twice, loud, clean = v[:, 0], v[:, 4], v[:, 5], v[:, 6], v[:, 7], v[:, 8], v[:, 9]
    assert english.tolist() == [1, -1, -1, -1, -1, 1, -1]
    assert learned.tolist() == [-1, -1, -1, 1, -1, -1, -1]
    assert address.tolist() == [1, -1, -1, -1, -1, -1, -1]
    assert hidden.tolist() == [-1, 1, 1, -1, -1, -1, -1]
    assert twice.tolist() == [-1, -1, -1, -1, -1, 1, -1] and loud.tolist() == [-1, -1, -1, -1, -1, 1, -1]
    assert clean.tolist() == [0, 0, 0, -1, 0, 0, 0]


def test_toxicity_odd_rows(spark):
    """Repeated rows, clashing columns, an empty table, and texts of a sample beyond its characters."""
    docs = spark.range(300).selectExpr("id as doc_id", "concat(if(id % 2 = 0, repeat('vile hateful words ', 4000), 'kind calm words '), id) as text", "9.0 as toxic_score", "1 as toxic")
    labels = spark.range(300).selectExpr("id as doc_id", "cast(id % 2 = 0 as int) as toxic")
    model = toxicity.train(docs, labels, {1: 60, 0: 60})
    got = toxicity.rate(docs.union(docs), model)
    assert got.columns == ["doc_id", "text", "toxic", "toxic_score"] and got.count() == 600
    assert got.filter("toxic_score >= 0.3").selectExpr("sum(doc_id % 2)", "count(*)").first() == (0, 300)
    assert toxicity.rate(docs.limit(0), model).count() == 0


def test_language_odd_rows(spark):
    """Repeated rows and a clashing lang_pred; no text of the sample reaches the driver whole."""
    docs = spark.range(80).selectExpr("id as doc_id", "repeat(if(id % 2 = 0, 'the words and of ', 'les mots et de la '), 3000) as text", "if(id % 2 = 0, 'en', 'fr') as lang", "'x' as lang_pred")
    picked = langid.sample(docs, 20)
    assert set(picked) == {"en", "fr"} and all(0 < len(x) <= 20 * langid.PIECES * 2 and x.shape[1] == langid.WINDOW for x in picked.values())
    net = langid.train(docs, 20)
    got = langid.identify(docs.union(docs), net)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "lang_score"] and got.count() == 160
    assert got.filter("lang_pred = lang").count() == 160 and langid.identify(docs.limit(0), net).count() == 0
