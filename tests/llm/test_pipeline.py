"""The pipeline's stages over a small corpus."""

import corpus_pipeline
from quill.llm import simhash, stages


def test_stages_and_run(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    now = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, now, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert 0 < len(rows) <= now.count()
        now = spark.createDataFrame(rows, out.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, now, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"] for r in last} == {r["doc_id"] for r in now.collect()}
    # cuts depend on what a task reads; documents and their ids don't
    run = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert {(r["doc_id"], r["doc_tokens"]) for r in run} == {(r["doc_id"], r["doc_tokens"]) for r in last}
    assert sum(r["length"] for r in run) == sum(r["length"] for r in last)


def test_near_stage_finds_what_jaccard_finds(spark):
    """Pairs well over a likeness of 0.8 by five-word shingles meet in one class; pairs well below it don't."""
    import random

    rng = random.Random(3)
    base = [[f"w{rng.randrange(4000)}" for _ in range(400)] for _ in range(30)]
    rows = []
    for k, words in enumerate(base):
        rows.append((10 * k, " ".join(words)))
        for j, edits in enumerate((0, 2, 4, 60)):
            own = list(words)
            for at in rng.sample(range(400), edits):
                own[at] = "edited"
            rows.append((10 * k + j + 1, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in stages.one_of_each(spark, docs, "").collect()}
    assert got == {10 * k for k in range(30)} | {10 * k + 4 for k in range(30)}
    assert simhash.jaccard_classes(docs.limit(0), stages.WORDS, stages.ALIKE, stages.LANES).count() == 0


def near_pairs(likenesses, pairs, shared=360, seed=5):
    """Rows of pairs of texts without common words but in the pair: of n shingles on each side, so many are shared."""
    import random

    rng, rows, asked = random.Random(seed), [], {}
    for want in likenesses:
        for _ in range(pairs):
            own = round((shared / want - shared) / 2)
            k = 2 * len(asked)
            word = lambda: f"w{rng.getrandbits(48):x}"
            head = [word() for _ in range(shared + 4)]
            a, b = (" ".join(head + [word() for _ in range(own)]) for _ in range(2))
            rows += [(k, a), (k + 1, b)]
            asked[k] = shared / (shared + 2 * own)
    return rows, asked


def test_near_stage_at_its_likeness(spark):
    """Pairs right over 0.8 are found, and none right below it is linked."""
    rows, asked = near_pairs([0.75, 0.78, 0.795, 0.8, 0.82, 0.85], 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r["doc_id"] for r in stages.one_of_each(spark, docs, "").collect()}
    assert set(asked) <= kept
    assert all(k + 1 in kept for k, j in asked.items() if j < 0.8)
    over = [k for k, j in asked.items() if j >= 0.8]
    assert len(over) >= 80 and sum(k + 1 not in kept for k in over) >= 0.97 * len(over)


def test_tables_grow_with_the_rows():
    """A front keeps about a thousand rows, and a pair right at the likeness its chance to be found, at any size."""
    for rows in (0, 1, 10**5, 10**7, 10**9, 10**10):
        tables, width, radius = simhash.tables_for(rows, 0.8, 512)
        assert rows / 2**width <= 1100 and width <= 30 and radius == 102
        assert (1 - (1 - 0.15146) ** width) ** tables <= 0.0021
    assert simhash.tables_for(10**5, 0.8, 512)[:2] == (42, 12)


def test_verified_links_in_blocks(spark, monkeypatch):
    """A candidate class that is dealt out in blocks gives the classes that all pairs give."""
    import random

    import numpy as np

    from quill.llm import graph

    monkeypatch.setattr(simhash, "SHARD", 16)
    rng = random.Random(2)
    base = [[f"w{rng.randrange(500)}" for _ in range(60)] for _ in range(12)]
    texts = []
    for k in range(90):
        words = list(base[k % 12])
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"x{rng.randrange(99)}"
        texts.append((1, k, " ".join(words)))
    got = {r["node"]: r["root"] for r in graph.components(simhash.verified(spark.createDataFrame(texts, "root long, node long, text string"), 5, 0.8)).collect()}
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, _, t in texts]
    pairs = [(b, a) for a in range(90) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = dict(graph.forest(pairs))
    assert got == want | {v: v for v in want.values()}
    assert simhash.set_links([np.unique(simhash.shingle_hashes(t, 5)) for t in ("", "a b", "a b")], 0.8) == [(1, 2)]


def test_stages_take_odd_rows(spark):
    """Nulls everywhere, empty and repeated rows, clashing columns, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, component_id long, first long"
    rows = [(None, None, None, None, None, "a", 1, 2), (1, None, None, "s", None, None, None, None), (2, "", "en", None, 0, None, None, None), (None, "the and of words here", "en", "s", 20, None, None, None)]
    rows += [(3, "the same words again and again", "en", "s", 30, None, None, None)] * 3 + [(4, "le même texte ici", None, "s", 17, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    labels = "/root/testdata/sf0.001"
    for _, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, docs, labels).columns == docs.columns
        assert f(spark, docs.limit(0), labels).count() == 0
    assert stages.clean(spark, docs, labels).count() == len(rows)
    kept = stages.one_of_each(spark, docs, labels).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "3", "4", "None", "None"]
    assert {r["doc_id"] for r in stages.language(spark, docs, labels).collect()} <= {None, 3, 4}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, labels).selectExpr("sum(length) > 0").first()[0]
