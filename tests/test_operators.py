"""Operators on hand-made rows, and folds against plain Python."""

import io
import random
import zipfile
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from quill.functions import identity as I
from quill.functions import labels as L
from quill.operators import dedupe, joins, runs, textrules, triage, validation
from quill.plans import params, registry
from quill.sources import extract, files
from quill.streaming import series
from tests import oracle


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_parameters():
    f = params.Filters(search="  ", event_types=["", "a"], module_ids=[""], granularity="YEAR", limit=999, offset=-4).normal()
    assert (f.search, f.event_types, f.module_ids, f.granularity, f.limit, f.offset) == (None, ["a"], None, "day", 200, 0)
    assert (f.start, f.end) == ("2024-01-01 00:00:00", "2024-01-31 00:00:00")
    with pytest.raises(ValueError):
        params.Filters(start="2024-02-01", end="2024-02-01").normal()
    assert params.relative("24h").granularity == "hour" and params.relative("7d").start == "2024-01-24 00:00:00"
    assert params.relative("custom", start="2024-01-02", end="2024-01-03").end == "2024-01-04 00:00:00"


def test_pick_one_prefers_the_first_key_then_the_newest(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "x"), (4, None)], "n int, ref string")
    right = spark.createDataFrame([("a", "b", 1, "A"), ("c", "a", 9, "C"), ("d", "b", 5, "D"), ("e", "b", 3, "E")], "id string, ext string, made int, v string")
    got = {r["n"]: r["v"] for r in joins.pick_one(left, right, "ref", ["id", "ext"], ["made"], ["v"]).collect()}
    assert got == {1: "A", 2: "D", 3: None, 4: None}


@pytest.mark.parametrize(
    "url,want",
    [
        ("HTTPS://Ex.org//a//b?utm_source=1&id=2&shareX=3#frag", "https://ex.org/a/b?id=2"),
        ("https://ex.org?from=1", "https://ex.org/"),
        ("https://ex.org/a?b=1&SPM=2&c=3", "https://ex.org/a?b=1&c=3"),
        ("not a url", "not a url"),
        ("  ", None),
        (None, None),
        ("https://ex.org/?unspm=1", "https://ex.org/?unspm=1"),
    ],
)
def test_urls(spark, url, want):
    assert one(spark, I.canonical_url(F.lit(url).cast("string"))) == want


def test_identity(spark):
    assert one(spark, I.identity_text(F.lit("《ＡＢｃ－１》 （試）"))) == "abc1試"
    assert one(spark, I.document_number(F.lit("中华人民共和国国务院办公厅 国发〔2025〕3号"))) == "国发〔2025〕3号"
    assert one(spark, I.core_title(F.lit("关于印发《甲乙丙丁》和《甲乙丙丁戊己》的通知"))) == "甲乙丙丁戊己"
    assert one(spark, I.core_title(F.lit("某部关于公布试点地区的通知（附件）"))) == "试点地区"
    assert [one(spark, I.normal_date(F.lit(x))) for x in ("1700000000", "1700000000000", "2023/1/5", "2023年11月05日", "soon")] == ["2023-11-14", "2023-11-14", "2023-01-05", "2023-11-05", None]
    assert one(spark, I.try_id(F.lit(" 0A0A0A0A-0000-0000-0000-00000000000F "))) == "0a0a0a0a-0000-0000-0000-00000000000f" and one(spark, I.try_id(F.lit("12"))) is None
    assert one(spark, I.dedupe_key(F.lit(None).cast("string"), F.lit("短"), F.lit("2025-01-01"), F.lit("https://a.b/c"))) == "url:https://a.b/c"


def test_dates_of_large_keys(spark, tmp_path):
    """Days whose epoch has eleven digits, or whose year has five, are those of the SQL too."""
    keys = [None, -8103, -8102, -8101, 0, 1, 2, 3, *range(96062, 96070), *range(599996, 600000), *range(2913219, 2913225), *range(40000000, 40000004)]
    spark.createDataFrame([(k,) for k in keys], "doc_id long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert oracle.compare(registry.QUERIES["dates_normalised"](spark, str(tmp_path)), con, registry.ORACLES["dates_normalised"]) is None
    assert [one(spark, I.normal_date(F.lit(x))) for x in ("10000000000", "10000/1/5", "20231105123000")] == [None, "10000-01-05", None]


def plain_greedy(rows):
    entries = []
    for r in rows:
        hit = next((e for e in entries if e["keys"] & set(r["keys"])), None)
        if hit is None:
            entries.append({"best": r, "keys": set(r["keys"]), "items": [r["item"]]})
            continue
        b = hit["best"]
        if r["score"] > b["score"] or r["score"] == b["score"] and r["url"] < b["url"]:
            hit["best"] = r
        hit["keys"] |= set(r["keys"])
        hit["items"].append(r["item"])
    return {i: e["best"]["item"] for e in entries for i in e["items"]}


def test_greedy_is_the_plain_fold(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for block in range(4):
        own = [{"block": str(block), "item": 100 * block + k, "seq": k, "keys": [f"k:{rng.randrange(25)}" for _ in range(rng.randint(1, 3))], "score": rng.randrange(4), "url": f"u{rng.randrange(9)}"} for k in range(40)]
        rows += own
        want |= plain_greedy(own)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "block string, item long, seq long, keys array<string>, score long, url string")
    got = {r["item"]: r["canonical"] for r in dedupe.greedy(df).collect()}
    assert got == want
    bridge = spark.createDataFrame([("b", 1, 1, ["x"], 0, "a"), ("b", 2, 2, ["y"], 0, "b"), ("b", 3, 3, ["y", "x"], 0, "c")], df.schema)
    assert {r["item"]: r["canonical"] for r in dedupe.greedy(bridge).collect()} == {1: 1, 2: 2, 3: 1}


def test_gaps_and_streaks(spark):
    rng = random.Random(2)
    at = sorted(rng.sample(range(2_000_000), 300))
    got = {r["at"]: r["gap"] for r in runs.gaps(spark.createDataFrame([(x,) for x in at], "at long"), "at").collect()}
    assert got == {x: (x - at[k - 1] if k else None) for k, x in enumerate(at)}
    bad = [rng.random() < 0.4 for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(bad)), "at int, bad boolean").withColumn("s", F.lit(1))
    got = sorted((r["first"], r["length"]) for r in runs.streaks(df, ["s"], "at", F.col("bad")).collect())
    want, k = [], 0
    while k < 200:
        n = 0
        while k + n < 200 and bad[k + n]:
            n += 1
        if n:
            want.append((k, n))
        k += n + 1
    assert got == want
    assert [one(spark, runs.freshness(F.lit(x).cast("int"))) for x in (80, 81, 160, 161, None)] == ["healthy", "degraded", "degraded", "stale", "unknown"]


def test_triage_samples_and_rotation(spark):
    rows = [("政策解读：一图读懂", None, "", None), ("关于下达产业基金补贴的通知", "财〔2025〕1号", "申报单位 " + "文" * 300, None), ("关于加快制造业发展的指导意见", None, "文" * 300, None), ("公布2025年典型应用案例名单", None, "", None), ("说明", None, None, None)]
    d = {r["title"]: r for r in triage.classify(spark.createDataFrame(rows, "title string, number string, text string, raw string")).collect()}
    assert [d[r[0]]["depth"] for r in rows] == ["L0", "L3", "L2", "L2", "L1"]
    assert d[rows[0][0]]["priority"] == 0 and d[rows[0][0]]["excluded"] and d[rows[4][0]]["priority"] == 23
    ranked = spark.range(107).withColumnRenamed("id", "rank")
    seen = set()
    for sequence in range(1, 8):
        got = [r["rank"] for r in triage.choose(ranked, 107, 24, sequence).orderBy("place").collect()]
        assert len(got) == 24 and got[:8] == list(range(8))
        seen |= set(got)
    assert seen == set(range(107))
    assert [r["rank"] for r in triage.choose(ranked, 107, 24, None).orderBy("rank").collect()] == list(range(24))


def test_validation(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 50)], "id int, x int")
    rules = {"missing": ("error", "x is null"), "large": ("warning", "x > 10")}
    assert sorted(map(tuple, validation.violations(df, "id", rules).collect())) == [(1, "missing", "error"), (3, "large", "warning")]
    assert {r["level"] for r in validation.violations(df, "id", rules, strict=True).collect()} == {"error"}
    texts = ["surely will win", "not that it will win", "this will not, by any means of ours, win"]
    got = [one(spark, validation.forbidden(F.lit(x), ["win"], ["not"])) for x in texts]
    assert got == [True, False, True]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "id int, v string")
    assert sorted(map(tuple, joins.upsert(old, new, "id", {"v": F.concat("o.v", "n.v")}).collect())) == [(1, "a", "kept"), (2, "bB", "matched"), (3, "C", "inserted")]


def test_clauses_keep_their_order(spark):
    text = "Short. The first thand sentence has some length here. Nothing at all in this one either. Shha tion 12 and the best one of them all!"
    got = textrules.clauses(spark.createDataFrame([(1, text), (2, "tiny")], "doc_id long, text string"), textrules.TEST_RULES, 2).collect()
    assert [r["pos"] for r in got if r["doc_id"] == 1] == [1, 3]
    assert [(r["score"], r["clause"]) for r in got if r["doc_id"] == 2] == [(40, "tiny")]


def test_labels(spark):
    assert [one(spark, L.duration(F.lit(x).cast("long"))) for x in (5, 59_000, 61_000, 3_660_000, None)] == ["5ms", "59s", "1m1s", "1h1m", "-"]
    assert [one(spark, L.truthy(F.lit(x))) for x in (" Yes", "0", "maybe")] == [True, False, None]
    assert one(spark, L.labelled(F.lit("policy_view"), {"a": "b"})) == "Policy View"


def test_extraction(spark, tmp_path):
    word = io.BytesIO()
    with zipfile.ZipFile(word, "w") as z:
        z.writestr("word/document.xml", "<?xml version='1.0'?><w:d><w:p><w:t>One</w:t></w:p><w:p>Two &amp; x</w:p></w:d>")
    pack = io.BytesIO()
    with zipfile.ZipFile(pack, "w") as z:
        z.writestr("a.txt", "plain  text")
        z.writestr("b.docx", word.getvalue())
    cases = {"a.html": b"<!doctype html><title>T</title><script>no</script><p>Hi&nbsp;there<p>you", "b.docx": word.getvalue(), "c.zip": pack.getvalue(), "d.pdf": b"%PDF-1.4 x", "e.txt": "数据要素，人工智能与制造业".encode("gb18030"), "f.zip": b"PK\x03\x04broken"}
    for name, raw in cases.items():
        (tmp_path / name).write_bytes(raw)
    got = {r["path"].rsplit("/", 1)[1]: r for r in extract.attachments(spark, str(tmp_path)).collect()}
    assert got["a.html"]["text"] == "Hi there\nyou" and extract.from_html(cases["a.html"].decode())[0] == "T"
    assert got["b.docx"]["format"] == "docx" and got["b.docx"]["text"].split("\n")[0] == "One"
    assert "plain text" in got["c.zip"]["text"] and "One" in got["c.zip"]["text"]
    assert got["d.pdf"]["status"] == "manual_review" and got["e.txt"]["text"].startswith("数据要素") and got["f.zip"]["status"].startswith("failed")


def test_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "r1.json").write_text('{"a": 1}')
    assert [(r["a"], r["file"]) for r in files.json_folder(spark, str(tmp_path), "a int").collect()] == [(1, "r1.json")]
    assert files.json_or(spark, str(tmp_path / "none.json"), "a int").count() == 0
    df = spark.createDataFrame([('{"inner": "{\\"v\\": 3}"}',)], "s string")
    assert files.nested_json(df, "s", ["inner string", "v int"]).first()["value"]["v"] == 3
    assert "| 1 |" in files.markdown(spark.range(1, 2), "T")


def test_streams(spark, tmp_path):
    rows = [(k, k % 3, datetime(2024, 1, 1, k % 5, k % 60), 10) for k in range(60)]
    schema = "event_id long, user_id long, occurred_at timestamp, duration_ms long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    got: dict = {}

    def keep(batch, number):
        got[number] = [tuple(r) for r in batch.collect()]

    stream = series.event_stream(spark, str(tmp_path / "in"), schema)
    series.drain(series.hourly(stream, "10 minutes"), str(tmp_path / "c1"), keep)
    closed = [r for b in got.values() for r in b]
    assert closed and all(r[1] == 12 and r[3] == 120 for r in closed)
    first: list = []
    series.drain(series.fresh(stream, "user_id"), str(tmp_path / "c2"), lambda b, n: first.extend(r["user_id"] for r in b.collect()))
    assert sorted(first) == [0, 1, 2]
    docs = spark.createDataFrame([(1, "a"), (1, "longer"), (2, "b")], "id long, text string")
    put = series.backfill(str(tmp_path / "v"), "id")
    put(docs, 0)
    put(spark.createDataFrame([(2, "bb"), (3, "c"), (1, "x")], docs.schema), 1)
    put(spark.createDataFrame([(2, "bb"), (3, "c"), (1, "x")], docs.schema), 1)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "v" / "v=1")).select("id", "text").collect())) == [(1, "longer"), (2, "bb"), (3, "c")]


def test_company_candidates_are_the_plain_fold(spark):
    from quill.operators import companies

    rng = random.Random(7)
    rows = [(d, r, p, f"c{rng.randrange(12)}", rng.randrange(100), rng.randrange(100)) for d in range(5) for r in range(4) for p in range(4)]
    got = {(r["doc_id"], r["company"]): (r["relevance"], r["certainty"], r["place"]) for r in companies.candidates(spark.createDataFrame(rows, "doc_id long, rank int, place int, company string, relevance long, certainty long"), 5).collect()}
    want = {}
    for d in range(5):
        taken = {}
        for _, _, _, c, a, b in sorted((x for x in rows if x[0] == d), key=lambda x: (x[1], x[2], x[3])):
            if c in taken:
                taken[c] = (max(taken[c][0], a), max(taken[c][1], b), taken[c][2])
            elif len(taken) < 5:
                taken[c] = (a, b, len(taken))
        want |= {(d, c): v for c, v in taken.items()}
    assert got == want


def test_the_rest_stands_without_the_training_data_part(tmp_path):
    """A copy of the repository without those folders imports and lists its queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "quill", tmp_path / "quill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries() if q[2:3].isdigit()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert out.returncode == 0 and out.stdout.split()[1] == "False"
