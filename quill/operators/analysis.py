"""The policy analysis: industry rules, clauses, actions, chain graph, fingerprints, likeness, confidence.

All of it is expressions over one row: a text's sentences, rules and clauses are arrays in the row, so nothing is exploded or
shuffled until a caller asks for rows. Lengths count code points.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.functions import industry as V


def normal(c: Column) -> Column:
    """Blanks, line ends and empty lines in one form."""
    for pattern, new in ((" ", " "), ("[ \t]+", " "), ("\r\n?", "\n"), ("[ \t]*\n[ \t]*", "\n"), ("\n{3,}", "\n\n")):
        c = F.regexp_replace(c, pattern, new)
    return F.regexp_replace(F.regexp_replace(c, r"^[ \n]+", ""), r"[ \n]+$", "")


def _any(text: Column, words) -> Column:
    return reduce(or_, (F.contains(text, F.lit(w)) for w in words))


def _found(text: Column, words, most: int) -> Column:
    """The first of some words, in their own order, that a text has."""
    return F.slice(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)), 1, most)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once per row however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rules_in(text: Column) -> Column:
    """The eight best industry rules of a text: 12 a keyword and 3 for each of its first four occurrences; ties to more keywords, then to the rules' order."""
    word = lambda w: F.struct(F.lit(w).alias("word"), F.lit(w.lower()).alias("low"), F.lit(len(w)).alias("n"))
    every = F.array(*(F.struct(F.lit(k).alias("at"), F.array(*map(word, r.keywords)).alias("words")) for k, r in enumerate(V.RULES)))

    def best(low: Column) -> Column:
        found = F.transform(every, lambda r: F.struct(r["at"].alias("at"), F.filter(r["words"], lambda w: F.contains(low, w["low"])).alias("words")))
        times = lambda w: F.floor((F.length(low) - F.length(F.replace(low, w["low"], F.lit("")))) / w["n"])
        score = lambda r: F.aggregate(r["words"], F.lit(0).cast("long"), lambda a, w: a + 12 + 3 * F.least(F.lit(4).cast("long"), times(w)))
        row = lambda r: F.struct((-score(r)).alias("down"), (-F.size(r["words"])).alias("fewer"), r["at"].alias("at"), F.transform(r["words"], lambda w: w["word"]).alias("words"))
        return F.slice(F.array_sort(F.transform(F.filter(found, lambda r: F.size(r["words"]) > 0), row)), 1, 8)

    return bound(F.lower(text), best)


def rule_field(at: Column, name: str) -> Column:
    return F.element_at(F.array(*(F.lit(getattr(r, name)) for r in V.RULES)), at + 1)


def sentences(body: Column) -> Column:
    cut = F.split(F.regexp_replace(body, r"([。；;！!？?])\s*", "$1\n"), "\n+")
    return F.filter(F.transform(cut, lambda x: F.trim(F.regexp_replace(x, V.LEADING, ""))), lambda x: x != "")


def _signal(acts: Column, s: Column, values: tuple) -> Column:
    """By the strongest kind of action: a constraint (in the actions or anywhere), support, implementation, none."""
    out = F.when(_any(s, V.CONSTRAINT), values[0])
    if values[1]:
        out = out.when(s.rlike(V.RISK), values[1])
    has = lambda words: F.arrays_overlap(acts, F.array(*map(F.lit, words)))
    return out.when(has(V.SUPPORT), values[2]).when(has(V.IMPLEMENTATION), values[3]).otherwise(values[4])


def with_clauses(docs: DataFrame) -> DataFrame:
    """docs (with a normalised body) with clauses: the eight best sentences of 18 characters or more in their own order, or the text's beginning.

    A sentence scores 8 an action word, 6 a keyword, 8 an industry rule, 4 for a number or its like, 5 for a middling length,
    and up to 6 for an early place. Each clause has what is inferred from it.
    """
    feature = lambda x, pos: F.struct(
        x.alias("s"), pos.alias("pos"), _found(x, V.ACTIONS, 6).alias("acts"), _found(x, V.KEYWORDS, 12).alias("keys"), F.transform(rules_in(x), lambda r: rule_field(r["at"], "title")).alias("titles")
    )
    score = lambda p: (
        F.size(p["acts"]) * 8
        + F.size(p["keys"]) * 6
        + F.size(p["titles"]) * 8
        + F.when(p["s"].rlike(V.NUMBERED), 4).otherwise(0)
        + F.when(F.length(p["s"]).between(35, 220), 5).otherwise(0)
        + F.greatest(F.lit(0), 6 - p["pos"])
    )
    d = docs.withColumn("_s", sentences(F.col("body")))
    d = d.withColumn("_f", F.filter(F.transform("_s", feature), lambda p: F.length(p["s"]) >= 18))
    d = d.withColumn("_r", F.array_sort(F.transform("_f", lambda p: F.struct((-score(p)).alias("down"), p["pos"].alias("pos"), p.alias("f")))))
    d = d.withColumn("_k", F.array_sort(F.transform(F.slice("_r", 1, 8), lambda r: F.struct(r["pos"].alias("pos"), (-r["down"]).alias("score"), r["f"].alias("f")))))
    start = F.when(F.length("body") > 0, F.substring("body", 1, 180)).otherwise("政策原文已入库，等待进一步结构化分析。")
    none = F.array(F.struct(F.lit(0).alias("pos"), F.lit(40).alias("score"), feature(start, F.lit(0)).alias("f")))
    d = d.withColumn("_k", F.when(F.size("_k") > 0, F.col("_k")).otherwise(none))

    def clause(r: Column, i: Column) -> Column:
        s, acts, keys = r["f"]["s"], r["f"]["acts"], r["f"]["keys"]
        titles = F.slice(r["f"]["titles"], 1, 4)
        signal = _signal(acts, s, ("约束", "风险", "利好", "中性", "待验证"))
        label = _signal(acts, s, ("合规约束", None, "支持方向", "执行要求", "相关要求"))
        first = F.regexp_extract(s, f"({V.CLAUSE_NO})", 1)
        no = F.when(first == "", F.concat(F.lit("片段"), (i + 1).cast("string"))).otherwise(F.regexp_replace(first, "[、.)]$", ""))
        industrial = (F.size(titles) > 0) | F.arrays_overlap(keys, F.array(*map(F.lit, V.INDUSTRIAL)))
        group = F.when(signal.isin("约束", "风险"), "risk").when(industrial, "industry").otherwise("core")
        title = F.when(F.size(keys) > 0, F.concat(F.get(keys, F.lit(0)), label)).otherwise(F.concat(F.lit("核心片段"), (i + 1).cast("string")))
        confidence = F.greatest(F.lit(58), F.least(F.lit(94), 64 + F.least(r["score"], F.lit(30)) + F.greatest(F.lit(0), 4 - i) * 2))
        return F.struct(
            i.alias("at"), r["pos"].alias("pos"), r["score"].cast("long").alias("score"), s.alias("text"), acts.alias("acts"), keys.alias("keys"), titles.alias("titles"),
            signal.alias("signal"), label.alias("label"), no.alias("no"), group.alias("group"), title.alias("title"), confidence.cast("long").alias("confidence"),
        )

    return d.withColumn("clauses", F.transform("_k", clause)).drop("_s", "_f", "_r", "_k")


def with_analysis(docs: DataFrame) -> DataFrame:
    """docs (doc_id, title, issuer, source, category, level, body, full) with rules, clauses, actions, nodes, edges and a fingerprint."""
    whole = normal(F.concat_ws("\n", *(F.nullif(c, F.lit("")) for c in ("title", "issuer", "source", "category", "level", "body"))))
    d = with_clauses(docs.withColumn("whole", whole).withColumn("rules", rules_in(F.col("whole"))))
    # actions
    told = F.filter("clauses", lambda c: (F.size(c["acts"]) > 0) | (F.size(c["keys"]) > 0))
    best = F.slice(F.array_sort(F.transform(told, lambda c: F.struct((-c["score"]).alias("down"), c["at"].alias("at"), c.alias("c")))), 1, 5)
    d = d.withColumn("_b", best)
    act = lambda b, i: F.struct(
        F.concat(F.coalesce(F.get(b["c"]["keys"], F.lit(0)), F.get(b["c"]["titles"], F.lit(0)), F.lit("政策")), b["c"]["label"]).alias("title"),
        b["c"]["signal"].alias("signal"),
        F.greatest(F.lit(58).cast("long"), F.least(F.lit(92).cast("long"), b["c"]["confidence"] - 2 * i)).alias("confidence"),
        b["c"]["at"].alias("clause"),
    )
    ruled = F.transform(
        F.slice("rules", 1, 4),
        lambda r, i: F.struct(
            F.concat(rule_field(r["at"], "title"), F.lit("影响识别")).alias("title"),
            F.when(rule_field(r["at"], "relation") == "约束风险", "约束").otherwise("待验证").alias("signal"),
            F.greatest(F.lit(54), 74 - i * 4).cast("long").alias("confidence"),
            F.lit(None).cast("int").alias("clause"),
        ),
    )
    d = d.withColumn("actions", F.when(F.size("_b") > 0, F.transform("_b", act)).otherwise(ruled)).drop("_b")
    # nodes, and the edges between neighbours in order of section
    hay = F.transform("clauses", lambda c: F.struct(F.lower(F.concat_ws("\n", c["title"], c["text"], F.concat_ws(" ", c["keys"]), F.concat_ws(" ", c["titles"]))).alias("low"), c["titles"].alias("titles")))
    d = d.withColumn("_h", hay)
    words = F.array(*(F.array(*map(F.lit, r.keywords)) for r in V.RULES))

    def node(r: Column, i: Column) -> Column:
        title, own = rule_field(r["at"], "title"), F.element_at(words, r["at"] + 1)
        related = F.size(F.filter("_h", lambda h: F.array_contains(h["titles"], title) | F.exists(own, lambda w: F.contains(h["low"], F.lower(w)))))
        confidence = F.greatest(F.lit(0), F.least(F.lit(100), 62 + F.least(F.lit(22), -r["down"]) + F.least(F.lit(8), 2 * related) - 3 * i))
        place = F.element_at(F.array(*(F.lit(V.SECTIONS.index(x.section)) for x in V.RULES)), r["at"] + 1)
        return F.struct(place.alias("place"), i.alias("at"), rule_field(r["at"], "code").alias("code"), rule_field(r["at"], "section").alias("section"), rule_field(r["at"], "relation").alias("relation"), confidence.cast("long").alias("confidence"))

    bare = F.array(F.struct(F.lit(3).alias("place"), F.lit(0).alias("at"), F.lit("implementation").alias("code"), F.lit("support").alias("section"), F.lit("待验证").alias("relation"), F.lit(52).cast("long").alias("confidence")))
    d = d.withColumn("nodes", F.when(F.size("rules") > 0, F.transform("rules", node)).otherwise(bare)).drop("_h")
    d = d.withColumn("_o", F.array_sort("nodes"))

    def edge(a: Column, i: Column) -> Column:
        b = F.element_at("_o", i + 2)
        kind = F.when((a["relation"] == "约束风险") | (b["relation"] == "约束风险"), "risk").when(i == 0, "strong").otherwise("medium")
        return F.struct(a["code"].alias("source"), b["code"].alias("target"), kind.alias("kind"), F.floor((a["confidence"] + b["confidence"]) / 2 - 2 * i + 0.5).cast("long").alias("confidence"))

    d = d.withColumn("edges", F.transform(F.slice("_o", F.lit(1), F.greatest(F.size("_o") - 1, F.lit(0))), edge)).drop("_o")
    # fingerprint
    kind = F.lit(None).cast("string")
    for pattern, name in reversed(V.CATEGORIES):
        kind = F.when(F.col("whole").rlike(pattern), name).otherwise(kind)
    own = F.nullif(F.col("category"), F.lit(""))
    keys = F.concat(_found(F.col("whole"), V.KEYWORDS, 12), F.flatten(F.transform("rules", lambda r: r["words"])), F.array_compact(F.array(own)))
    acts = F.concat(F.transform("actions", lambda a: a["title"]), F.flatten(F.transform("clauses", lambda c: c["acts"])), _found(F.col("whole"), V.ACTIONS, 6))
    return d.withColumns({
        "kind": F.coalesce(F.col("category"), kind, F.lit("政策文件")),
        "keywords": F.slice(F.array_distinct(keys), 1, 20),
        "labels": F.slice(F.array_distinct(acts), 1, 16),
        "codes": F.transform("rules", lambda r: rule_field(r["at"], "code")),
    })


def confidence(d: DataFrame) -> Column:
    """From 62 up by what a report rests on, 90 at most."""
    plus = lambda c, k: F.when(c, k).otherwise(0)
    n = F.size("rules")
    strong = F.exists("rules", lambda r: rule_field(r["at"], "level") == "强证据")
    total = F.lit(62) + plus(F.coalesce(F.col("source_url"), F.lit("")) != "", 6) + plus(F.length("full") > 500, 12) + plus(F.size("clauses") >= 3, 8) + plus(n >= 2, 8) + plus(strong, 4)
    total = total + plus(F.exists("clauses", lambda c: F.size(c["acts"]) > 0), 4) - plus(n == 0, 12)
    return F.least(total, F.lit(90)).cast("long")


def scope() -> Column:
    """A province that is named, the whole country, or what the issuer governs."""
    text = F.concat_ws(" ", "title", F.coalesce("issuer", F.lit("")), F.coalesce("level", F.lit("")), F.coalesce("source", F.lit("")))
    province = F.regexp_extract(text, f"({V.PROVINCES})", 1)
    return F.when(province != "", province).when(text.rlike(V.NATIONAL), "全国").otherwise("以政策发布机关管辖范围为准")


def theme(text: Column) -> Column:
    """The first theme all of whose patterns a text has."""
    out = F.lit("general")
    for name, patterns in reversed(V.THEMES):
        out = F.when(reduce(lambda a, b: a & b, (text.rlike(p) for p in patterns)), name).otherwise(out)
    return out


def _jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 where both are empty."""
    shared = F.size(F.array_intersect(a, b))
    both = F.size(a) + F.size(b) - shared
    return F.when(both == 0, 0.0).otherwise(shared / both)


def compared(d: DataFrame, comparable: DataFrame) -> DataFrame:
    """doc_id, other and score of each analysed document with each of the comparable ones but itself.

    comparable is a bounded number of analysed documents. Their fingerprints are one row, which every document meets in its
    own row, so the documents aren't shuffled.
    """
    low = lambda c: F.array_distinct(F.transform(c, F.lower)).alias(c)
    side = lambda x: x.select("doc_id", low("keywords"), low("codes"), low("labels"), "kind", "issuer")
    others = side(comparable).agg(F.collect_list(F.struct("*")).alias("others"))
    same = lambda a, b: F.when((F.coalesce(a, F.lit("")) != "") & (a == b), 1).otherwise(0)
    total = lambda o: (
        _jaccard(F.col("keywords"), o["keywords"]) * 45
        + _jaccard(F.col("codes"), o["codes"]) * 35
        + _jaccard(F.col("labels"), o["labels"]) * 10
        + same(F.col("kind"), o["kind"]) * 6
        + same(F.col("issuer"), o["issuer"]) * 4
    )
    pairs = F.transform(F.filter("others", lambda o: o["doc_id"] != F.col("doc_id")), lambda o: F.struct(o["doc_id"].alias("other"), F.floor(total(o) + 0.5).cast("long").alias("score")))
    return side(d).crossJoin(F.broadcast(others)).select("doc_id", F.inline_outer(pairs)).filter("other is not null")
