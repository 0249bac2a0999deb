"""Triage: depth, scores and priority of documents, ranks, and the rotating choice of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.functions import rules as R


def squeezed(c: str) -> Column:
    """White space, the ideographic and no-break blanks too, brought down to single blanks."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "[\\s\\u3000\\u00A0]+", " "))


def matched(text: Column, rules: list[R.Rule]) -> Column:
    """The rules that match, in the rules' order, as structs of code, label and weight."""
    return F.array_compact(F.array(*(F.when(text.rlike(r.pattern), F.struct(F.lit(r.code).alias("code"), F.lit(r.label).alias("label"), F.lit(r.weight).alias("weight"))) for r in rules)))


def condensed(c: Column) -> Column:
    """Long runs without a character that any rule needs, brought down to their ends and a line break.

    Every rule has ideographs, and none reaches over more than 24 other characters, or over a line break, so what matches is
    the same, and a text in another script is looked through once instead of once a rule.
    """
    plain = "[\\x00-\\x7f\\u00a0-\\u024f]"
    return F.regexp_replace(c, f"({plain}{{24}}){plain}{{32,}}({plain}{{24}})", "$1\n$2")


def _weight(c: str) -> Column:
    return F.aggregate(c, F.lit(0), lambda s, r: s + r["weight"])


def classify(df: DataFrame) -> DataFrame:
    """df (title, number, text, raw) with excluded, depth, tool, impact, verifiable, priority, reasons and signals.

    All is expressions over one row: no shuffle, no Python. Only the first TEXT_LIMIT characters of a text are looked at,
    as the rules demand.
    """
    d = df.withColumns({"__t": squeezed("title"), "__n": squeezed("number"), "__x": F.substring(squeezed("text"), 1, R.TEXT_LIMIT), "__r": F.substring(squeezed("raw"), 1, R.RAW_LIMIT)})
    d = d.withColumns({"__long": F.length("__x") >= R.SUBSTANTIVE, "__near": condensed(F.substring("__x", 1, R.FORWARD_LIMIT)), "__x": condensed(F.col("__x")), "__r": condensed(F.col("__r"))})
    t, n, x, r = (F.col(c) for c in ("__t", "__n", "__x", "__r"))
    nl = F.lit("\n")
    head = F.concat(t, nl, r)
    corpus = F.concat(t, nl, n, nl, r, nl, x)
    code = F.coalesce(*(F.when(head.rlike(e.pattern), e.code) for e in R.EXCLUSIONS))
    why = F.coalesce(*(F.when(head.rlike(e.pattern), e.label) for e in R.EXCLUSIONS))
    d = d.withColumns({
        "__e": code, "__why": why, "__s": matched(corpus, R.STRONG), "__ts": matched(F.concat(t, nl, n), R.STRONG), "__d": matched(corpus, R.DIRECTIONS),
        "__retro": head.rlike(R.RETROSPECTIVE), "__fwdt": t.rlike(R.COMPETITION), "__fwd": F.concat(head, nl, F.col("__near")).rlike(R.COMPETITION),
        "__std": t.rlike(R.STANDARD_PLAN), "__subj": F.concat(r, nl, x).rlike(R.SUBJECTS),
    })
    has = lambda c, *codes: F.exists(c, lambda m: m["code"].isin(*codes))
    d = d.withColumns({"__broad": t.rlike(R.BROAD_PLAN) & (F.size("__ts") == 0), "__only": F.col("__retro") & ~F.col("__fwdt"), "__w": _weight("__s"), "__tw": _weight("__ts")})
    acts = has("__d", "plan_measure") | (has("__d", "industrial_action") & has("__d", "action_verb", "formal_document"))
    deep = (F.size("__ts") > 0) | (F.col("__w") >= 5)
    d = d.withColumn("__depth", F.when(F.col("__only"), "L2").when(deep, "L3").when(acts, "L2").otherwise("L1"))
    if_ = lambda c, n: F.when(F.col(c), n).otherwise(0)
    cut = lambda c: F.greatest(F.lit(0), F.least(F.lit(100), c))
    by_depth = lambda a, b, c: F.when(F.col("__depth") == "L3", a).when(F.col("__depth") == "L2", b).otherwise(c)
    tool = cut(by_depth(48, 32, 14) + F.least(F.col("__w") * 3, F.lit(24)) + F.least(F.col("__tw") * 5, F.lit(25)) + if_("__fwd", 8) + if_("__std", 4) - if_("__broad", 8))
    base = F.when(has("__s", *R.MARKET), 78).when(F.col("__fwd"), 72).when(F.col("__std"), 52).otherwise(by_depth(62, 54, 25))
    impact = F.when(F.col("__retro"), 24).when(F.col("__broad"), 58).otherwise(cut(base + F.least(F.size("__d") * 3, F.lit(12))))
    every = F.concat(t, nl, r, nl, x)
    sure = (
        F.when(F.col("__subj"), F.when(F.col("__retro"), 92).otherwise(94))
        .when(t.rlike(R.LISTED) & every.rlike(R.BODIES), 82)
        .when(F.col("__std") & every.rlike(R.DRAFTED), 88)
        .when(F.col("__fwd"), 58)
        .when(t.rlike(R.PRICED), 55)
        .otherwise(38)
    )
    d = d.withColumns({"__tool": tool, "__impact": impact, "__sure": sure})
    context = F.when(n != "", 2).otherwise(0) + F.when(F.col("__long"), 2).otherwise(0) - if_("__only", 8)
    # hundredths, so that halves round as written
    priority = cut(F.floor((F.col("__tool") * 45 + F.col("__impact") * 35 + F.col("__sure") * 20 + context * 100 + 50) / 100).cast("int"))
    all_ = F.concat("__s", "__d")
    reasons = F.slice(F.array_distinct(F.transform(all_, lambda m: m["label"])), 1, 6)
    out = F.col("__e").isNotNull()
    kept = lambda c: F.when(~out, F.col(c) if isinstance(c, str) else c)
    return d.select(
        *df.columns,
        out.alias("excluded"),
        F.when(out, "L0").otherwise(F.col("__depth")).alias("depth"),
        F.when(out, 0).otherwise(priority).alias("priority"),
        kept("__tool").alias("tool"),
        kept("__impact").alias("impact"),
        kept("__sure").alias("verifiable"),
        F.when(out, F.array("__why")).when(F.size(reasons) == 0, F.array(F.lit(R.NO_SIGNAL))).otherwise(reasons).alias("reasons"),
        F.when(out, F.array("__e")).otherwise(F.slice(F.array_distinct(F.transform(all_, lambda m: m["code"])), 1, 10)).alias("signals"),
    )


def rank_order(key: str) -> list[Column]:
    return [F.desc("depth"), F.desc("priority"), F.desc("published"), F.desc("source_priority"), F.asc("title"), F.asc(key)]


def rotation(total: int, limit: int, sequence: int | None) -> tuple[int, int, int]:
    """Places reserved for the best, places that rotate, and where the rotation starts, for a run's number."""
    if not sequence or sequence < 1 or total <= limit:
        return 0, limit, 0
    reserved = min(limit // 3, limit - 1)
    slots = limit - reserved
    return reserved, slots, (sequence - 1) * slots % (total - reserved)


def choose(ranked: DataFrame, total: int, limit: int, sequence: int | None) -> DataFrame:
    """The candidates of a run from rows with a rank from 0: the first third of the places is kept, the others turn through the rest."""
    reserved, slots, start = rotation(total, limit, sequence)
    place = F.pmod(F.col("rank") - reserved - start, F.lit(max(1, total - reserved)))
    if total <= limit or not sequence:
        return ranked.filter(F.col("rank") < limit).withColumn("place", F.col("rank"))
    first = F.col("rank") < reserved
    return ranked.filter(first | (place < slots)).withColumn("place", F.when(first, F.col("rank")).otherwise(place + reserved))
