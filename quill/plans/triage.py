"""Triage of candidates, its rank order, the rotating plan and its queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quill.functions import rules as R
from quill.operators import triage
from quill.operators.joins import page
from quill.plans.base import query
from quill.sources.tables import Tables

#: Titles for the test corpus, one of each kind that the rules tell apart.
TITLES = [
    "关于《数据要素行动计划》的政策解读", "关于张三等同志任免的通知", "关于设立产业基金和专项资金的通知", "关于完善电价机制的意见", "公布2025年人工智能典型应用案例名单",
    "关于开展首台（套）装备试点申报的通知", "十五五规划纲要", "行业标准制修订项目计划", "制造业数字化实施方案", "公告", "关于加快企业技术改造的指导意见", "政府采购目录认定结果", "一般说明",
]
LIMIT, QUEUE, RECOMMENDED = 24, 8, 3
#: A page of at most so many rows is kept to hold the head and the turn together.
NEAR = 10_000


def candidates(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    title = F.element_at(F.array(*map(F.lit, TITLES)), (d % len(TITLES) + 1).cast("int"))
    return t.raw("documents").select(
        "doc_id",
        title.alias("title"),
        F.when(d % 3 == 0, F.concat(F.lit("发改〔2025〕"), (d % 50).cast("string"), F.lit("号"))).alias("number"),
        F.when(d % 5 == 0, F.concat("text", F.lit(" 自2025年7月1日起施行，中标单位见附件"))).otherwise(F.col("text")).alias("text"),
        F.when(d % 7 == 0, F.lit("示范工程 补贴")).alias("raw"),
        F.date_format(F.date_add(F.lit("2026-05-01").cast("date"), (d % 90).cast("int")), "yyyy-MM-dd").alias("published"),
        (d % 4).alias("source_priority"),
    )


_LIST = ", ".join(f"'{x}'" for x in TITLES)
_SPACES = r"[\s\x{3000}\x{A0}]+"
_MATCH = lambda text, rules: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({text}, '{r.pattern}') THEN {{'code': '{r.code}', 'label': '{r.label}', 'weight': {r.weight}}} END" for r in rules) + "], lambda m: m IS NOT NULL)"
_WEIGHT = lambda c: f"coalesce(list_sum(list_transform({c}, lambda m: m.weight)), 0)"
_HAS = lambda c, *codes: "len(list_filter(" + c + ", lambda m: m.code IN (" + ", ".join(f"'{k}'" for k in codes) + "))) > 0"
_FIRST = lambda part: "CASE " + " ".join(f"WHEN regexp_matches(head, '{e.pattern}') THEN '{getattr(e, part)}'" for e in R.EXCLUSIONS) + " END"
_SQL = f"""WITH c AS (
  SELECT doc_id, [{_LIST}][doc_id % {len(TITLES)} + 1] AS title, CASE WHEN doc_id % 3 = 0 THEN '发改〔2025〕' || (doc_id % 50) || '号' END AS number,
    CASE WHEN doc_id % 5 = 0 THEN text || ' 自2025年7月1日起施行，中标单位见附件' ELSE text END AS text, CASE WHEN doc_id % 7 = 0 THEN '示范工程 补贴' END AS raw,
    strftime(DATE '2026-05-01' + CAST(doc_id % 90 AS INTEGER), '%Y-%m-%d') AS published, doc_id % 4 AS source_priority FROM documents
), n AS (
  SELECT *, trim(regexp_replace(coalesce(title, ''), '{_SPACES}', ' ', 'g')) AS t, trim(regexp_replace(coalesce(number, ''), '{_SPACES}', ' ', 'g')) AS nr,
    substr(trim(regexp_replace(coalesce(text, ''), '{_SPACES}', ' ', 'g')), 1, {R.TEXT_LIMIT}) AS x, substr(trim(regexp_replace(coalesce(raw, ''), '{_SPACES}', ' ', 'g')), 1, {R.RAW_LIMIT}) AS r FROM c
), h AS (SELECT *, t || chr(10) || r AS head, t || chr(10) || nr || chr(10) || r || chr(10) || x AS corpus FROM n),
m AS (
  SELECT *, {_FIRST('code')} AS e, {_FIRST('label')} AS why, {_MATCH('corpus', R.STRONG)} AS s, {_MATCH("t || chr(10) || nr", R.STRONG)} AS ts, {_MATCH('corpus', R.DIRECTIONS)} AS d,
    regexp_matches(head, '{R.RETROSPECTIVE}') AS retro, regexp_matches(t, '{R.COMPETITION}') AS fwdt, regexp_matches(head || chr(10) || substr(x, 1, {R.FORWARD_LIMIT}), '{R.COMPETITION}') AS fwd,
    regexp_matches(t, '{R.STANDARD_PLAN}') AS std, regexp_matches(r || chr(10) || x, '{R.SUBJECTS}') AS subj FROM h
), w AS (SELECT *, regexp_matches(t, '{R.BROAD_PLAN}') AND len(ts) = 0 AS broad, retro AND NOT fwdt AS past, {_WEIGHT('s')} AS sw, {_WEIGHT('ts')} AS tw FROM m),
p AS (SELECT *, CASE WHEN past THEN 'L2' WHEN len(ts) > 0 OR sw >= 5 THEN 'L3' WHEN {_HAS('d', 'plan_measure')} OR ({_HAS('d', 'industrial_action')} AND {_HAS('d', 'action_verb', 'formal_document')}) THEN 'L2' ELSE 'L1' END AS dep FROM w),
g AS (
  SELECT *, greatest(0, least(100, CASE dep WHEN 'L3' THEN 48 WHEN 'L2' THEN 32 ELSE 14 END + least(sw * 3, 24) + least(tw * 5, 25) + CASE WHEN fwd THEN 8 ELSE 0 END + CASE WHEN std THEN 4 ELSE 0 END - CASE WHEN broad THEN 8 ELSE 0 END)) AS tool0,
    CASE WHEN retro THEN 24 WHEN broad THEN 58 ELSE greatest(0, least(100, CASE WHEN {_HAS('s', *R.MARKET)} THEN 78 WHEN fwd THEN 72 WHEN std THEN 52 WHEN dep = 'L3' THEN 62 WHEN dep = 'L2' THEN 54 ELSE 25 END + least(len(d) * 3, 12))) END AS impact0,
    CASE WHEN subj THEN CASE WHEN retro THEN 92 ELSE 94 END WHEN regexp_matches(t, '{R.LISTED}') AND regexp_matches(t || chr(10) || r || chr(10) || x, '{R.BODIES}') THEN 82
      WHEN std AND regexp_matches(t || chr(10) || r || chr(10) || x, '{R.DRAFTED}') THEN 88 WHEN fwd THEN 58 WHEN regexp_matches(t, '{R.PRICED}') THEN 55 ELSE 38 END AS sure0 FROM p
), o AS (
  SELECT doc_id, title, published, source_priority, length(x) AS len_x, e IS NOT NULL AS excluded, CASE WHEN e IS NOT NULL THEN 'L0' ELSE dep END AS depth,
    CASE WHEN e IS NOT NULL THEN 0 ELSE CAST(greatest(0, least(100, floor((tool0 * 45 + impact0 * 35 + sure0 * 20 + 100 * (CASE WHEN nr <> '' THEN 2 ELSE 0 END + CASE WHEN length(x) >= {R.SUBSTANTIVE} THEN 2 ELSE 0 END - CASE WHEN past THEN 8 ELSE 0 END) + 50) / 100))) AS INTEGER) END AS priority,
    CASE WHEN e IS NULL THEN CAST(tool0 AS INTEGER) END AS tool, CASE WHEN e IS NULL THEN CAST(impact0 AS INTEGER) END AS impact, CASE WHEN e IS NULL THEN CAST(sure0 AS INTEGER) END AS verifiable,
    CASE WHEN e IS NOT NULL THEN why WHEN len(s) + len(d) = 0 THEN '{R.NO_SIGNAL}' ELSE array_to_string(list_concat(list_transform(s, lambda m: m.label), list_transform(d, lambda m: m.label))[1:6], ';') END AS reasons,
    CASE WHEN e IS NOT NULL THEN e ELSE array_to_string(list_concat(list_transform(s, lambda m: m.code), list_transform(d, lambda m: m.code))[1:10], ';') END AS signals FROM g
)"""


def triaged(t: Tables) -> DataFrame:
    return triage.classify(candidates(t))


def _usable(d: DataFrame) -> DataFrame:
    return d.filter("not excluded")


@query("triage", _SQL + " SELECT doc_id, excluded, depth, priority, tool, impact, verifiable, reasons, signals FROM o")
def triage_rows(t: Tables) -> DataFrame:
    d = triaged(t)
    return d.select("doc_id", "excluded", "depth", "priority", "tool", "impact", "verifiable", F.array_join("reasons", ";").alias("reasons"), F.array_join("signals", ";").alias("signals"))


@query("triage_depth_counts", _SQL + " SELECT depth, excluded, count(*) AS n, max(priority) AS highest FROM o GROUP BY ALL")
def triage_depth_counts(t: Tables) -> DataFrame:
    return triaged(t).groupBy("depth", "excluded").agg(F.count("*").alias("n"), F.max("priority").alias("highest"))


_ORDER = "depth DESC, priority DESC, published DESC, source_priority DESC, title, doc_id"


@query("triage_ranked", _SQL + f" SELECT doc_id, depth, priority, published, source_priority FROM o WHERE NOT excluded ORDER BY {_ORDER} LIMIT 100")
def triage_ranked(t: Tables) -> DataFrame:
    return _usable(triaged(t)).orderBy(*triage.rank_order("doc_id")).limit(100).select("doc_id", "depth", "priority", "published", "source_priority")


def plan(t: Tables, sequence: int | None) -> DataFrame:
    """A run's candidates, with their rank among all and their place in the run.

    Only keys are sorted, and only the pages of the order that the run takes are kept: the reserved head, and the turn's
    slots, which may wrap around. So the rotation goes through all candidates, and no window sees more than a run's places.
    """
    own = _usable(triaged(t)).withColumn("long", F.length(F.substring(triage.squeezed("text"), 1, R.TEXT_LIMIT)) >= R.SUBSTANTIVE)
    own = own.select("doc_id", "depth", "priority", "published", "source_priority", "title", "long")
    total, order = own.count(), triage.rank_order("doc_id")
    reserved, slots, start = triage.rotation(total, LIMIT, sequence)
    tail = total - reserved
    slots = min(slots, tail)
    end = reserved + start + slots
    if end <= min(NEAR, total):  # the turn is near the head: one page holds both
        number = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)) - 1
        return triage.choose(page(own, order, end).withColumn("rank", number.cast("long")), total, LIMIT, sequence).withColumn("place", F.col("place").cast("long"))
    spans = [(0, reserved, 0), (reserved + start, min(slots, tail - start), reserved), (reserved, max(0, slots - (tail - start)), reserved + tail - start)]
    out = None
    for first, n, place in spans:
        if n <= 0:
            continue
        number = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)) - 1
        some = page(own, order, n, first).withColumn("k", number).select("*", (F.col("k") + first).cast("long").alias("rank"), (F.col("k") + place).cast("long").alias("place")).drop("k")
        out = some if out is None else out.unionByName(some)
    return out if out is not None else own.limit(0).select("*", F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("place"))


_RANKED = _SQL + f", k AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) - 1 AS rank FROM o WHERE NOT excluded), z AS (SELECT count(*) AS n FROM k)"
for _sequence in (1, 3, 40):
    _start = (_sequence - 1) * 16

    @query(
        f"rotation_plan_{_sequence}",
        _RANKED + f", y AS (SELECT *, CAST((((rank - 8 - {_start} % (n - 8)) % (n - 8)) + (n - 8)) % (n - 8) AS BIGINT) AS turn FROM k, z) SELECT doc_id, rank, CASE WHEN rank < 8 THEN rank ELSE turn + 8 END AS place FROM y WHERE rank < 8 OR turn < 16",
    )
    def _rotation(t: Tables, sequence: int = _sequence) -> DataFrame:
        return plan(t, sequence).select("doc_id", "rank", "place")


@query(
    "queue_split",
    _RANKED + f""", y AS (SELECT * FROM k WHERE rank < {LIMIT} AND len_x >= {R.SUBSTANTIVE} AND depth IN ('L2', 'L3')), q AS (SELECT *, row_number() OVER (ORDER BY rank) AS place FROM y)
  SELECT CASE WHEN place <= {RECOMMENDED} THEN 'recommended' WHEN place <= {QUEUE} THEN 'pending' ELSE 'overflow' END AS part, count(*) AS n, min(rank) AS first FROM q GROUP BY 1""",
)
def queue_split(t: Tables) -> DataFrame:
    """The bounded pool's manual candidates with enough text: the first few are recommended, some more wait, the rest overflows."""
    own = plan(t, None).filter(F.col("long") & F.col("depth").isin("L2", "L3"))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("rank"))
    part = F.when(F.col("p") <= RECOMMENDED, "recommended").when(F.col("p") <= QUEUE, "pending").otherwise("overflow")
    return own.withColumn("p", place).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("rank").alias("first"))
