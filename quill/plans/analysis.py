"""The rules report: industry rules, clauses, actions, chain, fingerprint, comparable policies, over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quill.functions import industry as V
from quill.operators import analysis as A
from quill.operators.joins import page
from quill.plans.base import query
from quill.plans.triage import TITLES
from quill.sources.tables import Tables

#: Sentences that stand before a document's own text, so that every rule is met somewhere.
SENTENCES = (
    "第一条 支持人工智能大模型和算法创新，加快算力设施建设。",
    "推进公共数据资源开发利用，规范数据流通，到2027年覆盖80%的地区。",
    "加强能源和电力保障，推动绿色低碳转型，提升能效水平。",
    "鼓励工业企业开展智能制造改造，建设一批示范工厂和产业链协同平台。",
    "严禁未经审查的数据出境，强化安全监管和合规治理，落实主体责任。",
    "对违反规定的单位依法处罚并问责，建立负面清单制度并定期公布。",
    "支持集成电路、芯片和关键元器件攻关，培育半导体材料企业。",
    "推广机器人和自动化生产线，促进工业母机与数控系统升级。",
    "完善医疗器械和药品供应，医院开展数字化服务。",
    "引导银行和保险机构发展普惠金融，完善征信与支付体系。",
    "优化港口、铁路和公路网络，建设冷链物流与供应链枢纽。",
    "落实粮食安全责任，推动智慧农业和种业振兴，保护耕地。",
    "深化产教融合，支持高校和职业教育开设课程，培养技能人才。",
    "本通知自印发之日起施行。",
    "会议时间另行通知，请各单位按时参加。",
    "（三）组织实施AI专项行动，EDA工具和晶圆工艺取得突破！",
    "2. 开展标准制修订，防范系统性问题，包括1、范围 2、方法？",
    "天气晴好，适合出行，大家在公园散步并享受春天的阳光。",
    "新能源车与充电网络同步规划，水利和供水设施另行安排。",
)
LEVELS = ("国家级", "省级", "")
#: A policy is compared with so many of the newest.
COMPARABLE = 40


def briefs(t: Tables) -> DataFrame:
    """Policies: a title, and some of the sentences before the document's whole text."""
    d = F.col("doc_id")
    pick = F.transform(F.sequence(F.lit(0).cast("long"), d % 9), lambda j: F.element_at(F.array(*map(F.lit, SENTENCES)), ((d * 5 + j * 7) % len(SENTENCES) + 1).cast("int")))
    lead = F.when(d % 9 == 8, "").otherwise(F.concat(F.when(d % 2 == 0, F.array_join(pick, "\n")).otherwise(F.array_join(pick, "")), F.lit("\n")))
    full = F.when(d % 31 == 7, F.lit("")).otherwise(F.concat(lead, F.col("text")))
    return t.raw("documents").select(
        "doc_id",
        F.element_at(F.array(*map(F.lit, TITLES)), (d % len(TITLES) + 1).cast("int")).alias("title"),
        F.when(d % 6 == 0, "国家数据局").when(d % 6 == 1, "浙江省发展改革委").otherwise(F.col("source")).alias("issuer"),
        "source",
        F.when(d % 4 != 0, F.col("lang")).alias("category"),
        F.element_at(F.array(*map(F.lit, LEVELS)), (d % 3 + 1).cast("int")).alias("level"),
        F.when(d % 3 != 0, "https://example.org").alias("source_url"),
        full.alias("full"),
    ).withColumn("body", A.normal(F.col("full")))


def analysed(t: Tables) -> DataFrame:
    """Analysed policies. Callers explode with outer: a plain explode's inferred size filter would be pushed down through every step."""
    return A.with_analysis(briefs(t))


_Q = lambda s: "'" + s.replace("'", "''") + "'"
_LIST = lambda xs: "[" + ", ".join(map(_Q, xs)) + "]"
_NORMAL = lambda c: (
    f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, chr(160), ' ', 'g'), '[ \t]+', ' ', 'g'), '\\r\\n?', chr(10), 'g'), '[ \t]*\\n[ \t]*', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \\n]+', ''), '[ \\n]+$', '')"
)
_HAS = lambda s, words: "(" + " OR ".join(f"contains({s}, {_Q(w)})" for w in words) + ")"
_FOUND = lambda s, words, k: f"list_filter({_LIST(words)}, lambda w: contains({s}, w))[1:{k}]"
_OVER = lambda a, words: f"list_has_any({a}, {_LIST(words)})"
_SIGNAL = lambda v: f"CASE WHEN {_HAS('s', V.CONSTRAINT)} THEN '{v[0]}' " + (f"WHEN regexp_matches(s, '{V.RISK}') THEN '{v[1]}' " if v[1] else "") + f"WHEN {_OVER('acts', V.SUPPORT)} THEN '{v[2]}' WHEN {_OVER('acts', V.IMPLEMENTATION)} THEN '{v[3]}' ELSE '{v[4]}' END"
_KW = ", ".join(f"({k}, {_Q(r.code)}, {_Q(r.title)}, {V.SECTIONS.index(r.section)}, {_Q(r.section)}, {_Q(r.relation)}, {_Q(r.level)}, {j}, {_Q(w)})" for k, r in enumerate(V.RULES) for j, w in enumerate(r.keywords))
_PICK = f"list_transform(range(0, doc_id % 9 + 1), lambda j: {_LIST(SENTENCES)}[(doc_id * 5 + j * 7) % {len(SENTENCES)} + 1])"
_SQL = f"""WITH kw(ri, code, title, place, section, relation, level, ki, word) AS (VALUES {_KW}),
b AS (
  SELECT doc_id, {_LIST(TITLES)}[doc_id % {len(TITLES)} + 1] AS title, CASE doc_id % 6 WHEN 0 THEN '国家数据局' WHEN 1 THEN '浙江省发展改革委' ELSE source END AS issuer, source, CASE WHEN doc_id % 4 <> 0 THEN lang END AS category,
    {_LIST(LEVELS)}[doc_id % 3 + 1] AS level, CASE WHEN doc_id % 3 <> 0 THEN 'https://example.org' END AS source_url,
    CASE WHEN doc_id % 31 = 7 THEN '' ELSE CASE WHEN doc_id % 9 = 8 THEN '' ELSE CASE WHEN doc_id % 2 = 0 THEN array_to_string({_PICK}, chr(10)) ELSE array_to_string({_PICK}, '') END || chr(10) END || text END AS full_
  FROM documents),
d AS (SELECT *, {_NORMAL('full_')} AS body FROM b),
p AS (SELECT *, {_NORMAL("concat_ws(chr(10), nullif(title, ''), nullif(issuer, ''), nullif(source, ''), nullif(category, ''), nullif(level, ''), nullif(body, ''))")} AS whole FROM d),
h AS (SELECT doc_id, kw.*, (length(lower(whole)) - length(replace(lower(whole), lower(word), ''))) // length(word) AS occ FROM p JOIN kw ON contains(lower(whole), lower(word))),
r AS (SELECT doc_id, ri, code, title, place, section, relation, level, CAST(sum(12 + 3 * least(4, occ)) AS BIGINT) AS score, count(*) AS n, list(word ORDER BY ki) AS words FROM h GROUP BY ALL),
rr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, n DESC, ri) AS rank FROM r QUALIFY rank <= 8),
s0 AS (SELECT doc_id, body, list_filter(list_transform(string_split_regex(regexp_replace(body, '([。；;！!？?])\\s*', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(regexp_replace(x, '{V.LEADING}', ''))), lambda x: x <> '') AS ss FROM p),
s1 AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS pos FROM s0),
s2 AS (SELECT *, false AS bare FROM s1 WHERE length(s) >= 18 UNION ALL SELECT doc_id, CASE WHEN body <> '' THEN substr(body, 1, 180) ELSE '政策原文已入库，等待进一步结构化分析。' END, 0, true FROM s0 WHERE doc_id NOT IN (SELECT doc_id FROM s1 WHERE length(s) >= 18)),
sh AS (SELECT doc_id, pos, ri, title, sum(12 + 3 * least(4, (length(lower(s)) - length(replace(lower(s), lower(word), ''))) // length(word))) AS score, count(*) AS n FROM s2 JOIN kw ON contains(lower(s), lower(word)) GROUP BY ALL),
st AS (SELECT doc_id, pos, list(title ORDER BY score DESC, n DESC, ri) AS titles FROM sh GROUP BY ALL),
s3 AS (SELECT s2.*, {_FOUND('s', V.ACTIONS, 6)} AS acts, {_FOUND('s', V.KEYWORDS, 12)} AS keys, coalesce(titles, [])[1:8] AS t8 FROM s2 LEFT JOIN st USING (doc_id, pos)),
s4 AS (SELECT *, CASE WHEN bare THEN 40 ELSE len(acts) * 8 + len(keys) * 6 + len(t8) * 8 + CASE WHEN regexp_matches(s, '{V.NUMBERED}') THEN 4 ELSE 0 END + CASE WHEN length(s) BETWEEN 35 AND 220 THEN 5 ELSE 0 END + greatest(0, 6 - pos) END AS score, t8[1:4] AS titles FROM s3),
s5 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS k FROM s4 QUALIFY k <= 8),
s6 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, {_SIGNAL(('约束', '风险', '利好', '中性', '待验证'))} AS signal, {_SIGNAL(('合规约束', None, '支持方向', '执行要求', '相关要求'))} AS label, regexp_extract(s, '({V.CLAUSE_NO})', 1) AS first FROM s5),
c AS (SELECT *, CASE WHEN first = '' THEN '片段' || (i + 1) ELSE regexp_replace(first, '[、.)]$', '') END AS no, CASE WHEN signal IN ('约束', '风险') THEN 'risk' WHEN len(titles) > 0 OR {_OVER('keys', V.INDUSTRIAL)} THEN 'industry' ELSE 'core' END AS grp,
  CASE WHEN len(keys) > 0 THEN keys[1] || label ELSE '核心片段' || (i + 1) END AS title, CAST(greatest(58, least(94, 64 + least(score, 30) + greatest(0, 4 - i) * 2)) AS BIGINT) AS confidence FROM s6),
a0 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) - 1 AS ak FROM c WHERE len(acts) > 0 OR len(keys) > 0 QUALIFY ak < 5),
a AS (SELECT doc_id, ak AS k, coalesce(keys[1], titles[1], '政策') || label AS title, signal, CAST(greatest(58, least(92, confidence - 2 * ak)) AS BIGINT) AS confidence FROM a0
  UNION ALL SELECT doc_id, rank - 1, title || '影响识别', CASE WHEN relation = '约束风险' THEN '约束' ELSE '待验证' END, greatest(54, 74 - (rank - 1) * 4) FROM rr WHERE rank <= 4 AND doc_id NOT IN (SELECT doc_id FROM a0)),
rel AS (SELECT rr.doc_id, rr.ri, count(DISTINCT c.i) AS related FROM rr JOIN c ON c.doc_id = rr.doc_id JOIN kw ON kw.ri = rr.ri WHERE list_contains(c.titles, rr.title) OR contains(lower(concat_ws(chr(10), c.title, c.s, array_to_string(c.keys, ' '), array_to_string(c.titles, ' '))), lower(kw.word)) GROUP BY ALL),
n AS (SELECT rr.doc_id, rank - 1 AS i, code, place, section, relation, CAST(greatest(0, least(100, 62 + least(22, score) + least(8, 2 * coalesce(related, 0)) - 3 * (rank - 1))) AS BIGINT) AS confidence FROM rr LEFT JOIN rel USING (doc_id, ri)
  UNION ALL SELECT doc_id, 0, 'implementation', 3, 'support', '待验证', 52 FROM p WHERE doc_id NOT IN (SELECT doc_id FROM rr)),
e0 AS (SELECT doc_id, code AS source, lead(code) OVER w AS target, relation, lead(relation) OVER w AS other, confidence AS x, lead(confidence) OVER w AS y, row_number() OVER w - 1 AS i FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY place, i)),
e AS (SELECT doc_id, source, target, CASE WHEN '约束风险' IN (relation, other) THEN 'risk' WHEN i = 0 THEN 'strong' ELSE 'medium' END AS kind, CAST(floor((x + y) / 2 - 2 * i + 0.5) AS BIGINT) AS confidence FROM e0 WHERE target IS NOT NULL),
u1 AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS o FROM (SELECT doc_id, list_concat(list_concat({_FOUND('whole', V.KEYWORDS, 12)}, coalesce((SELECT flatten(list(words ORDER BY rank)) FROM rr WHERE rr.doc_id = p.doc_id), [])), CASE WHEN coalesce(category, '') <> '' THEN [category] ELSE [] END) AS l FROM p)),
u2 AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS o FROM (SELECT doc_id, list_concat(list_concat(coalesce((SELECT list(title ORDER BY k) FROM a WHERE a.doc_id = p.doc_id), []), coalesce((SELECT flatten(list(acts ORDER BY i)) FROM c WHERE c.doc_id = p.doc_id), [])), {_FOUND('whole', V.ACTIONS, 6)}) AS l FROM p)),
f1 AS (SELECT doc_id, list(x ORDER BY o)[1:20] AS keywords FROM (SELECT doc_id, x, min(o) AS o FROM u1 GROUP BY ALL) GROUP BY doc_id),
f2 AS (SELECT doc_id, list(x ORDER BY o)[1:16] AS labels FROM (SELECT doc_id, x, min(o) AS o FROM u2 GROUP BY ALL) GROUP BY doc_id),
f AS (SELECT p.doc_id, coalesce(keywords, []) AS keywords, coalesce(labels, []) AS labels, coalesce((SELECT list(code ORDER BY rank) FROM rr WHERE rr.doc_id = p.doc_id), []) AS codes, issuer,
  coalesce(category, CASE {' '.join(f"WHEN regexp_matches(whole, '{x}') THEN '{name}'" for x, name in V.CATEGORIES)} ELSE '政策文件' END) AS kind FROM p LEFT JOIN f1 USING (doc_id) LEFT JOIN f2 USING (doc_id)),
new AS (SELECT * FROM f ORDER BY doc_id DESC LIMIT {COMPARABLE}),
j AS (SELECT f.doc_id, new.doc_id AS other,
  list_transform([[f.keywords, new.keywords], [f.codes, new.codes], [f.labels, new.labels]], lambda q: len(list_distinct(list_intersect(list_transform(q[1], lambda w: lower(w)), list_transform(q[2], lambda w: lower(w))))) / nullif(len(list_distinct(list_concat(list_transform(q[1], lambda w: lower(w)), list_transform(q[2], lambda w: lower(w))))), 0)) AS x,
  CASE WHEN f.kind <> '' AND f.kind = new.kind THEN 6 ELSE 0 END + CASE WHEN f.issuer <> '' AND f.issuer = new.issuer THEN 4 ELSE 0 END AS same FROM f JOIN new ON f.doc_id <> new.doc_id),
sim AS (SELECT doc_id, other, CAST(floor(coalesce(x[1], 0) * 45 + coalesce(x[2], 0) * 35 + coalesce(x[3], 0) * 10 + same + 0.5) AS BIGINT) AS score FROM j),
near AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, other) AS rank FROM sim WHERE score >= 18 QUALIFY rank <= 5),
far AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score, other) AS rank FROM sim ANTI JOIN near USING (doc_id, other) QUALIFY rank <= 5)
"""


@query("industry_rules", _SQL + "SELECT doc_id, code, section, CAST(rank AS INTEGER) AS rank, score, array_to_string(words, '|') AS words FROM rr")
def industry_rules(t: Tables) -> DataFrame:
    d = briefs(t).withColumn("whole", A.normal(F.concat_ws("\n", *(F.nullif(c, F.lit("")) for c in ("title", "issuer", "source", "category", "level", "body")))))
    at = lambda name: A.rule_field(F.col("r.at"), name)
    return d.select("doc_id", F.posexplode(A.rules_in(F.col("whole"))).alias("k", "r")).select("doc_id", at("code").alias("code"), at("section").alias("section"), (F.col("k") + 1).alias("rank"), (-F.col("r.down")).alias("score"), F.array_join("r.words", "|").alias("words"))


@query("policy_clauses", _SQL + "SELECT doc_id, CAST(i AS INTEGER) AS pos, CAST(score AS BIGINT) AS score, no, grp, title, signal, label, confidence, s AS clause FROM c")
def policy_clauses(t: Tables) -> DataFrame:
    d = A.with_clauses(briefs(t)).select("doc_id", F.explode_outer("clauses").alias("c"))
    return d.select("doc_id", F.col("c.at").alias("pos"), "c.score", "c.no", F.col("c.group").alias("grp"), "c.title", "c.signal", "c.label", "c.confidence", F.col("c.text").alias("clause"))


@query("policy_actions", _SQL + "SELECT doc_id, CAST(k AS INTEGER) AS pos, title, signal, confidence FROM a")
def policy_actions(t: Tables) -> DataFrame:
    return analysed(t).select("doc_id", F.posexplode_outer("actions").alias("pos", "a")).filter("a is not null").select("doc_id", "pos", "a.title", "a.signal", "a.confidence")


@query("policy_nodes", _SQL + "SELECT doc_id, CAST(i AS INTEGER) AS pos, code, section, relation, confidence FROM n")
def policy_nodes(t: Tables) -> DataFrame:
    return analysed(t).select("doc_id", F.explode_outer("nodes").alias("n")).filter("n is not null").select("doc_id", F.col("n.at").alias("pos"), "n.code", "n.section", "n.relation", "n.confidence")


@query("policy_edges", _SQL + "SELECT * FROM e")
def policy_edges(t: Tables) -> DataFrame:
    return analysed(t).select("doc_id", F.explode_outer("edges").alias("e")).filter("e is not null").select("doc_id", "e.*")


@query("policy_fingerprints", _SQL + "SELECT doc_id, array_to_string(keywords, '|') AS keywords, array_to_string(codes, '|') AS codes, array_to_string(labels, '|') AS labels, kind FROM f")
def policy_fingerprints(t: Tables) -> DataFrame:
    return analysed(t).select("doc_id", *(F.array_join(c, "|").alias(c) for c in ("keywords", "codes", "labels")), "kind")


@query("comparable_policies", _SQL + "SELECT doc_id, 'similar' AS side, CAST(rank AS INTEGER) AS rank, other, score FROM near UNION ALL SELECT doc_id, 'contrast', CAST(rank AS INTEGER), other, score FROM far")
def comparable_policies(t: Tables) -> DataFrame:
    """The five most like a policy of the comparable ones, and the five least like it of the rest: a document's 40 pairs are ranked."""
    newest = page(t.raw("documents").select("doc_id"), [F.desc("doc_id")], COMPARABLE).select("doc_id")
    pairs = A.compared(analysed(t), A.with_analysis(briefs(t).join(F.broadcast(newest), "doc_id", "left_semi")))
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "other"))
    p = pairs.withColumn("k", best).withColumn("near", (F.col("k") <= 5) & (F.col("score") >= 18))
    worst = F.row_number().over(Window.partitionBy("doc_id", "near").orderBy("score", "other"))
    p = p.withColumn("w", worst).filter(F.col("near") | (F.col("w") <= 5))
    return p.select("doc_id", F.when(F.col("near"), "similar").otherwise("contrast").alias("side"), F.when(F.col("near"), F.col("k")).otherwise(F.col("w")).alias("rank"), "other", "score")


_CONF = f"""least(90, 62 + CASE WHEN source_url IS NOT NULL THEN 6 ELSE 0 END + CASE WHEN length(full_) > 500 THEN 12 ELSE 0 END + CASE WHEN coalesce(cn.n, 0) >= 3 THEN 8 ELSE 0 END + CASE WHEN coalesce(rn.n, 0) >= 2 THEN 8 ELSE 0 END + CASE WHEN coalesce(strong, 0) > 0 THEN 4 ELSE 0 END + CASE WHEN acts > 0 THEN 4 ELSE 0 END - CASE WHEN coalesce(rn.n, 0) = 0 THEN 12 ELSE 0 END)"""
_ABOUT = "concat_ws(' ', title, coalesce(issuer, ''), coalesce(level, ''), coalesce(source, ''))"


@query(
    "rules_report",
    _SQL + f""", cn AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE len(acts) > 0) AS acts FROM c GROUP BY 1), rn AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE level = '强证据') AS strong FROM rr GROUP BY 1),
  an AS (SELECT doc_id, count(*) AS n FROM a GROUP BY 1), en AS (SELECT doc_id, count(*) AS n FROM e GROUP BY 1)
  SELECT p.doc_id, kind, CASE WHEN regexp_extract({_ABOUT}, '({V.PROVINCES})', 1) <> '' THEN regexp_extract({_ABOUT}, '({V.PROVINCES})', 1) WHEN regexp_matches({_ABOUT}, '{V.NATIONAL}') THEN '全国' ELSE '以政策发布机关管辖范围为准' END AS scope,
    CAST({_CONF} AS BIGINT) AS confidence, coalesce(rn.n, 0) AS rules, cn.n AS clauses, coalesce(an.n, 0) AS actions, coalesce(en.n, 0) AS edges, coalesce(rn.n, 0) = 0 AS fallback, length(body) >= 280 AS usable,
    coalesce((SELECT array_to_string(list(title ORDER BY rank), '、') FROM rr WHERE rr.doc_id = p.doc_id), '尚未命中明确产业方向') AS directions
  FROM p JOIN (SELECT doc_id, kind FROM f) USING (doc_id) LEFT JOIN cn USING (doc_id) LEFT JOIN rn USING (doc_id) LEFT JOIN an USING (doc_id) LEFT JOIN en USING (doc_id)""",
)
def rules_report(t: Tables) -> DataFrame:
    """Each policy's report in one row: category, scope, confidence, directions and the sizes of its parts; whether its text is long enough to be analysed."""
    d = analysed(t)
    titles = F.transform("rules", lambda r: A.rule_field(r["at"], "title"))
    size = lambda c: F.size(c).cast("long").alias(c)
    return d.select(
        "doc_id", "kind", A.scope().alias("scope"), A.confidence(d).alias("confidence"), size("rules"), size("clauses"), size("actions"), size("edges"),
        (F.size("rules") == 0).alias("fallback"), (F.length("body") >= 280).alias("usable"), F.when(F.size("rules") == 0, "尚未命中明确产业方向").otherwise(F.array_join(titles, "、")).alias("directions"),
    )


_TEXT = "concat_ws(' ', title, issuer, source, category, level, body)"


@query("policy_theme", _SQL + f"SELECT doc_id, CASE {' '.join('WHEN ' + ' AND '.join(f'''regexp_matches({_TEXT}, '{x}')''' for x in ps) + f''' THEN '{name}' ''' for name, ps in V.THEMES)} ELSE 'general' END AS theme FROM p")
def policy_theme(t: Tables) -> DataFrame:
    return briefs(t).select("doc_id", A.theme(F.concat_ws(" ", "title", "issuer", "source", "category", "level", "body")).alias("theme"))
