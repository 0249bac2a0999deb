"""Nested reports: building, lookup, validation, coverage, graphs, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.functions import labels as L
from quill.operators import validation
from quill.operators.joins import dangling, first_match, neighbours, page
from quill.plans.base import query
from quill.plans.behaviour import enriched
from quill.sources.tables import Tables, with_sql


def reports(t: Tables) -> DataFrame:
    """A report an order: its lines are the evidence, summed up into one ordered array before anything is joined."""
    lines = t.raw("lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("long").alias("no"), F.col("l_suppkey").alias("company"), F.col("l_returnflag").alias("level"), F.floor("l_quantity").cast("long").alias("score")))).alias("evidence")
    )
    o = t.raw("orders").select(F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("policy_no"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("priority"))
    return o.join(lines, o["report_id"] == lines["l_orderkey"], "left").drop("l_orderkey")


_R = """WITH e AS (SELECT l_orderkey, list({'no': CAST(l_linenumber AS BIGINT), 'company': l_suppkey, 'level': l_returnflag, 'score': CAST(floor(l_quantity) AS BIGINT)} ORDER BY l_linenumber, l_suppkey, l_returnflag, floor(l_quantity)) AS evidence FROM lineitem GROUP BY 1),
  r AS (SELECT o_orderkey AS report_id, o_custkey AS policy_no, o_orderstatus AS state, o_orderpriority AS priority, evidence FROM orders LEFT JOIN e ON l_orderkey = o_orderkey)"""


@query("report_json", _R + " SELECT report_id, sha256(to_json(coalesce(evidence, []))) AS digest, CAST(len(coalesce(evidence, [])) AS BIGINT) AS n FROM r")
def report_json(t: Tables) -> DataFrame:
    e = F.coalesce("evidence", F.expr("from_json('[]', 'array<struct<no:bigint,company:bigint,level:string,score:bigint>>')"))
    return reports(t).select("report_id", F.sha2(F.to_json(e, {"ignoreNullFields": "false"}).cast("binary"), 256).alias("digest"), F.size(e).cast("long").alias("n"))


RULES = {
    "no_evidence": ("error", "evidence is null or size(evidence) = 0"),
    "thin_evidence": ("warning", "size(evidence) = 1"),
    "order_broken": ("error", "exists(transform(sequence(0, greatest(size(evidence) - 2, 0)), i -> try_element_at(evidence, i + 1).no >= try_element_at(evidence, i + 2).no), x -> x)"),
    "over_cap": ("warning", "exists(evidence, x -> x.level = 'R' and x.score > 45)"),
    "same_company": ("warning", "size(array_distinct(transform(evidence, x -> x.company))) < size(evidence)"),
}


@query(
    "report_violations",
    _R + """ SELECT report_id, 'no_evidence' AS code, 'error' AS level FROM r WHERE evidence IS NULL UNION ALL SELECT report_id, 'thin_evidence', 'warning' FROM r WHERE len(evidence) = 1
  UNION ALL SELECT report_id, 'order_broken', 'error' FROM r WHERE len(list_filter(generate_series(1, len(evidence) - 1), lambda i: evidence[i].no >= evidence[i + 1].no)) > 0
  UNION ALL SELECT report_id, 'over_cap', 'warning' FROM r WHERE len(list_filter(evidence, lambda x: x.level = 'R' AND x.score > 45)) > 0
  UNION ALL SELECT report_id, 'same_company', 'warning' FROM r WHERE len(list_distinct(list_transform(evidence, lambda x: x.company))) < len(evidence)""",
)
def report_violations(t: Tables) -> DataFrame:
    return validation.violations(reports(t), "report_id", RULES)


@query("report_validity", _R + ", v AS (SELECT report_id, evidence IS NULL OR len(evidence) = 1 OR len(list_filter(generate_series(1, len(evidence) - 1), lambda i: evidence[i].no >= evidence[i + 1].no)) > 0 OR len(list_filter(evidence, lambda x: x.level = 'R' AND x.score > 45)) > 0 OR len(list_distinct(list_transform(evidence, lambda x: x.company))) < len(evidence) AS broken FROM r) SELECT count(*) FILTER (WHERE NOT broken) AS valid, count(*) AS reports FROM v")
def report_validity(t: Tables) -> DataFrame:
    """Strict validity: warnings count. Broken ids are counted once, against all reports."""
    r = reports(t).withColumn("broken", F.coalesce(F.greatest(*(F.coalesce(F.expr(c), F.lit(False)) for _, c in RULES.values())), F.lit(True)))
    return r.agg(F.count_if(~F.col("broken")).alias("valid"), F.count("*").alias("reports"))


@query("evidence_coverage", _R + ", x AS (SELECT state, unnest(evidence) AS e FROM r) SELECT state, CASE WHEN count(*) = 0 THEN 1 ELSE round(CAST(count(*) FILTER (WHERE e.level <> 'N') AS DOUBLE) / count(*), 3) END AS coverage, count(*) AS n FROM x GROUP BY state")
def evidence_coverage(t: Tables) -> DataFrame:
    x = reports(t).select("state", F.explode("evidence").alias("e"))
    out = x.groupBy("state").agg(F.count_if(F.col("e.level") != "N").alias("with"), F.count("*").alias("n"))
    return out.select("state", F.when(F.col("n") == 0, 1.0).otherwise(F.round(F.col("with") / F.col("n"), 3)).alias("coverage"), "n")


@query("report_stats", _R + ", s AS (SELECT report_id, list_sum(list_transform(evidence, lambda x: x.score)) // len(evidence) AS score FROM r WHERE evidence IS NOT NULL) SELECT count(*) AS reports, CAST(round(least(100, greatest(0, avg(score)))) AS BIGINT) AS mean, max_by(report_id, struct_pack(score, d := -report_id)) AS best FROM s")
def report_stats(t: Tables) -> DataFrame:
    total = F.aggregate("evidence", F.lit(0).cast("long"), lambda a, x: a + x["score"])
    s = reports(t).filter("evidence is not null").select("report_id", total.alias("total"), F.size("evidence").alias("n")).withColumn("score", F.expr("total div n"))
    return s.agg(F.count("*").alias("reports"), L.clamped(F.avg("score")).cast("long").alias("mean"), F.max_by("report_id", F.struct(F.col("score"), (-F.col("report_id")).alias("d"))).alias("best"))


@query("dangling_refs", with_sql("user_events", "policies") + " SELECT policy_ref, count(*) AS n FROM user_events e WHERE policy_ref IS NOT NULL AND NOT EXISTS (SELECT 1 FROM policies p WHERE p.policy_id = e.policy_ref) GROUP BY policy_ref")
def dangling_refs(t: Tables) -> DataFrame:
    refs = t.user_events().filter("policy_ref is not null").groupBy("policy_ref").agg(F.count("*").alias("n"))
    return dangling(refs, "policy_ref", t.policies(), "policy_id")


@query("registry_antijoin", "SELECT 'unregistered' AS side, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'missing', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0)")
def registry_antijoin(t: Tables) -> DataFrame:
    d, l = t.raw("documents").select("doc_id"), t.raw("labels").select("doc_id")
    one = d.join(l, "doc_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("unregistered").alias("side"), "n")
    other = l.join(d.filter("doc_id % 5 <> 0"), "doc_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("missing").alias("side"), "n")
    return one.unionByName(other)


@query("coverage_by_source", "SELECT source, count(*) AS documents, count(l.doc_id) AS labelled, round(CAST(count(l.doc_id) AS DOUBLE) / count(*), 3) AS ratio FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def coverage_by_source(t: Tables) -> DataFrame:
    j = t.raw("documents").select("doc_id", "source").join(t.raw("labels").select("doc_id", F.lit(1).alias("one")), "doc_id", "left")
    return j.groupBy("source").agg(F.count("*").alias("documents"), F.count("one").alias("labelled")).withColumn("ratio", F.round(F.col("labelled") / F.col("documents"), 3))


@query("duplicate_ids", "SELECT o_custkey, CAST(o_orderdate AS VARCHAR) AS day, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(t: Tables) -> DataFrame:
    o = t.raw("orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("day"))
    return validation.duplicate_keys(o, "o_custkey", "day")


@query(
    "company_lookup",
    """WITH w AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 150 END AS id, CASE WHEN c_custkey % 2 = 0 THEN 'Supplier#' || (c_custkey % 90) END AS name, c_nationkey AS ticker FROM customer),
  a AS (SELECT s_suppkey AS id, s_suppkey AS hit FROM supplier), b AS (SELECT 'Supplier#' || s_suppkey AS name, min(s_suppkey) AS hit FROM supplier GROUP BY 1), c AS (SELECT s_nationkey AS ticker, min(s_suppkey) AS hit FROM supplier GROUP BY 1)
  SELECT c_custkey, CAST(CASE WHEN a.hit IS NOT NULL THEN 0 WHEN b.hit IS NOT NULL THEN 1 WHEN c.hit IS NOT NULL THEN 2 END AS INTEGER) AS rule, coalesce(a.hit, b.hit, c.hit) AS hit
  FROM w LEFT JOIN a USING (id) LEFT JOIN b USING (name) LEFT JOIN c USING (ticker)""",
)
def company_lookup(t: Tables) -> DataFrame:
    """By id, else by name, else by ticker; the first rule that finds one wins."""
    c = F.col("c_custkey")
    wanted = t.raw("customer").select(c, F.when(c % 3 == 0, c % 150).alias("id"), F.when(c % 2 == 0, F.concat(F.lit("Supplier#"), (c % 90).cast("string"))).alias("name"), F.col("c_nationkey").alias("ticker"))
    known = t.raw("supplier").select(F.col("s_suppkey").alias("hit"), F.col("s_suppkey").alias("kid"), F.concat(F.lit("Supplier#"), F.col("s_suppkey").cast("string")).alias("kname"), F.col("s_nationkey").alias("kticker"))
    return first_match(wanted, known, [("id", "kid"), ("name", "kname"), ("ticker", "kticker")], ["hit"], "hit").select("c_custkey", "rule", "hit")


_EDGES = "WITH e AS (SELECT 's' || s_suppkey AS source, 'n' || s_nationkey AS target FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"


def graph(t: Tables) -> DataFrame:
    edge = lambda a, p, b, q: [F.concat(F.lit(p), F.col(a).cast("string")).alias("source"), F.concat(F.lit(q), F.col(b).cast("string")).alias("target")]
    return t.raw("supplier").select(*edge("s_suppkey", "s", "s_nationkey", "n")).unionByName(t.raw("nation").select(*edge("n_nationkey", "n", "n_regionkey", "r")))


for _direction, _sql in (("up", "target = 'n3'"), ("down", "source = 'n3'"), ("both", "source = 'n3' OR target = 'n3'")):

    @query(f"graph_{_direction}", _EDGES + f" SELECT * FROM e WHERE {_sql}")
    def _graph(t: Tables, direction: str = _direction) -> DataFrame:
        return neighbours(graph(t), "n3", direction)


@query("node_fallback", "SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 4 <> 0 THEN s_name END, n_name, 'unknown') AS name, coalesce(nullif(CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'own' END, ''), r_name) AS section FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey % 5 <> 0 LEFT JOIN region ON r_regionkey = n_regionkey")
def node_fallback(t: Tables) -> DataFrame:
    """A node's own values, else its canonical node's, else a default; blanks count as missing."""
    s = t.raw("supplier")
    n = t.raw("nation").filter("n_nationkey % 5 <> 0").join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    j = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    own = F.when(F.col("s_suppkey") % 4 != 0, F.col("s_name"))
    return j.select("s_suppkey", F.coalesce(own, "n_name", F.lit("unknown")).alias("name"), F.coalesce(F.nullif(F.when(F.col("s_suppkey") % 3 == 0, "").otherwise("own"), F.lit("")), F.col("r_name")).alias("section"))


@query("signal_counts", "SELECT l.label, count(e.event_id) AS n FROM (SELECT unnest(['view', 'click', 'purchase', 'refund', 'share']) AS label) l LEFT JOIN events e ON e.event_type = l.label GROUP BY l.label")
def signal_counts(t: Tables) -> DataFrame:
    """A count for each label of a fixed list, zero for those without events."""
    wanted = t.spark.createDataFrame([(x,) for x in ("view", "click", "purchase", "refund", "share")], "label string")
    counts = t.raw("events").groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("n"))
    return wanted.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


_BAND = "CASE WHEN {x} >= 85 THEN 'high' WHEN {x} >= 70 THEN 'good' WHEN {x} >= 50 THEN 'fair' ELSE 'low' END"


@query("confidence_bands", f"SELECT {_BAND.format(x='p_partkey % 101')} AS band, CASE WHEN p_partkey % 101 >= 80 THEN 'strong' WHEN p_partkey % 101 >= 60 THEN 'medium' ELSE 'weak' END AS level, count(*) AS n FROM part GROUP BY ALL")
def confidence_bands(t: Tables) -> DataFrame:
    x = F.col("p_partkey") % 101
    return t.raw("part").groupBy(L.banded(x).alias("band"), L.banded(x, L.LEVELS, "weak").alias("level")).agg(F.count("*").alias("n"))


@query("score_caps", "SELECT level, count(*) FILTER (WHERE score > cap) AS over, max(least(score, cap)) AS capped FROM (SELECT ['strong', 'medium', 'weak', 'none'][p_partkey % 4 + 1] AS level, p_partkey % 101 AS score, [100, 74, 64, 70][p_partkey % 4 + 1] AS cap FROM part) GROUP BY level")
def score_caps(t: Tables) -> DataFrame:
    p = F.col("p_partkey")
    level = F.element_at(F.array(*map(F.lit, L.CAPS)), (p % 4 + 1).cast("int"))
    cap = F.element_at(F.create_map(*(F.lit(x) for kv in L.CAPS.items() for x in kv)), F.col("level"))
    s = t.raw("part").select(level.alias("level"), (p % 101).alias("score")).withColumn("cap", cap)
    return s.groupBy("level").agg(F.count_if(F.col("score") > F.col("cap")).alias("over"), F.max(F.least("score", "cap")).alias("capped"))


@query("weak_majority", "SELECT n_nationkey, weak >= greatest(2, CAST(ceil(n / 2.0) AS BIGINT)) AS mostly_weak, weak, n FROM (SELECT c_nationkey AS n_nationkey, count(*) FILTER (WHERE c_acctbal < 3000) AS weak, count(*) AS n FROM customer GROUP BY 1)")
def weak_majority(t: Tables) -> DataFrame:
    c = t.raw("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count_if(F.col("c_acctbal") < 3000).alias("weak"), F.count("*").alias("n"))
    return c.select("n_nationkey", (F.col("weak") >= F.greatest(F.lit(2), F.ceil(F.col("n") / 2))).alias("mostly_weak"), "weak", "n")


@query("report_search", with_sql("policies") + " SELECT policy_no, title, issuer FROM policies WHERE contains(lower(title || ' ' || issuer || ' ' || category), 'the') ORDER BY policy_no LIMIT 6")
def report_search(t: Tables) -> DataFrame:
    found = t.policies().filter(F.contains(F.lower(F.concat_ws(" ", "title", "issuer", "category")), F.lit("the")))
    return page(found, [F.asc("policy_no")], 6).select("policy_no", "title", "issuer")


@query("published_reports", with_sql("policies", "queue") + " SELECT policy_no, title, CAST(dated AS VARCHAR) AS dated FROM queue WHERE complete AND NOT duplicate AND dated IS NOT NULL ORDER BY queue.dated DESC, policy_no")
def published_reports(t: Tables) -> DataFrame:
    return t.queue().filter("complete and not duplicate and dated is not null").select("policy_no", "title", F.col("dated").cast("string").alias("dated"))


@query("report_by_id", with_sql("policies") + " SELECT policy_no, policy_id, external_id FROM policies WHERE policy_id = '55' OR external_id = '55' ORDER BY CASE WHEN policy_id = '55' THEN 0 ELSE 1 END, created_minute DESC, policy_no DESC LIMIT 1")
def report_by_id(t: Tables) -> DataFrame:
    found = t.policies().filter("policy_id = '55' or external_id = '55'")
    return page(found, [F.when(F.col("policy_id") == "55", 0).otherwise(1), F.desc("created_minute"), F.desc("policy_no")], 1).select("policy_no", "policy_id", "external_id")


@query("category_pivot", "SELECT lang, count(*) FILTER (WHERE source = 'src0') AS src0, count(*) FILTER (WHERE source = 'src1') AS src1, count(*) FILTER (WHERE source = 'src2') AS src2 FROM documents GROUP BY lang")
def category_pivot(t: Tables) -> DataFrame:
    return t.raw("documents").groupBy("lang").pivot("source", ["src0", "src1", "src2"]).count().na.fill(0)


@query("policy_sets", "WITH a AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS x FROM events WHERE event_id % 5 = 0 GROUP BY 1), b AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS y FROM events WHERE event_id % 5 = 1 GROUP BY 1) SELECT user_id, array_to_string(list_sort(list_intersect(x, y)), ',') AS both, round(CAST(len(list_intersect(x, y)) AS DOUBLE) / len(list_distinct(list_concat(x, y))), 4) AS jaccard, x = y AS equal FROM a JOIN b USING (user_id)")
def policy_sets(t: Tables) -> DataFrame:
    from quill.operators.textrules import jaccard

    side = lambda k, n: t.raw("events").filter(F.col("event_id") % 5 == k).groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias(n))
    j = side(0, "x").join(side(1, "y"), "user_id")
    return j.select("user_id", F.array_join(F.array_sort(F.array_intersect("x", "y")), ",").alias("both"), F.round(jaccard(F.col("x"), F.col("y")), 4).alias("jaccard"), (F.col("x") == F.col("y")).alias("equal"))


@query("duration_labels", "SELECT event_id, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms // 1000 < 60 THEN (ms // 1000) || 's' WHEN ms // 1000 < 3600 THEN (ms // 60000) || 'm' || (ms // 1000 % 60) || 's' ELSE (ms // 3600000) || 'h' || (ms // 1000 % 3600 // 60) || 'm' END AS label FROM (SELECT event_id, CAST(floor(value * 1000) AS BIGINT) * (1 + event_id % 3 * 50) AS ms FROM events)")
def duration_labels(t: Tables) -> DataFrame:
    ms = F.floor(F.col("value") * 1000).cast("long") * (1 + F.col("event_id") % 3 * 50)
    return t.raw("events").select("event_id", L.duration(ms).alias("label"))


@query("event_labels", "SELECT event_type, CASE event_type WHEN 'view' THEN 'Viewed' ELSE upper(event_type[1]) || event_type[2:] END AS label, count(*) AS n FROM events GROUP BY ALL")
def event_labels(t: Tables) -> DataFrame:
    return t.raw("events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("label", L.labelled(F.col("event_type"), {"view": "Viewed"}))


@query("timeline_merge", "SELECT * FROM (SELECT doc_id AS item, 'policy' AS kind, CASE WHEN doc_id % 17 <> 4 THEN doc_id % 90 END AS day FROM documents UNION ALL SELECT o_orderkey, 'job', CAST(o_orderdate AS DATE) - DATE '1995-01-01' FROM orders) ORDER BY day NULLS LAST, kind, item LIMIT 120")
def timeline_merge(t: Tables) -> DataFrame:
    d = t.raw("documents").select(F.col("doc_id").alias("item"), F.lit("policy").alias("kind"), F.when(F.col("doc_id") % 17 != 4, F.col("doc_id") % 90).alias("day"))
    o = t.raw("orders").select(F.col("o_orderkey").alias("item"), F.lit("job").alias("kind"), F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("long").alias("day"))
    return page(d.unionByName(o), [F.asc_nulls_last("day"), F.asc("kind"), F.asc("item")], 120)


@query("first_policy_titles", with_sql("user_events", "policies") + " SELECT e.module_id, count(*) AS n, count(p.title) AS titled FROM user_events e LEFT JOIN policies p ON p.policy_id = e.policy_ref WHERE module_id IS NOT NULL GROUP BY 1")
def first_policy_titles(t: Tables) -> DataFrame:
    e = t.user_events().filter("module_id is not null")
    p = t.policies().select(F.col("policy_id").alias("policy_ref"), "title")
    return e.join(p, "policy_ref", "left").groupBy("module_id").agg(F.count("*").alias("n"), F.count("title").alias("titled"))


@query("enriched_by_category", with_sql("user_events", "policies") + ", p AS (SELECT policy_id, category FROM policies) SELECT coalesce(category, 'none') AS category, count(*) AS n FROM user_events e LEFT JOIN LATERAL (SELECT * FROM policies pol WHERE pol.policy_id = e.policy_ref OR pol.external_id = e.policy_ref ORDER BY CASE WHEN pol.policy_id = e.policy_ref THEN 0 ELSE 1 END, created_minute DESC, policy_no DESC LIMIT 1) x ON true GROUP BY 1")
def enriched_by_category(t: Tables) -> DataFrame:
    return enriched(t).groupBy(F.coalesce("category", F.lit("none")).alias("category")).agg(F.count("*").alias("n"))


@query("unsupported_claims")
def unsupported_claims(t: Tables) -> DataFrame:
    """Texts with a forbidden word that no negation precedes closely."""
    bad = validation.forbidden(F.lower("text"), ["scum", "idiot", "trash"], ["not ", "no ", "of "])
    return t.raw("documents").filter(bad).select("doc_id")
