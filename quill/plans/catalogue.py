"""Registries, evidence, companies, composed reports, and small lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.functions import identity as I
from quill.operators import companies, textrules, validation
from quill.operators.joins import page, top_per
from quill.plans.base import query
from quill.plans.documents import _RULES, _VOCAB
from quill.sources.tables import Tables, with_sql

_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"


@query(
    "registry_match",
    f"""WITH p AS (SELECT page_id, url, {_HOST} AS host FROM pages), reg AS (SELECT host, url AS base, min(page_id) AS entry FROM p WHERE page_id % 3 = 0 GROUP BY ALL), wide AS (SELECT host, min(entry) AS entry FROM reg GROUP BY host),
  pre AS (SELECT p.page_id, min(r.entry) AS entry FROM p JOIN reg r ON p.host = r.host AND starts_with(p.url, r.base) GROUP BY 1)
  SELECT p.page_id, coalesce(pre.entry, wide.entry) AS entry, CASE WHEN pre.entry IS NOT NULL THEN 'prefix' WHEN wide.entry IS NOT NULL THEN 'host' ELSE 'none' END AS how FROM p LEFT JOIN pre USING (page_id) LEFT JOIN wide ON wide.host = p.host""",
)
def registry_match(t: Tables) -> DataFrame:
    """A page's registered source: by an address that it starts with, else by host.

    All addresses of a host count. A page meets them by its own beginnings of the lengths that its host's addresses have, so
    the join is on equal texts, and a host with very many addresses is spread by them.
    """
    p = t.raw("pages").select("page_id", "url", I.host(F.col("url")).alias("host"))
    reg = p.filter("page_id % 3 = 0").groupBy("host", F.col("url").alias("base")).agg(F.min("page_id").alias("entry"))
    hosts = reg.groupBy("host").agg(F.min("entry").alias("any"), F.collect_set(F.length("base")).alias("sizes"))
    known = p.join(hosts, "host", "left")
    begins = known.select("page_id", "host", "url", F.explode("sizes").alias("size")).filter("size <= length(url)").select("page_id", "host", F.left("url", F.col("size")).alias("base"))
    found = begins.join(reg, ["host", "base"]).groupBy("page_id").agg(F.min("entry").alias("entry"))
    how = F.when(F.col("entry").isNotNull(), "prefix").when(F.col("any").isNotNull(), "host").otherwise("none")
    return known.select("page_id", "any").join(found, "page_id", "left").select("page_id", F.coalesce("entry", "any").alias("entry"), how.alias("how"))


@query(
    "evidence_overlap",
    """WITH e AS (SELECT l_orderkey, l_linenumber AS line, l_suppkey % 10 AS clause FROM lineitem) SELECT a.l_orderkey, a.line AS a, b.line AS b, count(*) AS shared FROM e a JOIN e b ON a.l_orderkey = b.l_orderkey AND a.clause = b.clause AND a.line < b.line GROUP BY ALL""",
)
def evidence_overlap(t: Tables) -> DataFrame:
    """Evidence of one report that shares clauses: an equi-join on report and clause, and a count."""
    e = t.raw("lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), (F.col("l_suppkey") % 10).alias("clause"))
    a, b = e.withColumnRenamed("line", "a"), e.withColumnRenamed("line", "b")
    return a.join(b, ["l_orderkey", "clause"]).filter("a < b").groupBy("l_orderkey", "a", "b").agg(F.count("*").alias("shared"))


@query("policy_pages", r"SELECT page_id FROM pages WHERE NOT regexp_matches(url, '/(en|fr)/\d*[05]([?#]|$)') AND NOT contains(url, 'blog.')")
def policy_pages(t: Tables) -> DataFrame:
    """What a source's address rules leave."""
    return t.raw("pages").filter(~F.col("url").rlike(r"/(en|fr)/\d*[05]([?#]|$)") & ~F.contains("url", F.lit("blog."))).select("page_id")


@query("attachment_links", "WITH l AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1))) AS link FROM pages), k AS (SELECT *, CASE WHEN regexp_matches(link, '[A-Z]') THEN 'upper' WHEN length(link) > 8 THEN 'long' ELSE 'short' END AS kind, row_number() OVER (PARTITION BY page_id ORDER BY link) AS r FROM l) SELECT page_id, kind, count(*) AS n FROM k WHERE r <= 32 GROUP BY ALL")
def attachment_links(t: Tables) -> DataFrame:
    """A page's distinct links, typed, 32 of them at most."""
    links = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1)))), 1, 32)
    kind = F.when(F.col("link").rlike("[A-Z]"), "upper").when(F.length("link") > 8, "long").otherwise("short")
    return t.raw("pages").select("page_id", F.explode(links).alias("link")).groupBy("page_id", kind.alias("kind")).agg(F.count("*").alias("n"))


@query("extraction_rollup", "SELECT source, count(*) AS n, count(*) FILTER (WHERE n_chars >= 280) AS with_text, CASE WHEN count(*) FILTER (WHERE n_chars >= 280) = count(*) THEN 'complete' WHEN count(*) FILTER (WHERE n_chars >= 280) * 2 >= count(*) THEN 'partial' ELSE 'poor' END AS status FROM documents GROUP BY source")
def extraction_rollup(t: Tables) -> DataFrame:
    d = t.raw("documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") >= 280).alias("with_text"))
    return d.withColumn("status", F.when(F.col("with_text") == F.col("n"), "complete").when(F.col("with_text") * 2 >= F.col("n"), "partial").otherwise("poor"))


@query("company_candidates")
def company_candidates(t: Tables) -> DataFrame:
    """Each rule brings four companies, neighbours share some; rules come by score."""
    ranked = top_per(textrules.rule_scores(t.raw("documents"), _VOCAB), ["doc_id"], [F.desc("score"), F.asc("rule")], 5)
    number = F.substring("rule", 2, 2).cast("long")
    hits = ranked.select("doc_id", "rank", "score", number.alias("r"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("place"))
    return companies.candidates(hits.select("doc_id", "rank", "place", F.concat(F.lit("c"), (F.col("r") * 2 + F.col("place")).cast("string")).alias("company"), (F.col("score") + F.col("place")).alias("relevance"), (90 - F.col("rank") * 2).cast("long").alias("certainty")), 6)


_META = "CASE event_id % 4 WHEN 0 THEN '{\"pageTitle\": \"a' || k || '\"}' WHEN 1 THEN '{\"data\": {\"page_title\": \"b' || k || '\"}}' WHEN 2 THEN '{\"payload\": {\"report\": {\"pageTitle\": \"c\"}}}' ELSE '{}' END"


@query("metadata_lookup", with_sql("user_events") + f", m AS (SELECT event_id, {_META} AS j FROM ue0) SELECT event_id, coalesce(json_extract_string(j, '$.pageTitle'), json_extract_string(j, '$.page_title'), json_extract_string(j, '$.data.pageTitle'), json_extract_string(j, '$.data.page_title'), json_extract_string(j, '$.payload.report.pageTitle')) AS title FROM m")
def metadata_lookup(t: Tables) -> DataFrame:
    """The first of several spellings, at the top, then in containers."""
    k = F.get_json_object("props", "$.k")
    e = F.col("event_id") % 4
    j = F.when(e == 0, F.concat(F.lit('{"pageTitle": "a'), k, F.lit('"}'))).when(e == 1, F.concat(F.lit('{"data": {"page_title": "b'), k, F.lit('"}}'))).when(e == 2, '{"payload": {"report": {"pageTitle": "c"}}}').otherwise("{}")
    at = ["$.pageTitle", "$.page_title", "$.data.pageTitle", "$.data.page_title", "$.payload.report.pageTitle"]
    v = F.parse_json("j")
    return t.raw("events").select("event_id", j.alias("j")).select("event_id", F.coalesce(*(F.try_variant_get(v, p, "string") for p in at)).alias("title"))


@query("metadata_merge", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS a, 'old' AS b, CASE WHEN c_custkey % 2 = 0 THEN 'added' END AS c FROM customer")
def metadata_merge(t: Tables) -> DataFrame:
    """Right wins where both have a key."""
    old = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("old"))
    new = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("a"), F.lit("new"), F.lit("c"), F.lit("added"))).otherwise(F.create_map().cast("map<string,string>"))
    m = F.map_zip_with(old, new, lambda _, x, y: F.coalesce(y, x))
    return t.raw("customer").select("c_custkey", m.alias("m")).select("c_custkey", *(F.try_element_at("m", F.lit(k)).alias(k) for k in "abc"))


@query("enum_synonyms", "SELECT o_orderpriority, CASE WHEN lower(o_orderpriority) LIKE '1%' OR lower(o_orderpriority) LIKE '%urgent%' THEN 'strong' WHEN lower(o_orderpriority) LIKE '2%' OR lower(o_orderpriority) LIKE '3%' THEN 'medium' ELSE 'weak' END AS level, count(*) AS n FROM orders GROUP BY ALL")
def enum_synonyms(t: Tables) -> DataFrame:
    low = F.lower("o_orderpriority")
    level = F.when(low.like("1%") | low.like("%urgent%"), "strong").when(low.like("2%") | low.like("3%"), "medium").otherwise("weak")
    return t.raw("orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).withColumn("level", level)


@query(
    "copy_consistency",
    "WITH b AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS base FROM lineitem GROUP BY 1), m AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS map FROM lineitem WHERE l_linenumber < 6 GROUP BY 1) SELECT l_orderkey, CASE WHEN map IS NULL THEN 'missing' WHEN map = base THEN 'equal' ELSE 'differs' END AS verdict, CAST(len(base) - coalesce(len(map), 0) AS BIGINT) AS short FROM b LEFT JOIN m USING (l_orderkey)",
)
def copy_consistency(t: Tables) -> DataFrame:
    """Two copies of a list, compared as sets, in one pass over the rows."""
    g = t.raw("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("base"), F.array_sort(F.collect_set(F.when(F.col("l_linenumber") < 6, F.col("l_suppkey")))).alias("map"))
    verdict = F.when(F.size("map") == 0, "missing").when(F.col("map") == F.col("base"), "equal").otherwise("differs")
    return g.select("l_orderkey", verdict.alias("verdict"), (F.size("base") - F.size("map")).cast("long").alias("short"))


@query("module_order", "SELECT session_id, mods = list_sort(mods) AS in_order, CAST(len(mods) AS BIGINT) AS n FROM (SELECT session_id, list(module_id ORDER BY occurred_at, event_id) FILTER (WHERE module_id IS NOT NULL) AS mods FROM (" + with_sql("user_events") + " SELECT * FROM user_events) GROUP BY 1) WHERE mods IS NOT NULL")
def module_order(t: Tables) -> DataFrame:
    """Whether a session met its modules in their canonical order."""
    rows = t.user_events().filter("module_id is not null").groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("occurred_at", "event_id", "module_id"))), lambda r: r["module_id"]).alias("mods"))
    return rows.select("session_id", (F.col("mods") == F.array_sort("mods")).alias("in_order"), F.size("mods").cast("long").alias("n"))


@query("display_dedupe", "SELECT key, min(doc_id) AS doc_id, count(*) AS n FROM (SELECT doc_id, replace(substr(text, 1, 12), ' ', '') || '/' || (doc_id % 5) AS key FROM documents) GROUP BY key")
def display_dedupe(t: Tables) -> DataFrame:
    key = F.concat(F.replace(F.substring("text", 1, 12), F.lit(" "), F.lit("")), F.lit("/"), (F.col("doc_id") % 5).cast("string"))
    return t.raw("documents").select("doc_id", key.alias("key")).groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("company_search", "SELECT n_name AS section, count(*) AS n, min(s_suppkey) AS first FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE contains(lower(s_name || ' ' || n_name), '1') GROUP BY n_name, n_nationkey")
def company_search(t: Tables) -> DataFrame:
    """Companies whose text has the query, by section; sections without any don't appear."""
    j = t.raw("supplier").join(t.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.filter(F.contains(F.lower(F.concat_ws(" ", "s_name", "n_name")), F.lit("1"))).groupBy(F.col("n_name").alias("section"), "n_nationkey").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("first")).drop("n_nationkey")


@query("matrix_scale", "WITH b AS (SELECT min(p_partkey) AS lo, max(p_partkey) AS hi FROM part) SELECT p_partkey, CAST(floor(1000.0 * (p_partkey - lo) / greatest(hi - lo, 1)) AS BIGINT) AS x FROM part, b")
def matrix_scale(t: Tables) -> DataFrame:
    """Scaled by the least and the largest value, which is one row."""
    b = t.raw("part").agg(F.min("p_partkey").alias("lo"), F.max("p_partkey").alias("hi"))
    return t.raw("part").select("p_partkey").join(F.broadcast(b)).select("p_partkey", F.floor(1000.0 * (F.col("p_partkey") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))).alias("x"))


@query("garbled_text", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[ÃÂâ�]')) AS BIGINT) AS marks, len(regexp_extract_all(text, '[ÃÂâ�]')) > 3 AS garbled FROM documents")
def garbled_text(t: Tables) -> DataFrame:
    n = F.regexp_count("text", F.lit("[ÃÂâ�]"))
    return t.raw("documents").select("doc_id", n.cast("long").alias("marks"), (n > 3).alias("garbled"))


@query("pairwise_identity", "WITH d AS (SELECT doc_id, sha256(text) AS h, doc_id % 700 AS u FROM documents) SELECT a.doc_id AS a, b.doc_id AS b, a.h = b.h AS same_text, a.u = b.u AS same_url FROM d a JOIN d b ON b.doc_id = a.doc_id + 1")
def pairwise_identity(t: Tables) -> DataFrame:
    """Neighbouring pairs and what they share."""
    d = t.raw("documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"), (F.col("doc_id") % 700).alias("u"))
    b = d.select(F.col("doc_id").alias("b"), F.col("h").alias("bh"), F.col("u").alias("bu"), (F.col("doc_id") - 1).alias("a"))
    return d.select(F.col("doc_id").alias("a"), "h", "u").join(b, "a").select("a", "b", (F.col("h") == F.col("bh")).alias("same_text"), (F.col("u") == F.col("bu")).alias("same_url"))


@query(
    "quality_metrics",
    "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS companies, count(DISTINCT l_suppkey) FILTER (WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 10)) AS independent FROM lineitem GROUP BY 1",
)
def quality_metrics(t: Tables) -> DataFrame:
    """Companies with independent evidence: membership is joined once, to the distinct companies."""
    known = t.raw("supplier").filter("s_nationkey < 10").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(1).alias("own"))
    pairs = t.raw("lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.count("*").alias("k"))
    return pairs.join(known, "l_suppkey", "left").groupBy("l_returnflag").agg(F.sum("k").alias("n"), F.count("*").alias("companies"), F.count("own").alias("independent"))


@query("crawl_counts", "WITH c AS (SELECT page_id, split_part(url, '#', 1) AS u FROM pages), d AS (SELECT u, min(page_id) AS keep, count(*) AS n FROM c GROUP BY u) SELECT CAST(sum(n) AS BIGINT) AS collected, count(*) AS canonical, CAST(sum(n - 1) AS BIGINT) AS duplicates, count(*) FILTER (WHERE keep % 3 = 0) AS planned FROM d")
def crawl_counts(t: Tables) -> DataFrame:
    """Collected, kept, left out and planned pages of a run."""
    c = t.raw("pages").select("page_id", F.split_part("url", F.lit("#"), F.lit(1)).alias("u"))
    d = c.groupBy("u").agg(F.min("page_id").alias("keep"), F.count("*").alias("n"))
    return d.agg(F.sum("n").alias("collected"), F.count("*").alias("canonical"), F.sum(F.col("n") - 1).alias("duplicates"), F.count_if(F.col("keep") % 3 == 0).alias("planned"))


_NEAR = "CASE WHEN least(length(k), length(y[1])) < 80 THEN k = y[1] ELSE contains(k, y[1]) OR contains(y[1], k) OR (left(k, 240) = left(y[1], 240) AND right(k, 240) = right(y[1], 240)) END"


@query(
    "composed_evidence",
    f"""WITH w AS (SELECT conv_id, turn, text, lower(trim(substr(text, 1, 20))) AS title FROM conversations), f AS (SELECT conv_id, title, min(turn) AS turn, arg_min(text, turn) AS text FROM w WHERE text IS NOT NULL GROUP BY ALL),
  g AS (SELECT conv_id, min(turn) AS first, list(text ORDER BY turn) AS texts FROM f GROUP BY conv_id),
  c AS (SELECT conv_id, first, list_reduce(list_transform(texts, lambda x: [x]), lambda acc, y: CASE WHEN len(list_filter(acc, lambda k: {_NEAR})) > 0 THEN acc ELSE list_concat(acc, y) END) AS kept FROM g)
  SELECT conv_id, first, len(kept) AS parts, sha256(array_to_string(kept, chr(10))) AS digest FROM c""",
)
def composed_evidence(t: Tables) -> DataFrame:
    """The first text of each logical title, but for those that nearly repeat one before: equal below 80 characters, else contained or alike at both ends.

    A group is one conversation; its texts are folded in order within their row.
    """
    w = t.raw("conversations").filter("text is not null").select("conv_id", "turn", "text", F.lower(F.trim(F.substring("text", 1, 20))).alias("title"))
    f = w.groupBy("conv_id", "title").agg(F.min("turn").alias("turn"), F.min_by("text", "turn").alias("text"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    g = f.groupBy("conv_id").agg(F.min("turn").alias("first"), texts.alias("texts"))
    ends = lambda a, b: (F.left(a, F.lit(240)) == F.left(b, F.lit(240))) & (F.right(a, F.lit(240)) == F.right(b, F.lit(240)))
    near = lambda a, b: F.when(F.least(F.length(a), F.length(b)) < 80, a == b).otherwise(F.contains(a, b) | F.contains(b, a) | ends(a, b))
    kept = F.aggregate("texts", F.array().cast("array<string>"), lambda acc, y: F.when(F.exists(acc, lambda k: near(k, y)), acc).otherwise(F.concat(acc, F.array(y))))
    return g.withColumn("kept", kept).select("conv_id", "first", F.size("kept").cast("long").alias("parts"), F.sha2(F.array_join("kept", "\n").cast("binary"), 256).alias("digest"))


@query("row_policy", with_sql("policies", "queue") + " SELECT policy_no FROM queue WHERE complete AND NOT duplicate OR issuer = 'src3'")
def row_policy(t: Tables) -> DataFrame:
    """What a reader of one source may see: a filter that every scan gets."""
    return t.queue().filter("complete and not duplicate or issuer = 'src3'").select("policy_no")


@query("constraint_checks", "SELECT event_id, 'value' AS code FROM events WHERE value < 0.05 UNION ALL SELECT event_id, 'type' FROM events WHERE event_type NOT IN ('view', 'click', 'purchase', 'signup')")
def constraint_checks(t: Tables) -> DataFrame:
    return validation.violations(t.raw("events"), "event_id", {"value": ("error", "value < 0.05"), "type": ("error", "event_type not in ('view', 'click', 'purchase', 'signup')")}).select("event_id", "code")


@query("preferred_order", "SELECT n_name, CAST(row_number() OVER (ORDER BY CASE n_nationkey WHEN 7 THEN 0 WHEN 3 THEN 1 ELSE 2 END, n_name) AS INTEGER) AS place FROM nation QUALIFY place <= 10")
def preferred_order(t: Tables) -> DataFrame:
    """A pinned list first, then by name."""
    from pyspark.sql import Window

    pin = F.when(F.col("n_nationkey") == 7, 0).when(F.col("n_nationkey") == 3, 1).otherwise(2)
    head = page(t.raw("nation"), [pin, F.asc("n_name")], 10)
    return head.select("n_name", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(pin, "n_name")).alias("place"))
