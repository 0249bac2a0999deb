"""Collection-run audits: gaps, streaks, first sight, freshness, recovery, violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.operators.joins import page
from quill.operators.runs import freshness, gaps, streaks
from quill.plans.base import query
from quill.sources.tables import Tables, with_sql

_RUNS, _HEALTH = with_sql("runs"), with_sql("health")
#: 2024-01-31 00:00:00 UTC.
NOW = 1706659200


@query("run_gaps", _RUNS + " SELECT run, seen_at, seen_at - lag(seen_at) OVER (ORDER BY seen_at) AS gap FROM runs")
def run_gaps(t: Tables) -> DataFrame:
    return gaps(t.runs(), "seen_at").select("run", "seen_at", "gap")


@query("run_gap_summary", _RUNS + " SELECT count(*) AS runs, max(gap) AS longest, count(*) FILTER (WHERE gap > 3900) AS late, count(*) FILTER (WHERE gap < 900) AS close FROM (SELECT seen_at - lag(seen_at) OVER (ORDER BY seen_at) AS gap FROM runs)")
def run_gap_summary(t: Tables) -> DataFrame:
    return gaps(t.runs(), "seen_at").agg(F.count("*").alias("runs"), F.max("gap").alias("longest"), F.count_if(F.col("gap") > 3900).alias("late"), F.count_if(F.col("gap") < 900).alias("close"))


@query(
    "failure_streaks",
    _HEALTH + """, w AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY run) - row_number() OVER (PARTITION BY source, status = 'failed' ORDER BY run) AS g FROM health)
  SELECT source, min(run) AS first, max(run) AS last, count(*) AS length FROM w WHERE status = 'failed' GROUP BY source, g""",
)
def failure_streaks(t: Tables) -> DataFrame:
    return streaks(t.health(), ["source"], "run", F.col("status") == "failed")


@query(
    "longest_streaks",
    _HEALTH + """, w AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY run) - row_number() OVER (PARTITION BY source, status = 'failed' ORDER BY run) AS g FROM health)
  SELECT source, max(n) AS longest, count(*) AS streaks FROM (SELECT source, g, count(*) AS n FROM w WHERE status = 'failed' GROUP BY ALL) GROUP BY source""",
)
def longest_streaks(t: Tables) -> DataFrame:
    return failure_streaks(t).groupBy("source").agg(F.max("length").alias("longest"), F.count("*").alias("streaks"))


@query("latest_status", _HEALTH + " SELECT source, max(run) AS run, arg_max(status, run) AS status FROM health GROUP BY source")
def latest_status(t: Tables) -> DataFrame:
    return t.health().groupBy("source").agg(F.max("run").alias("run"), F.max_by("status", "run").alias("status"))


@query(
    "source_health",
    _HEALTH + """ SELECT source, count(*) AS runs, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'partial') AS partial, count(*) FILTER (WHERE status = 'failed') AS failed,
  round(CAST(count(*) FILTER (WHERE status = 'ok') AS DOUBLE) / count(*), 3) AS ok_rate FROM health GROUP BY source""",
)
def source_health(t: Tables) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("ok", "partial", "failed")]
    return t.health().groupBy("source").agg(F.count("*").alias("runs"), *counts).withColumn("ok_rate", F.round(F.col("ok") / F.col("runs"), 3))


@query("missing_health", _HEALTH + ", k AS (SELECT DISTINCT run FROM health), s AS (SELECT unnest([0, 1, 2, 3, 4]) AS source) SELECT k.run, CAST(s.source AS BIGINT) AS source, coalesce(status, 'missing') AS status FROM k CROSS JOIN s LEFT JOIN health h ON h.run = k.run AND h.source = s.source")
def missing_health(t: Tables) -> DataFrame:
    """Every run with every registered source; what a run says nothing of is missing. Five sources are spread out by explode, not by a cross join."""
    h = t.health()
    wanted = h.select("run").distinct().withColumn("source", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    return wanted.join(h.select("run", "source", "status"), ["run", "source"], "left").select("run", "source", F.coalesce("status", F.lit("missing")).alias("status"))


@query("first_seen", "SELECT user_id % 1000 AS identity, CAST(epoch(date_trunc('hour', min(ts))) AS BIGINT) AS first_run, count(DISTINCT date_trunc('hour', ts)) AS runs, count(DISTINCT date_trunc('hour', ts)) - 1 AS repeats FROM events GROUP BY 1")
def first_seen(t: Tables) -> DataFrame:
    e = t.raw("events").select((F.col("user_id") % 1000).alias("identity"), F.unix_seconds(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("run"))
    return e.groupBy("identity").agg(F.min("run").alias("first_run"), F.countDistinct("run").alias("runs")).withColumn("repeats", F.col("runs") - 1)


@query(
    "new_and_repeated",
    """WITH d AS (SELECT DISTINCT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS run, user_id FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY run) AS k FROM d)
  SELECT run, count(*) FILTER (WHERE k = 1) AS fresh, count(*) FILTER (WHERE k > 1) AS repeated FROM r GROUP BY run""",
)
def new_and_repeated(t: Tables) -> DataFrame:
    """Each run's identities, new or seen before: the first run of each is summed up, not ranked, so a hot identity is no window."""
    d = t.raw("events").select(F.unix_seconds(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("run"), "user_id").distinct()
    first = d.groupBy("user_id").agg(F.min("run").alias("first"))
    return d.join(first, "user_id").groupBy("run").agg(F.count_if(F.col("run") == F.col("first")).alias("fresh"), F.count_if(F.col("run") > F.col("first")).alias("repeated"))


@query("freshness_class", _HEALTH + f" SELECT source, ({NOW} - max(run)) // 60 AS age_minutes, CASE WHEN ({NOW} - max(run)) // 60 <= 80 THEN 'healthy' WHEN ({NOW} - max(run)) // 60 <= 160 THEN 'degraded' ELSE 'stale' END AS class FROM health WHERE status = 'ok' GROUP BY source")
def freshness_class(t: Tables) -> DataFrame:
    out = t.health().filter("status = 'ok'").groupBy("source").agg(F.max("run").alias("at"))
    return out.select("source", F.floor((F.lit(NOW) - F.col("at")) / 60).alias("age_minutes")).withColumn("class", freshness(F.col("age_minutes")))


@query(
    "recovery_decision",
    _HEALTH + f""", l AS (SELECT max(run) FILTER (WHERE source < 3 AND status = 'ok') AS scheduled, max(run) FILTER (WHERE source = 3 AND status = 'ok') AS recovered, count(*) FILTER (WHERE run > {NOW} - 3600 AND status = 'partial') AS active FROM health)
  SELECT greatest(scheduled, recovered) AS latest, CASE WHEN scheduled >= recovered THEN 'scheduled' ELSE 'recovery' END AS kind, active > 0 AS active,
  active = 0 AND ({NOW} - greatest(scheduled, recovered)) // 60 > 80 AS needed FROM l""",
)
def recovery_decision(t: Tables) -> DataFrame:
    """The later of the last scheduled and the last recovered run, and whether it's too old while none is active."""
    ok = F.col("status") == "ok"
    one = t.health().agg(
        F.max(F.when(ok & (F.col("source") < 3), F.col("run"))).alias("scheduled"),
        F.max(F.when(ok & (F.col("source") == 3), F.col("run"))).alias("recovered"),
        F.count_if((F.col("run") > NOW - 3600) & (F.col("status") == "partial")).alias("n"),
    )
    latest = F.greatest("scheduled", "recovered")
    needed = (F.col("n") == 0) & (F.floor((F.lit(NOW) - latest) / 60) > 80)
    return one.select(latest.alias("latest"), F.when(F.col("scheduled") >= F.col("recovered"), "scheduled").otherwise("recovery").alias("kind"), (F.col("n") > 0).alias("active"), needed.alias("needed"))


RULES = {
    "too_few_candidates": "candidates < 2",
    "text_missing": "with_text < candidates",
    "text_starved": "with_text = 0 AND candidates > 0",
    "many_errors": "errors * 4 > n",
}


@query("run_violations", _RUNS + " " + " UNION ALL ".join(f"SELECT run, '{code}' AS code FROM runs WHERE {sql}" for code, sql in RULES.items()))
def run_violations(t: Tables) -> DataFrame:
    """A row for each rule that a run breaks: all rules in one pass over the runs."""
    codes = F.array_compact(F.array(*(F.when(F.expr(rule), code) for code, rule in RULES.items())))
    return t.runs().select("run", F.explode(codes).alias("code"))


@query("clean_runs", _RUNS + " SELECT count(*) FILTER (WHERE NOT (" + " OR ".join(f"({sql})" for sql in RULES.values()) + ")) AS clean, count(*) AS runs FROM runs")
def clean_runs(t: Tables) -> DataFrame:
    broken = reduce(lambda a, b: a | b, map(F.expr, RULES.values()))
    return t.runs().agg(F.count_if(~broken).alias("clean"), F.count("*").alias("runs"))


_AUDITED = """
  n AS (SELECT run // 3600 AS h, * FROM runs),
  r AS (SELECT h, n AS seen, CASE WHEN h % 37 = 5 THEN NULL WHEN h % 29 = 3 THEN (h - 1) * 3600 + (h - 1) % 7 * 500 ELSE h * 3600 + h % 7 * 500 END AS crawled_at,
    CASE WHEN h % 41 = 1 THEN 'automatic' ELSE 'hourly_collection_manual_analysis' END AS mode, h % 43 = 2 AS automatic, CASE WHEN h % 47 = 3 THEN 2 ELSE 0 END AS selected, CASE WHEN h % 53 = 4 THEN 1 ELSE 0 END AS queued,
    CASE WHEN h % 31 = 6 THEN 'failed' WHEN h % 13 = 7 THEN 'degraded' ELSE 'ok' END AS status, h % 59 <> 8 AS whitelisted, candidates, CASE WHEN h % 11 = 4 THEN 0 ELSE with_text END AS with_text,
    CASE WHEN h % 17 = 9 THEN 0 ELSE CASE WHEN h % 11 = 4 THEN 0 ELSE with_text END END AS ingested, CASE WHEN h % 19 = 0 THEN 3 ELSE 0 END AS overflow FROM n)"""
#: Codes of one run: whether the run's collection is wrong by itself (error) or worth a look (warning), and when.
AUDIT = {
    "invalid_crawled_at": ("error", "crawled_at IS NULL"),
    "wrong_operating_mode": ("error", "crawled_at IS NOT NULL AND mode <> 'hourly_collection_manual_analysis'"),
    "automatic_analysis_selection_enabled": ("error", "crawled_at IS NOT NULL AND automatic"),
    "automatic_analysis_selection_detected": ("error", "crawled_at IS NOT NULL AND (selected <> 0 OR queued <> 0)"),
    "collection_run_failed": ("error", "crawled_at IS NOT NULL AND status = 'failed'"),
    "collection_run_degraded": ("warning", "crawled_at IS NOT NULL AND status = 'degraded'"),
    "source_whitelist_mismatch": ("error", "crawled_at IS NOT NULL AND NOT whitelisted"),
    "candidates_without_usable_full_text": ("error", "crawled_at IS NOT NULL AND candidates > 0 AND with_text = 0"),
    "ingest_selection_starvation": ("error", "crawled_at IS NOT NULL AND ingested <> with_text"),
    "manual_inbox_pressure": ("warning", "crawled_at IS NOT NULL AND overflow > 0"),
}
#: Warnings that keep a run of collections from being clean; runs that are expected; minutes between runs, and too many of them.
CLEAN = ("collection_run_degraded", "hourly_schedule_gap", "source_consecutive_failures", "manual_inbox_pressure", "run_count_below_target")
EXPECTED, EVERY, GAP = 100_000, 60, 120


def audited(t: Tables) -> DataFrame:
    """Runs with what an audit asks of them; some are made wrong by their hour."""
    r = t.runs().selectExpr("run div 3600 as h", "n as seen", "candidates", "with_text as texts")
    return r.selectExpr(
        "h", "seen", "case when h % 37 = 5 then null when h % 29 = 3 then (h - 1) * 3600 + (h - 1) % 7 * 500 else h * 3600 + h % 7 * 500 end as crawled_at",
        "if(h % 41 = 1, 'automatic', 'hourly_collection_manual_analysis') as mode", "h % 43 = 2 as automatic", "if(h % 47 = 3, 2, 0) as selected", "if(h % 53 = 4, 1, 0) as queued",
        "case when h % 31 = 6 then 'failed' when h % 13 = 7 then 'degraded' else 'ok' end as status", "h % 59 <> 8 as whitelisted", "candidates", "if(h % 11 = 4, 0, texts) as with_text",
        "if(h % 17 = 9 or h % 11 = 4, 0, texts) as ingested", "if(h % 19 = 0, 3, 0) as overflow",
    )


_AUDIT_SQL = (
    with_sql("runs", "health")
    + f""", {_AUDITED}, g AS (SELECT h, crawled_at, crawled_at - lag(crawled_at) OVER (ORDER BY crawled_at, h) AS gap FROM r WHERE crawled_at IS NOT NULL),
  d AS (SELECT crawled_at, min(h) AS first FROM r WHERE crawled_at IS NOT NULL GROUP BY crawled_at),
  i AS (SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) // 3600 AS h, user_id FROM events GROUP BY ALL HAVING count(*) > 1),
  k AS (SELECT source, run, status, row_number() OVER (PARTITION BY source ORDER BY run) - row_number() OVER (PARTITION BY source, status = 'ok' ORDER BY run) AS isle FROM health),
  z AS (SELECT source, max(m) AS most FROM (SELECT source, isle, count(*) AS m FROM k WHERE status <> 'ok' GROUP BY ALL) GROUP BY source),
  hs AS (SELECT DISTINCT run FROM health), found AS (
  {' UNION ALL '.join(f"SELECT h, '{code}' AS code, '{level}' AS level FROM r WHERE {sql}" for code, (level, sql) in AUDIT.items())}
  UNION ALL SELECT r.h, 'duplicate_run_timestamp', 'error' FROM r JOIN d USING (crawled_at) WHERE r.h <> d.first
  UNION ALL SELECT h, 'hourly_schedule_gap', 'warning' FROM g WHERE gap > {GAP * 60}
  UNION ALL SELECT h, 'runs_too_close', 'warning' FROM g WHERE gap < greatest(1, {EVERY} * 0.25) * 60
  UNION ALL SELECT h, 'duplicate_candidate_within_run', 'error' FROM i
  UNION ALL SELECT hs.run // 3600, 'missing_source_health', 'error' FROM hs, (SELECT unnest(range(5)) AS source) s LEFT JOIN health x ON x.run = hs.run AND x.source = s.source WHERE x.run IS NULL
  UNION ALL SELECT source, 'source_consecutive_failures', 'warning' FROM z WHERE most >= 2
  UNION ALL SELECT NULL, 'run_count_below_target', 'warning' FROM (SELECT count(*) AS n FROM r) WHERE n < {EXPECTED}
  UNION ALL SELECT NULL, 'no_hourly_collection_artifacts', 'error' FROM (SELECT count(*) AS n FROM r WHERE h < 0) WHERE n = 0)"""
)


@query("run_audit", _AUDIT_SQL + " SELECT code, level, count(*) AS n, min(h) AS first, max(h) AS last FROM found GROUP BY ALL")
def run_audit(t: Tables) -> DataFrame:
    """How often an audit of the collection runs finds each of its 18 codes, and the first and last hour (or source) it names.

    The codes of one run are looked at in one pass. Times that come twice, candidates that a run has twice and sources that it
    leaves out are summed up before they are joined; gaps are windowed in buckets of time. (That there are no runs at all is
    asked of the empty set of runs before 1970.)
    """
    return found(t).groupBy("code", "level").agg(F.count("*").alias("n"), F.min("h").alias("first"), F.max("h").alias("last"))


def found(t: Tables) -> DataFrame:
    r, health = audited(t), t.health()
    alone = r.select("h", F.inline(F.array_compact(F.array(*(F.when(F.expr(sql), F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"))) for code, (level, sql) in AUDIT.items())))))
    timed = r.filter("crawled_at is not null").select("h", "crawled_at")
    twice = timed.join(timed.groupBy("crawled_at").agg(F.min("h").alias("first"), F.count("*").alias("m")).filter("m > 1"), "crawled_at").filter("h <> first")
    between = gaps(timed, "crawled_at", then=["h"])
    tag = lambda d, code, level, h="h": d.select(F.col(h).cast("long").alias("h"), F.lit(code).alias("code"), F.lit(level).alias("level"))
    again = t.raw("events").groupBy(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("h"), "user_id").agg(F.count("*").alias("m")).filter("m > 1")
    asked = health.groupBy("run").agg(F.collect_set("source").alias("own")).select((F.col("run") / 3600).cast("long").alias("h"), F.explode(F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")), "own")).alias("source"))
    worst = streaks(health, ["source"], "run", F.col("status") != "ok").groupBy("source").agg(F.max("length").alias("most")).filter("most >= 2")
    few = r.agg(F.count("*").alias("m")).filter(F.col("m") < EXPECTED).withColumn("h", F.lit(None))
    none = r.filter("h < 0").agg(F.count("*").alias("m")).filter("m = 0").withColumn("h", F.lit(None))
    parts = [
        tag(twice, "duplicate_run_timestamp", "error"), tag(between.filter(F.col("gap") > GAP * 60), "hourly_schedule_gap", "warning"),
        tag(between.filter(F.col("gap") < max(1, EVERY * 0.25) * 60), "runs_too_close", "warning"), tag(again, "duplicate_candidate_within_run", "error"),
        tag(asked, "missing_source_health", "error"), tag(worst, "source_consecutive_failures", "warning", "source"),
        tag(few, "run_count_below_target", "warning"), tag(none, "no_hourly_collection_artifacts", "error"),
    ]
    return reduce(DataFrame.unionByName, parts, alone)


@query("audit_verdict", _AUDIT_SQL + f" SELECT count(*) FILTER (WHERE level = 'error') AS errors, count(*) FILTER (WHERE level = 'warning') AS warnings, count(*) FILTER (WHERE level = 'error') = 0 AS valid, count(*) FILTER (WHERE level = 'error' OR code IN {CLEAN}) = 0 AS clean FROM found")
def audit_verdict(t: Tables) -> DataFrame:
    """Whether the runs are valid, and clean: no error, and none of the warnings that count."""
    error, counts = F.col("level") == "error", F.col("code").isin(*CLEAN)
    return found(t).agg(F.count_if(error).alias("errors"), F.count_if(~error).alias("warnings"), (F.count_if(error) == 0).alias("valid"), (F.count_if(error | counts) == 0).alias("clean"))


@query("status_totals", _HEALTH + " SELECT coalesce(source, -1) AS source, coalesce(status, 'all') AS status, count(*) AS n FROM health GROUP BY GROUPING SETS ((source, status), (source), (status), ())")
def status_totals(t: Tables) -> DataFrame:
    """Counts by source and status with all sub-totals, in one pass."""
    out = t.health().cube("source", "status").agg(F.count("*").alias("n"))
    return out.select(F.coalesce("source", F.lit(-1)).alias("source"), F.coalesce("status", F.lit("all")).alias("status"), "n")


@query(
    "tagged_latest",
    _HEALTH + " SELECT * FROM (SELECT 'scheduled' AS kind, run, source FROM health WHERE source < 3 AND status = 'ok' UNION ALL SELECT 'recovery', run, source FROM health WHERE source = 3 AND status = 'ok') ORDER BY run DESC, source LIMIT 20",
)
def tagged_latest(t: Tables) -> DataFrame:
    ok = t.health().filter("status = 'ok'")
    both = ok.filter("source < 3").select(F.lit("scheduled").alias("kind"), "run", "source").unionByName(ok.filter("source = 3").select(F.lit("recovery").alias("kind"), "run", "source"))
    return page(both, [F.desc("run"), F.asc("source")], 20)
