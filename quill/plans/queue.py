"""The review queue: eligibility, states, ranks, jobs, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.operators.joins import page, top_per, upsert
from quill.plans.base import query
from quill.sources.tables import Tables, with_sql

OPEN = ["queued", "fetching", "extracting", "analyzing"]
_Q = with_sql("policies", "queue")
_QJ = with_sql("policies", "queue", "jobs")
_ELIGIBLE = "depth IN ('L2', 'L3') AND NOT complete AND disposition NOT IN ('archived', 'dismissed') AND NOT duplicate AND dated IS NOT NULL"
_STATE = "CASE WHEN disposition = 'pending_attachment' THEN 'awaiting_attachment' WHEN selected THEN 'selected' ELSE 'recommended' END"
_RANKED = "CASE state WHEN 'selected' THEN 0 WHEN 'recommended' THEN 1 ELSE 2 END, priority DESC, dated DESC, policy_no"
_COUNTS = "SELECT policy_id, count(*) AS open_jobs, max(created_on) AS latest FROM jobs WHERE status IN ('queued', 'analyzing') GROUP BY policy_id"


def eligible(q: DataFrame) -> DataFrame:
    """Dated L2 and L3 policies that are neither complete, nor set aside, nor duplicates; null-safe, so a missing disposition counts."""
    aside = F.coalesce(F.col("disposition").isin("archived", "dismissed"), F.lit(False))
    return q.filter(F.col("depth").isin("L2", "L3") & ~F.col("complete").eqNullSafe(True) & ~aside & ~F.col("duplicate").eqNullSafe(True) & F.col("dated").isNotNull())


def state() -> Column:
    return F.when(F.col("disposition") == "pending_attachment", "awaiting_attachment").when(F.col("selected"), "selected").otherwise("recommended")


def open_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status").isin(OPEN)).groupBy("policy_id").agg(F.count("*").alias("open_jobs"), F.max("created_on").alias("latest"))


def rank_order() -> list[Column]:
    return [F.when(F.col("state") == "selected", 0).when(F.col("state") == "recommended", 1).otherwise(2), F.desc("priority"), F.desc("dated"), F.asc("policy_no")]


@query("pending_queue", _Q + f" SELECT policy_no, title, depth, priority, CAST(dated AS VARCHAR) AS dated FROM queue WHERE {_ELIGIBLE} ORDER BY priority DESC, dated DESC NULLS LAST, policy_no LIMIT 20")
def pending_queue(t: Tables) -> DataFrame:
    out = page(eligible(t.queue()), [F.desc("priority"), F.desc_nulls_last("dated"), F.asc("policy_no")], 20)
    return out.select("policy_no", "title", "depth", "priority", F.col("dated").cast("string").alias("dated"))


@query("pending_total", _Q + f" SELECT count(*) AS total, count(*) FILTER (WHERE title IS NOT NULL) AS titled FROM queue WHERE {_ELIGIBLE}")
def pending_total(t: Tables) -> DataFrame:
    return eligible(t.queue()).agg(F.count("*").alias("total"), F.count("title").alias("titled"))


@query(
    "queue_overview",
    _QJ + f""", j AS ({_COUNTS}), r AS (SELECT q.*, {_STATE} AS state, coalesce(open_jobs, 0) AS open_jobs FROM queue q LEFT JOIN j USING (policy_id) WHERE {_ELIGIBLE})
  SELECT count(*) AS total, count(*) FILTER (WHERE dated >= DATE '2026-07-01') AS current, count(*) FILTER (WHERE dated < DATE '2026-07-01') AS historical,
  count(*) FILTER (WHERE state = 'awaiting_attachment') AS blocked, count(*) FILTER (WHERE open_jobs > 0) AS with_jobs, CAST(sum(open_jobs) AS BIGINT) AS open_jobs FROM r""",
)
def queue_overview(t: Tables) -> DataFrame:
    """Policies of a window of days and older ones, blockers and open jobs: jobs are counted before they are joined."""
    rows = eligible(t.queue()).withColumn("state", state()).join(open_jobs(t.jobs()), "policy_id", "left").withColumn("open_jobs", F.coalesce("open_jobs", F.lit(0)))
    since = F.lit("2026-07-01").cast("date")
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("dated") >= since).alias("current"),
        F.count_if(F.col("dated") < since).alias("historical"),
        F.count_if(F.col("state") == "awaiting_attachment").alias("blocked"),
        F.count_if(F.col("open_jobs") > 0).alias("with_jobs"),
        F.sum("open_jobs").alias("open_jobs"),
    )


@query("queue_state_counts", _Q + f" SELECT {_STATE} AS state, depth, count(*) AS n, min(CAST(dated AS VARCHAR)) AS oldest FROM queue WHERE {_ELIGIBLE} GROUP BY ALL")
def queue_state_counts(t: Tables) -> DataFrame:
    return eligible(t.queue()).groupBy(state().alias("state"), "depth").agg(F.count("*").alias("n"), F.min(F.col("dated").cast("string")).alias("oldest"))


@query("queue_ranked", _QJ + f", j AS ({_COUNTS}), r AS (SELECT q.policy_id, policy_no, priority, dated, {_STATE} AS state, coalesce(open_jobs, 0) AS open_jobs FROM queue q LEFT JOIN j USING (policy_id) WHERE {_ELIGIBLE}) SELECT policy_no, state, priority, open_jobs FROM r ORDER BY {_RANKED} LIMIT 50")
def queue_ranked(t: Tables) -> DataFrame:
    rows = eligible(t.queue()).withColumn("state", state()).join(open_jobs(t.jobs()), "policy_id", "left")
    return page(rows, rank_order(), 50).select("policy_no", "state", "priority", F.coalesce("open_jobs", F.lit(0)).alias("open_jobs"))


@query(
    "next_selected",
    _QJ + f""", l AS (SELECT policy_id, max_by(job_id, struct_pack(created_on, job_id)) AS job_id FROM jobs WHERE status IN ('queued', 'analyzing') GROUP BY policy_id),
  r AS (SELECT q.policy_id, policy_no, priority, dated, {_STATE} AS state, job_id FROM queue q LEFT JOIN l USING (policy_id) WHERE {_ELIGIBLE} AND selected)
  SELECT policy_no, job_id FROM r ORDER BY {_RANKED} LIMIT 1""",
)
def next_selected(t: Tables) -> DataFrame:
    """The first of the ranked queue, with its latest open job."""
    latest = t.jobs().filter(F.col("status").isin(OPEN)).groupBy("policy_id").agg(F.max_by("job_id", F.struct("created_on", "job_id")).alias("job_id"))
    rows = eligible(t.queue()).filter("selected").withColumn("state", state()).join(latest, "policy_id", "left")
    return page(rows, rank_order(), 1).select("policy_no", "job_id")


@query(
    "reanalysis_tally",
    _Q + """, p AS (SELECT * FROM queue WHERE complete ORDER BY dated DESC NULLS LAST, policy_no LIMIT 40 OFFSET 10)
  SELECT CASE WHEN n_chars < 280 THEN 'skipped' WHEN dated IS NULL THEN 'failed' ELSE 'reanalyzed' END AS outcome, count(*) AS n FROM p GROUP BY 1""",
)
def reanalysis_tally(t: Tables) -> DataFrame:
    rows = page(t.queue().filter("complete"), [F.desc_nulls_last("dated"), F.asc("policy_no")], 40, 10)
    outcome = F.when(F.col("n_chars") < 280, "skipped").when(F.col("dated").isNull(), "failed").otherwise("reanalyzed")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("latest_open_job", with_sql("jobs") + " SELECT policy_id, max_by(job_id, struct_pack(created_on, job_id)) AS job_id, count(*) AS n FROM jobs WHERE status IN ('queued', 'analyzing') GROUP BY policy_id")
def latest_open_job(t: Tables) -> DataFrame:
    return t.jobs().filter(F.col("status").isin(OPEN)).groupBy("policy_id").agg(F.max_by("job_id", F.struct("created_on", "job_id")).alias("job_id"), F.count("*").alias("n"))


@query(
    "stale_jobs",
    _QJ + """, s AS (SELECT policy_id, count(*) AS n FROM jobs WHERE status IN ('queued', 'analyzing') AND created_on < DATE '1998-01-01' GROUP BY 1)
  SELECT CASE WHEN q.policy_id IS NULL THEN 'unknown_policy' WHEN q.complete THEN 'complete' WHEN q.dated IS NULL THEN 'undated' WHEN q.dated >= DATE '2026-07-15' THEN 'recent' ELSE 'candidate' END AS reason,
  count(*) AS policies, CAST(sum(s.n) AS BIGINT) AS jobs FROM s LEFT JOIN queue q USING (policy_id) GROUP BY 1""",
)
def stale_jobs(t: Tables) -> DataFrame:
    """Old open jobs by what speaks for or against closing them; nothing is written."""
    old = t.jobs().filter(F.col("status").isin(OPEN) & (F.col("created_on") < F.lit("1998-01-01").cast("date"))).groupBy("policy_id").agg(F.count("*").alias("n"))
    known = t.queue().select("policy_id", "complete", "dated", F.lit(True).alias("known"))
    reason = F.when(F.col("known").isNull(), "unknown_policy").when(F.col("complete"), "complete").when(F.col("dated").isNull(), "undated").when(F.col("dated") >= F.lit("2026-07-15").cast("date"), "recent").otherwise("candidate")
    return old.join(known, "policy_id", "left").groupBy(reason.alias("reason")).agg(F.count("*").alias("policies"), F.sum("n").alias("jobs"))


@query(
    "migration_plan",
    _Q + """, n AS (SELECT policy_no, lower(regexp_replace(title, '\\s+', '', 'g')) AS k, category, dated FROM queue),
  a AS (SELECT k, min(policy_no) AS hit FROM n WHERE category = 'en' GROUP BY k), b AS (SELECT k, min(policy_no) AS hit FROM n WHERE policy_no % 3 = 0 GROUP BY k)
  SELECT CASE WHEN a.hit IS NOT NULL AND a.hit <> n.policy_no THEN 'duplicate' WHEN b.hit IS NOT NULL AND b.hit <> n.policy_no THEN 'archived' WHEN dated IS NULL THEN 'undated' ELSE 'keep' END AS plan, count(*) AS n
  FROM n LEFT JOIN a USING (k) LEFT JOIN b USING (k) GROUP BY 1""",
)
def migration_plan(t: Tables) -> DataFrame:
    """Two dictionaries by normalised title, the first before the second, then the counts of each decision."""
    n = t.queue().select("policy_no", F.lower(F.regexp_replace("title", r"\s+", "")).alias("k"), "category", "dated")
    look = lambda cond, name: n.filter(cond).groupBy("k").agg(F.min("policy_no").alias(name))
    rows = n.join(look("category = 'en'", "a"), "k", "left").join(look("policy_no % 3 = 0", "b"), "k", "left")
    plan = F.when(F.col("a") != F.col("policy_no"), "duplicate").when(F.col("b") != F.col("policy_no"), "archived").when(F.col("dated").isNull(), "undated").otherwise("keep")
    return rows.groupBy(plan.alias("plan")).agg(F.count("*").alias("n"))


@query("recent_or_selected", _Q + f" SELECT count(*) AS n FROM (SELECT policy_id FROM queue WHERE {_ELIGIBLE} AND dated >= DATE '2026-07-20' UNION SELECT policy_id FROM queue WHERE selected)")
def recent_or_selected(t: Tables) -> DataFrame:
    """The size of a union of two id sets."""
    q = t.queue()
    return eligible(q).filter("dated >= date'2026-07-20'").select("policy_id").union(q.filter("selected").select("policy_id")).distinct().agg(F.count("*").alias("n"))


@query("jobs_newest", with_sql("jobs") + " SELECT job_id, policy_id, status, CAST(created_on AS VARCHAR) AS created_on FROM jobs ORDER BY jobs.created_on DESC, job_id LIMIT 50")
def jobs_newest(t: Tables) -> DataFrame:
    return page(t.jobs(), [F.desc("created_on"), F.asc("job_id")], 50).select("job_id", "policy_id", "status", F.col("created_on").cast("string").alias("created_on"))


@query("jobs_per_policy_top", with_sql("jobs") + " SELECT policy_id, job_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY policy_id ORDER BY created_on DESC, job_id) AS rank FROM jobs) WHERE rank <= 2")
def jobs_per_policy_top(t: Tables) -> DataFrame:
    return top_per(t.jobs().select("policy_id", "job_id", "created_on"), ["policy_id"], [F.desc("created_on"), F.asc("job_id")], 2).select("policy_id", "job_id", "rank")


@query(
    "upsert_backfill",
    _Q + """, o AS (SELECT policy_no, n_chars AS size, complete, title FROM queue WHERE policy_no % 3 <> 0), n AS (SELECT policy_no, n_chars * (1 + policy_no % 2) AS size, false AS complete, 'new ' || title AS title FROM queue WHERE policy_no % 2 = 0 OR policy_no % 5 = 0)
  SELECT coalesce(o.policy_no, n.policy_no) AS policy_no,
    CASE WHEN o.policy_no IS NULL THEN n.size WHEN n.policy_no IS NULL THEN o.size WHEN n.size >= 280 AND n.size >= greatest(o.size + 300, (o.size * 5 + 3) // 4) AND NOT o.complete THEN n.size ELSE o.size END AS size,
    coalesce(o.complete, n.complete) AS complete, coalesce(o.title, n.title) AS title,
    CASE WHEN o.policy_no IS NULL THEN 'inserted' WHEN n.policy_no IS NULL THEN 'kept' ELSE 'matched' END AS action
  FROM o FULL JOIN n ON o.policy_no = n.policy_no""",
)
def upsert_backfill(t: Tables) -> DataFrame:
    """Insert what is new; a longer text replaces a shorter one if it's much longer and the old row isn't complete; other values stay unless missing."""
    q = t.queue()
    old = q.filter("policy_no % 3 <> 0").select("policy_no", F.col("n_chars").alias("size"), "complete", "title")
    new = q.filter("policy_no % 2 = 0 or policy_no % 5 = 0").select("policy_no", (F.col("n_chars") * (1 + F.col("policy_no") % 2)).alias("size"), F.lit(False).alias("complete"), F.concat(F.lit("new "), "title").alias("title"))
    o, n = F.col("o.size"), F.col("n.size")
    better = (n >= 280) & (n >= F.greatest(o + 300, F.expr("(o.size * 5 + 3) div 4"))) & ~F.col("o.complete")
    return upsert(old, new, "policy_no", {"size": F.when(better, n).otherwise(o), "title": F.coalesce("o.title", "n.title")})
