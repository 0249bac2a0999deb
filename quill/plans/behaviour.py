"""Behaviour reports: enrichment, session and daily rollups, KPIs, series, rankings, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.operators.joins import page, pick_one, top_per
from quill.plans.base import query
from quill.plans.params import Filters
from quill.sources.tables import AS_OF, Tables, with_sql

POLICY = ["policy_id", "external_id", "title", "category", "issuer", "publish_date"]
SEARCHED = ["display_name", "email", "session_id", "event_type", "policy_ref", "external_id", "title", "module_id", "route_path"]
VIEW, OPEN = "view", "click"


def enriched(t: Tables) -> DataFrame:
    """Events with their user and the one policy that policy_ref names: by id before external id, then the newest."""
    known = pick_one(t.user_events(), t.policies(), "policy_ref", ["policy_id", "external_id"], ["created_minute", "policy_no"], POLICY)
    return known.join(t.profiles(), "user_id", "left")


def narrowed(events: DataFrame, f: Filters) -> DataFrame:
    """Events within the filters; only those that are set become predicates, and the time range reaches the scan."""
    out = events.filter((F.col("occurred_at") >= F.lit(f.start).cast("timestamp")) & (F.col("occurred_at") < F.lit(f.end).cast("timestamp")))
    if f.search:
        like = f"%{f.search}%"
        hit: Column = F.col("user_id").cast("string").ilike(like)
        for c in (c for c in SEARCHED if c in out.columns):
            hit = hit | F.coalesce(c, F.lit("")).ilike(like)
        out = out.filter(hit)
    for c, values in (("event_type", f.event_types), ("module_id", f.module_ids)):
        if values:
            out = out.filter(F.col(c).isin(values))
    if f.policy_ref:
        out = out.filter((F.col("policy_ref") == f.policy_ref) | (F.col("external_id") == f.policy_ref) | (F.col("policy_id") == f.policy_ref))
    if f.user_id is not None:
        out = out.filter(F.col("user_id") == f.user_id)
    if f.session_id:
        out = out.filter(F.col("session_id") == f.session_id)
    if f.source:
        out = out.filter(F.coalesce(F.nullif("source", F.lit("")), F.lit("other")) == f.source)
    return out


def label(bucket: Column, unit: str) -> Column:
    if unit == "week":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), bucket).cast("string"), F.lit("-W"), F.lpad(F.extract(F.lit("WEEK"), bucket).cast("string"), 2, "0"))
    return F.date_format(bucket, {"hour": "yyyy-MM-dd HH':00'", "month": "yyyy-MM"}.get(unit, "yyyy-MM-dd"))


def series(events: DataFrame, unit: str) -> DataFrame:
    bucket = F.date_trunc(unit, "occurred_at")
    return (
        events.groupBy(bucket.alias("bucket"))
        .agg(
            F.count("*").alias("event_count"),
            F.countDistinct("user_id").alias("unique_users"),
            F.countDistinct("session_id").alias("session_count"),
            F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"),
        )
        .select(label(F.col("bucket"), unit).alias("label"), "event_count", "unique_users", "session_count", "duration_ms")
    )


def sessions(events: DataFrame) -> DataFrame:
    """A row a session: first and last time, counts, durations, first and last route that isn't missing."""
    ms = F.unix_micros("occurred_at")
    route = F.col("route_path").isNotNull()
    at = F.struct("occurred_at", "event_id")
    return (
        events.groupBy("user_id", "session_id")
        .agg(
            F.min(ms).alias("first"),
            F.max(ms).alias("last"),
            F.count("*").alias("event_count"),
            F.countDistinct("policy_ref").alias("policy_count"),
            F.countDistinct("module_id").alias("module_count"),
            F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("total_duration_ms"),
            F.min_by("route_path", F.when(route, at)).alias("entry_route"),
            F.max_by("route_path", F.when(route, at)).alias("exit_route"),
            F.max_by("event_type", at).alias("last_event_type"),
        )
        .withColumn("elapsed_ms", F.greatest(F.expr("(last - first) div 1000"), F.lit(0)))
    )


def kpis(events: DataFrame, as_of: str) -> DataFrame:
    """One row of fifteen figures: a pass over events, and one over users, whose rows are already summed up."""
    now = F.lit(as_of).cast("timestamp")
    mean = lambda cond: F.coalesce(F.round(F.avg(F.when(cond, F.col("duration_ms")))).cast("long"), F.lit(0))
    whole = events.agg(
        F.count("*").alias("total_events"),
        F.countDistinct("user_id").alias("unique_users"),
        F.countDistinct("session_id").alias("total_sessions"),
        F.countDistinct("policy_ref").alias("active_policies"),
        F.count_if(F.col("event_type") == VIEW).alias("view_events"),
        F.count_if(F.col("event_type") == OPEN).alias("open_events"),
        mean(F.col("event_type") == VIEW).alias("avg_view_ms"),
        mean(F.lit(True)).alias("avg_duration_ms"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("total_duration_ms"),
        F.countDistinct(F.when((F.col("occurred_at") >= F.date_trunc("day", now)) & (F.col("occurred_at") < now), F.col("user_id"))).alias("today_users"),
        F.countDistinct(F.when((F.col("occurred_at") >= now - F.expr("INTERVAL 7 DAYS")) & (F.col("occurred_at") < now), F.col("user_id"))).alias("week_users"),
    )
    users = events.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("s")).agg(F.count_if(F.col("s") > 1).alias("returning_users"), F.count_if(F.col("n") == 1).alias("bounce_users"))
    each = F.coalesce(F.round(F.col("total_events") / F.nullif("unique_users", F.lit(0)), 2), F.lit(0.0))
    return whole.join(users).withColumn("total_users", F.col("unique_users")).withColumn("events_per_user", each)


def ranking(events: DataFrame, key: Column, name: str, k: int) -> DataFrame:
    """The k largest groups by count, then the latest, then the key."""
    out = events.groupBy(key.cast("string").alias(name)).agg(
        F.count("*").alias("event_count"), F.countDistinct("user_id").alias("unique_users"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"), F.max(F.unix_micros("occurred_at")).alias("last_at")
    )
    return page(out, [F.desc("event_count"), F.desc("last_at"), F.asc(name)], k)


def users(events: DataFrame) -> DataFrame:
    at = F.struct("occurred_at", "event_id")
    return events.groupBy("user_id", "display_name").agg(
        F.count("*").alias("event_count"),
        F.countDistinct("session_id").alias("session_count"),
        F.countDistinct("policy_ref").alias("policy_count"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"),
        F.max(F.unix_micros("occurred_at")).alias("last_at"),
        F.max_by("event_type", at).alias("last_event_type"),
        F.max_by("module_id", F.when(F.col("module_id").isNotNull(), at)).alias("last_module"),
    )


LAST30 = Filters().normal()
_IN = "occurred_at >= TIMESTAMP '2024-01-01 00:00:00' AND occurred_at < TIMESTAMP '2024-01-31 00:00:00'"
_EV = with_sql("user_events")
_FULL = with_sql("user_events", "profiles", "policies") + """,
  enriched AS (
    SELECT e.*, pr.display_name, pr.email, pr.role, p.policy_id, p.external_id, p.title, p.category, p.issuer, p.publish_date
    FROM user_events e LEFT JOIN profiles pr ON pr.user_id = e.user_id
    LEFT JOIN LATERAL (
      SELECT * FROM policies pol WHERE pol.policy_id = e.policy_ref OR pol.external_id = e.policy_ref
      ORDER BY CASE WHEN pol.policy_id = e.policy_ref THEN 0 ELSE 1 END, pol.created_minute DESC, pol.policy_no DESC LIMIT 1
    ) p ON true)"""
_SERIES = """SELECT {label} AS label, count(*) AS event_count, count(DISTINCT user_id) AS unique_users, count(DISTINCT session_id) AS session_count,
  CAST(coalesce(sum(duration_ms), 0) AS BIGINT) AS duration_ms FROM user_events WHERE {where} GROUP BY 1"""
_RANK = """SELECT {key} AS {name}, count(*) AS event_count, count(DISTINCT user_id) AS unique_users, CAST(coalesce(sum(duration_ms), 0) AS BIGINT) AS duration_ms,
  epoch_us(max(occurred_at)) AS last_at FROM {table} WHERE {where} GROUP BY 1 ORDER BY event_count DESC, last_at DESC, {name} LIMIT {k}"""

for _unit, _format in (("hour", "%Y-%m-%d %H:00"), ("day", "%Y-%m-%d"), ("week", "%G-W%V"), ("month", "%Y-%m")):

    @query(f"series_{_unit}", _EV + _SERIES.format(label=f"strftime(date_trunc('{_unit}', occurred_at), '{_format}')", where=_IN))
    def _series(t: Tables, unit: str = _unit) -> DataFrame:
        return series(narrowed(t.user_events(), LAST30), unit)


@query("event_enriched", _FULL + "SELECT event_id, display_name, email, role, policy_ref, policy_id, external_id, title, category, issuer, CAST(publish_date AS VARCHAR) AS publish_date FROM enriched")
def event_enriched(t: Tables) -> DataFrame:
    return enriched(t).select("event_id", "display_name", "email", "role", "policy_ref", "policy_id", "external_id", "title", "category", "issuer", F.col("publish_date").cast("string").alias("publish_date"))


_SESSIONS = """ s AS (
  SELECT user_id, session_id, epoch_us(min(occurred_at)) AS first, epoch_us(max(occurred_at)) AS last, count(*) AS event_count,
    count(DISTINCT policy_ref) AS policy_count, count(DISTINCT module_id) AS module_count, CAST(coalesce(sum(duration_ms), 0) AS BIGINT) AS total_duration_ms,
    (array_agg(route_path ORDER BY occurred_at, event_id) FILTER (WHERE route_path IS NOT NULL))[1] AS entry_route,
    (array_agg(route_path ORDER BY occurred_at DESC, event_id DESC) FILTER (WHERE route_path IS NOT NULL))[1] AS exit_route,
    (array_agg(event_type ORDER BY occurred_at DESC, event_id DESC))[1] AS last_event_type,
    greatest((epoch_us(max(occurred_at)) - epoch_us(min(occurred_at))) // 1000, 0) AS elapsed_ms
  FROM user_events GROUP BY user_id, session_id)"""


@query("session_rollup", _EV + "," + _SESSIONS + " SELECT * FROM s")
def session_rollup(t: Tables) -> DataFrame:
    return sessions(t.user_events())


@query(
    "daily_rollup",
    with_sql("user_events", "profiles")
    + """ SELECT strftime(occurred_at, '%Y-%m-%d') AS event_date, e.user_id, display_name, email, count(*) AS event_count, count(DISTINCT session_id) AS session_count,
  count(DISTINCT policy_ref) AS policy_count, count(DISTINCT module_id) AS module_count, CAST(coalesce(sum(duration_ms), 0) AS BIGINT) AS total_duration_ms
  FROM user_events e LEFT JOIN profiles p ON p.user_id = e.user_id GROUP BY ALL""",
)
def daily_rollup(t: Tables) -> DataFrame:
    """Summed up by day and user first; names are joined to the sums."""
    out = t.user_events().groupBy(F.date_format("occurred_at", "yyyy-MM-dd").alias("event_date"), "user_id").agg(
        F.count("*").alias("event_count"),
        F.countDistinct("session_id").alias("session_count"),
        F.countDistinct("policy_ref").alias("policy_count"),
        F.countDistinct("module_id").alias("module_count"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("total_duration_ms"),
    )
    return out.join(t.profiles().select("user_id", "display_name", "email"), "user_id", "left")


_NOW = f"TIMESTAMP '{AS_OF}'"
_KPIS = f""" f AS (SELECT * FROM user_events WHERE {_IN}), u AS (SELECT user_id, count(*) AS n, count(DISTINCT session_id) AS s FROM f GROUP BY user_id)
SELECT count(*) AS total_events, count(DISTINCT user_id) AS unique_users, count(DISTINCT session_id) AS total_sessions, count(DISTINCT policy_ref) AS active_policies,
  count(*) FILTER (WHERE event_type = 'view') AS view_events, count(*) FILTER (WHERE event_type = 'click') AS open_events,
  CAST(coalesce(round(avg(duration_ms) FILTER (WHERE event_type = 'view')), 0) AS BIGINT) AS avg_view_ms, CAST(coalesce(round(avg(duration_ms)), 0) AS BIGINT) AS avg_duration_ms,
  CAST(coalesce(sum(duration_ms), 0) AS BIGINT) AS total_duration_ms,
  count(DISTINCT user_id) FILTER (WHERE occurred_at >= date_trunc('day', {_NOW}) AND occurred_at < {_NOW}) AS today_users,
  count(DISTINCT user_id) FILTER (WHERE occurred_at >= {_NOW} - INTERVAL 7 DAY AND occurred_at < {_NOW}) AS week_users,
  (SELECT count(*) FROM u WHERE s > 1) AS returning_users, (SELECT count(*) FROM u WHERE n = 1) AS bounce_users,
  count(DISTINCT user_id) AS total_users, coalesce(round(CAST(count(*) AS DOUBLE) / nullif(count(DISTINCT user_id), 0), 2), 0) AS events_per_user FROM f"""


@query("overview_summary", _EV + "," + _KPIS)
def overview_summary(t: Tables) -> DataFrame:
    return kpis(narrowed(t.user_events(), LAST30), LAST30.as_of)


_BUSY = "occurred_at >= TIMESTAMP '2024-01-08 00:00:00' AND occurred_at < TIMESTAMP '2024-01-15 00:00:00'"


@query(
    "overview_session_stats",
    _EV + "," + _SESSIONS + """ SELECT count(*) AS sessions, CAST(coalesce(round(avg(total_duration_ms)), 0) AS BIGINT) AS avg_duration_ms, CAST(coalesce(round(avg(elapsed_ms)), 0) AS BIGINT) AS avg_elapsed_ms,
  round(avg(CAST(event_count AS DOUBLE)), 2) AS avg_events, max(elapsed_ms) AS longest_ms FROM s
  WHERE last >= epoch_us(TIMESTAMP '2024-01-08 12:00:00') AND first < epoch_us(TIMESTAMP '2024-01-15 12:00:00')""",
)
def overview_session_stats(t: Tables) -> DataFrame:
    """Whole sessions that overlap the window count, with all their events."""
    start, end = (F.unix_micros(F.lit(x).cast("timestamp")) for x in ("2024-01-08 12:00:00", "2024-01-15 12:00:00"))
    s = sessions(t.user_events()).filter((F.col("last") >= start) & (F.col("first") < end))
    mean = lambda c: F.coalesce(F.round(F.avg(c)).cast("long"), F.lit(0))
    return s.agg(F.count("*").alias("sessions"), mean("total_duration_ms").alias("avg_duration_ms"), mean("elapsed_ms").alias("avg_elapsed_ms"), F.round(F.avg("event_count"), 2).alias("avg_events"), F.max("elapsed_ms").alias("longest_ms"))


for _name, _key, _table, _where, _k in (
    ("top_policies", "policy_ref", "user_events", "policy_ref IS NOT NULL", 10),
    ("top_modules", "module_id", "user_events", "module_id IS NOT NULL", 10),
    ("top_users", "user_id", "user_events", "true", 10),
    ("event_breakdown", "event_type", "user_events", "true", 20),
    ("top_sources", "source", "user_events", "true", 10),
):
    _expr = "coalesce(nullif(source, ''), 'other')" if _key == "source" else f"CAST({_key} AS VARCHAR)"

    @query(_name, _EV + _RANK.format(key=_expr, name=f"{_key}_key", table=_table, where=f"{_IN} AND {_where}", k=_k))
    def _top(t: Tables, key: str = _key, where: str = _where, k: int = _k) -> DataFrame:
        col = F.coalesce(F.nullif("source", F.lit("")), F.lit("other")) if key == "source" else F.col(key)
        return ranking(narrowed(t.user_events(), LAST30).filter(where), col, f"{key}_key", k)


_SEARCH = Filters(search="%er_%1", event_types=["view", "click", ""], start="2024-01-08 00:00:00", end="2024-01-15 00:00:00", limit=25, offset=5).normal()
_LIKE = "(CAST(user_id AS VARCHAR) ILIKE '%%er_%1%' OR " + " OR ".join(f"coalesce({c}, '') ILIKE '%%er_%1%'" for c in SEARCHED) + ")"
_USERS = """SELECT user_id, display_name, count(*) AS event_count, count(DISTINCT session_id) AS session_count, count(DISTINCT policy_ref) AS policy_count,
  CAST(coalesce(sum(duration_ms), 0) AS BIGINT) AS duration_ms, epoch_us(max(occurred_at)) AS last_at, (array_agg(event_type ORDER BY occurred_at DESC, event_id DESC))[1] AS last_event_type,
  (array_agg(module_id ORDER BY occurred_at DESC, event_id DESC) FILTER (WHERE module_id IS NOT NULL))[1] AS last_module FROM f GROUP BY user_id, display_name"""


@query("user_list_page", _FULL + f", f AS (SELECT * FROM enriched WHERE {_BUSY} AND {_LIKE} AND event_type IN ('view', 'click')) {_USERS} ORDER BY last_at DESC, user_id LIMIT 25 OFFSET 5")
def user_list_page(t: Tables) -> DataFrame:
    return page(users(narrowed(enriched(t), _SEARCH)), [F.desc("last_at"), F.asc("user_id")], _SEARCH.limit, _SEARCH.offset)


@query("user_list_total", _FULL + f", f AS (SELECT * FROM enriched WHERE {_BUSY} AND {_LIKE} AND event_type IN ('view', 'click')) SELECT count(DISTINCT user_id) AS total FROM f")
def user_list_total(t: Tables) -> DataFrame:
    return narrowed(enriched(t), _SEARCH).agg(F.countDistinct("user_id").alias("total"))


@query("policy_filtered_events", _FULL + f" SELECT event_id, policy_ref, policy_id, external_id FROM enriched WHERE {_IN} AND (policy_ref = '26' OR external_id = '26' OR policy_id = '26') AND module_id IN ('m1', 'm5')")
def policy_filtered_events(t: Tables) -> DataFrame:
    f = Filters(policy_ref=" 26 ", module_ids=["m1", "", "m5"]).normal()
    return narrowed(enriched(t), f).select("event_id", "policy_ref", "policy_id", "external_id")


for _name, _key in (("user_top_events", "event_type"), ("user_top_policies", "policy_ref")):

    @query(
        _name,
        _EV + f""" SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, last_at DESC, {_key}) AS INTEGER) AS rank FROM (
  SELECT user_id, {_key}, count(*) AS n, epoch_us(max(occurred_at)) AS last_at FROM user_events WHERE {_IN} AND {_key} IS NOT NULL GROUP BY ALL)) WHERE rank <= 5""",
    )
    def _nested(t: Tables, key: str = _key) -> DataFrame:
        """The rank is over counts, not over events: a user's group is as small as the number of keys."""
        counts = narrowed(t.user_events(), LAST30).filter(F.col(key).isNotNull()).groupBy("user_id", key).agg(F.count("*").alias("n"), F.max(F.unix_micros("occurred_at")).alias("last_at"))
        return top_per(counts, ["user_id"], [F.desc("n"), F.desc("last_at"), F.asc(key)], 5)


@query("user_detail_summary", with_sql("user_events", "profiles") + f", f AS (SELECT e.*, display_name FROM user_events e LEFT JOIN profiles p ON p.user_id = e.user_id WHERE {_IN} AND e.user_id = 7) {_USERS}")
def user_detail_summary(t: Tables) -> DataFrame:
    return users(narrowed(t.user_events(), Filters(user_id=7).normal()).join(t.profiles(), "user_id", "left"))


@query(
    "user_detail_sessions",
    _EV + "," + _SESSIONS + """, mix AS (SELECT session_id, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS event_mix FROM (SELECT session_id, event_type, count(*) AS n FROM user_events WHERE user_id = 7 GROUP BY ALL) GROUP BY 1)
  SELECT s.*, event_mix FROM s JOIN mix USING (session_id) WHERE user_id = 7 ORDER BY last DESC, session_id LIMIT 25""",
)
def user_detail_sessions(t: Tables) -> DataFrame:
    own = t.user_events().filter("user_id = 7")
    counts = own.groupBy("session_id", "event_type").agg(F.count("*").alias("n"))
    mix = counts.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "event_type", F.col("n").cast("string")))), ",").alias("event_mix"))
    return page(sessions(own).join(mix, "session_id"), [F.desc("last"), F.asc("session_id")], 25)


@query("timeline_page", _FULL + f" SELECT event_id, epoch_us(occurred_at) AS moment, event_type, session_id, title, module_id FROM enriched WHERE {_IN} AND user_id = 7 ORDER BY moment DESC, event_id DESC LIMIT 100 OFFSET 10")
def timeline_page(t: Tables) -> DataFrame:
    out = narrowed(enriched(t), Filters(user_id=7).normal()).select("event_id", F.unix_micros("occurred_at").alias("moment"), "event_type", "session_id", "title", "module_id")
    return page(out, [F.desc("moment"), F.desc("event_id")], 100, 10)


@query(
    "overview_json",
    _EV + f""" SELECT user_id, to_json(list({{'event': event_type, 'n': n}} ORDER BY event_type)) AS events FROM (SELECT user_id, event_type, count(*) AS n FROM user_events WHERE {_IN} GROUP BY ALL) GROUP BY user_id""",
)
def overview_json(t: Tables) -> DataFrame:
    """An ordered JSON array for each user, from counts."""
    counts = narrowed(t.user_events(), LAST30).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    rows = F.array_sort(F.collect_list(F.struct(F.col("event_type").alias("event"), "n")))
    return counts.groupBy("user_id").agg(F.to_json(rows, {"ignoreNullFields": "false"}).alias("events"))


@query(
    "event_share",
    _EV + f""" SELECT event_type, n, round(100.0 * n / sum(n) OVER (), 3) AS share, round(100.0 * sum(n) OVER (ORDER BY n DESC, event_type ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 3) AS running
  FROM (SELECT event_type, count(*) AS n FROM user_events WHERE {_IN} GROUP BY 1)""",
)
def event_share(t: Tables) -> DataFrame:
    """Shares and running shares over a handful of sums."""
    from pyspark.sql import Window

    counts = narrowed(t.user_events(), LAST30).groupBy("event_type").agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(1))
    total = F.sum("n").over(every)
    so_far = F.sum("n").over(every.orderBy(F.desc("n"), "event_type").rowsBetween(Window.unboundedPreceding, 0))
    return counts.select("event_type", "n", F.round(100.0 * F.col("n") / total, 3).alias("share"), F.round(100.0 * so_far / total, 3).alias("running"))


@query(
    "users_on_path",
    _EV + """ SELECT DISTINCT user_id FROM user_events WHERE user_id IN (SELECT user_id FROM user_events WHERE route_path = '/p/3' AND event_type = 'purchase')
  AND occurred_at >= TIMESTAMP '2024-01-24 00:00:00'""",
)
def users_on_path(t: Tables) -> DataFrame:
    """Users of the last week who ever bought on a path: a semi join."""
    e = t.user_events()
    return e.filter("occurred_at >= timestamp'2024-01-24 00:00:00'").select("user_id").distinct().join(e.filter("route_path = '/p/3' AND event_type = 'purchase'"), "user_id", "left_semi")
