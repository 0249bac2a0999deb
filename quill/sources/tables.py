"""The relations that queries run on, as views of a folder of Parquet tables.

Each is a lazy projection: filters and column choices reach the Parquet scan. SQL holds the same definitions in DuckDB's
dialect, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The time that stands for "now": queries never read the clock.
AS_OF = "2024-01-31 00:00:00"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def user_events(self) -> DataFrame:
        """Behaviour events; a session is a user's day, k from the properties stands for the policy, module and route."""
        k = F.get_json_object("props", "$.k").cast("long")
        return self.raw("events").select(
            "event_id",
            "user_id",
            F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
            "event_type",
            F.when(k % 11 != 0, k.cast("string")).alias("policy_ref"),
            F.when(k % 5 != 0, F.concat(F.lit("m"), (k % 7).cast("string"))).alias("module_id"),
            F.when(F.col("event_id") % 13 != 0, F.floor(F.col("value") * 1000).cast("long")).alias("duration_ms"),
            F.when(k % 6 != 0, F.concat(F.lit("/p/"), (k % 9).cast("string"))).alias("route_path"),
            F.when(k % 4 == 0, "").when(k % 4 == 1, F.lit(None).cast("string")).otherwise(F.concat(F.lit("s"), (k % 3).cast("string"))).alias("source"),
            F.col("ts").cast("timestamp").alias("occurred_at"),
        )

    def profiles(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("user_id"),
            F.col("c_name").alias("display_name"),
            F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"),
            F.col("c_mktsegment").alias("role"),
        )

    def policies(self) -> DataFrame:
        """Published documents; some are known by an id, some by an external id only, several may share one."""
        d = F.col("doc_id")
        return self.raw("documents").select(
            d.alias("policy_no"),
            F.when(d.between(20, 39), F.concat(F.lit("x"), d.cast("string"))).otherwise(d.cast("string")).alias("policy_id"),
            F.when(d >= 50, ((d - 50) % 60).cast("string")).alias("external_id"),
            F.substring("text", 1, 40).alias("title"),
            F.col("lang").alias("category"),
            F.col("source").alias("issuer"),
            F.date_add(F.lit("2026-05-01").cast("date"), (d % 90).cast("int")).alias("publish_date"),
            ((d * 37) % 1000).alias("created_minute"),
            "text",
            "n_chars",
        )

    def queue(self) -> DataFrame:
        """Policies with what decides their place in the review queue."""
        d = F.col("policy_no")
        depth = F.element_at(F.array(*map(F.lit, ("L0", "L1", "L2", "L3"))), (d % 4 + 1).cast("int"))
        return self.policies().withColumns({
            "depth": depth,
            "priority": (d * 7 % 101).cast("long"),
            "disposition": F.when(d % 9 == 0, "archived").when(d % 9 == 1, "dismissed").when(d % 9 == 2, "pending_attachment").otherwise("awaiting"),
            "selected": d % 6 == 2,
            "complete": d % 10 == 3,
            "duplicate": d % 23 == 5,
            "dated": F.when(d % 17 != 4, F.col("publish_date")),
        })

    def jobs(self) -> DataFrame:
        """Analysis jobs: orders, each for the policy its customer stands for."""
        status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "analyzing").otherwise(F.when(F.col("o_orderkey") % 3 == 0, "failed").otherwise("published"))
        return self.raw("orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").cast("string").alias("policy_id"), status.alias("status"), F.to_date("o_orderdate").alias("created_on"))

    def runs(self) -> DataFrame:
        """Collection runs: an hour's events are a run, which fails where too many of them are errors."""
        return (
            self.raw("events")
            .groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"))
            .agg(
                F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("seen_at"),
                F.count("*").alias("n"),
                F.count_if(F.col("event_type") == "error").alias("errors"),
                F.count_if(F.col("event_type") == "purchase").alias("candidates"),
                F.count_if(F.col("event_type") == "signup").alias("with_text"),
            )
            .select(F.unix_seconds("hour").alias("run"), "seen_at", "n", "errors", "candidates", "with_text")
        )

    def health(self) -> DataFrame:
        """A row for each run and source: whether the source's part of the run went well."""
        return (
            self.raw("events")
            .groupBy(F.unix_seconds(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("run"), (F.col("user_id") % 4).alias("source"))
            .agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
            .withColumn("status", F.when(F.col("errors") * 4 > F.col("n"), "failed").when(F.col("errors") * 6 > F.col("n"), "partial").otherwise("ok"))
        )

    def pages(self) -> DataFrame:
        return self.raw("pages")


#: The same in DuckDB's dialect; each needs those before it.
SQL = {
    "user_events": """
      ue0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
      user_events AS (
        SELECT event_id, user_id, CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS session_id, event_type,
          CASE WHEN k % 11 <> 0 THEN CAST(k AS VARCHAR) END AS policy_ref,
          CASE WHEN k % 5 <> 0 THEN 'm' || (k % 7) END AS module_id,
          CASE WHEN event_id % 13 <> 0 THEN CAST(floor(value * 1000) AS BIGINT) END AS duration_ms,
          CASE WHEN k % 6 <> 0 THEN '/p/' || (k % 9) END AS route_path,
          CASE WHEN k % 4 = 0 THEN '' WHEN k % 4 = 1 THEN NULL ELSE 's' || (k % 3) END AS source,
          CAST(ts AS TIMESTAMP) AS occurred_at
        FROM ue0)""",
    "profiles": """
      profiles AS (SELECT c_custkey AS user_id, c_name AS display_name, lower(c_name) || '@example.org' AS email, c_mktsegment AS role FROM customer)""",
    "policies": """
      policies AS (
        SELECT doc_id AS policy_no, CASE WHEN doc_id BETWEEN 20 AND 39 THEN 'x' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS policy_id,
          CASE WHEN doc_id >= 50 THEN CAST((doc_id - 50) % 60 AS VARCHAR) END AS external_id,
          substr(text, 1, 40) AS title, lang AS category, source AS issuer,
          CAST(DATE '2026-05-01' + CAST(doc_id % 90 AS INTEGER) AS DATE) AS publish_date,
          (doc_id * 37) % 1000 AS created_minute, text, n_chars
        FROM documents)""",
    "queue": """
      queue AS (
        SELECT *, ['L0', 'L1', 'L2', 'L3'][policy_no % 4 + 1] AS depth, policy_no * 7 % 101 AS priority,
          CASE policy_no % 9 WHEN 0 THEN 'archived' WHEN 1 THEN 'dismissed' WHEN 2 THEN 'pending_attachment' ELSE 'awaiting' END AS disposition,
          policy_no % 6 = 2 AS selected, policy_no % 10 = 3 AS complete, policy_no % 23 = 5 AS duplicate,
          CASE WHEN policy_no % 17 <> 4 THEN publish_date END AS dated
        FROM policies)""",
    "jobs": """
      jobs AS (
        SELECT o_orderkey AS job_id, CAST(o_custkey AS VARCHAR) AS policy_id,
          CASE WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'P' THEN 'analyzing' WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE 'published' END AS status,
          CAST(o_orderdate AS DATE) AS created_on
        FROM orders)""",
    "runs": """
      runs AS (
        SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS run, CAST(max(floor(epoch(ts))) AS BIGINT) AS seen_at, count(*) AS n,
          count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'purchase') AS candidates,
          count(*) FILTER (WHERE event_type = 'signup') AS with_text
        FROM events GROUP BY date_trunc('hour', ts))""",
    "health": """
      health AS (
        SELECT *, CASE WHEN errors * 4 > n THEN 'failed' WHEN errors * 6 > n THEN 'partial' ELSE 'ok' END AS status FROM (
          SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS run, user_id % 4 AS source, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors
          FROM events GROUP BY date_trunc('hour', ts), user_id % 4))""",
}


def with_sql(*names: str) -> str:
    return "WITH " + ",".join(SQL[n] for n in names)
