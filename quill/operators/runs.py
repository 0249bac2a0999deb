"""Gaps, streaks and firsts over ordered runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gaps(runs: DataFrame, at: str, by: list[str] | None = None, bucket: int = 86_400, then: list[str] | None = None) -> DataFrame:
    """runs with gap: seconds since the run before. at is in seconds.

    One window over all runs would be one task's work. Runs are windowed in buckets of time instead, and a bucket's first run
    gets the last one of the nearest earlier bucket, from a table of one row a bucket.
    """
    by = by or []
    b = F.floor(F.col(at) / bucket)
    inner = Window.partitionBy(*by, "__b").orderBy(at, *(then or []))
    rows = runs.withColumn("__b", b).withColumn("__before", F.lag(at).over(inner))
    edges = rows.groupBy(*by, "__b").agg(F.max(at).alias("__last"))
    edges = edges.withColumn("__earlier", F.lag("__last").over(Window.partitionBy(*(by or [F.lit(1)])).orderBy("__b"))).drop("__last")
    return rows.join(edges, [*by, "__b"], "left").withColumn("gap", F.col(at) - F.coalesce("__before", "__earlier")).drop("__b", "__before", "__earlier")


def streaks(df: DataFrame, by: list[str], at: str, bad: Column) -> DataFrame:
    """Islands of consecutive rows for which bad holds: by, first, last and length."""
    w = Window.partitionBy(*by).orderBy(at)
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy(*by, "__bad").orderBy(at))
    rows = df.withColumn("__bad", bad).withColumn("__island", island).filter("__bad")
    return rows.groupBy(*by, "__island").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("length")).drop("__island")


def freshness(age_minutes: Column, threshold: int = 80) -> Column:
    """healthy up to the threshold, degraded up to twice that, else stale; unknown without an age."""
    return F.when(age_minutes.isNull(), "unknown").when(age_minutes <= threshold, "healthy").when(age_minutes <= 2 * threshold, "degraded").otherwise("stale")
