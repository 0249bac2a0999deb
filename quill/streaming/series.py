"""Streaming forms: event-time series with late data, first sight of identities, idempotent back-fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Events as files land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events, users and duration an hour; an hour is closed once the watermark passes it, and later events are dropped."""
    return (
        events.withWatermark("occurred_at", late)
        .groupBy(F.window("occurred_at", "1 hour"))
        .agg(F.count("*").alias("event_count"), F.approx_count_distinct("user_id").alias("about_users"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"))
        .select(F.col("window.start").alias("bucket"), "event_count", "about_users", "duration_ms")
    )


def fresh(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """The first row of each key; its state is forgotten once the watermark passes it."""
    return events.withWatermark("occurred_at", late).dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over all that is there and stop; a batch that is run again must come to the same end."""
    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def backfill(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A batch function that keeps, in a folder of versions, the longest text of each key; a version is written whole, so a repeated batch does no harm."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        best = F.max_by(F.struct(*batch.columns), F.struct(F.length("text"), F.col(key)))
        rows = batch
        if number:
            rows = spark.read.parquet(f"{path}/v={number - 1}").select(*batch.columns).unionByName(batch)
        rows.groupBy(F.col(key).alias("__key")).agg(best.alias("__row")).select("__row.*").write.mode("overwrite").parquet(f"{path}/v={number}")

    return put
