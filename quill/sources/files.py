"""File sources and sinks: JSON artifacts, reports, candidates, upserts, Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def json_folder(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """All JSON artifacts under a folder, at any depth, with the file's name; damaged ones are dropped by the reader's mode."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("mode", "DROPMALFORMED").json(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def json_or(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A JSON file, or no rows if it isn't there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def nested_json(df: DataFrame, column: str, schemas: list[str], name: str = "value") -> DataFrame:
    """Unpacks JSON that holds JSON text that holds JSON: each schema but the last has one text field named inner."""
    value = F.col(column)
    for s in schemas[:-1]:
        value = F.from_json(value, s)["inner"]
    return df.withColumn(name, F.from_json(value, schemas[-1]))


def write_partitioned(df: DataFrame, path: str, day: str) -> None:
    """Append by day, a file a task and day at most."""
    df.withColumn("day", F.to_date(day)).repartition("day").write.mode("append").partitionBy("day").parquet(path)


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small result as a Markdown table; more rows than most is an error, for this is a report and not a sink."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a report")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " - |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"
