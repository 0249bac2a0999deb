"""What the operators of this folder share: tables, shared storage, shipping code to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
TOKENIZERS = "/opt/tokenizers"
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read with Spark's own reader, so that any store it knows will do."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't have it on their path."""
    app = spark.sparkContext.applicationId
    if app in _shipped or str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    at = os.path.join(tempfile.mkdtemp(), "quill_llm.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in (ROOT / "quill").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(at)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see; a local one only for a local session."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "/tmp/checkpoints/quill"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def materialise(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: its lineage ends, and a lost executor costs nothing."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at), at


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that materialise() wrote and nothing reads any more."""
    jvm = spark._jvm
    for at in paths:
        p = jvm.org.apache.hadoop.fs.Path(at)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rows_of(batches: Iterable[pa.RecordBatch], rows: int = 256, chars: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Small slices of Arrow batches, to bound what is alive as Python objects at once; chars bounds their bytes, but for single rows."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            n = min(rows, b.num_rows - at)
            part = b.slice(at, n)
            while n > 1 and part.nbytes > chars:
                n = max(1, n // 2)
                part = b.slice(at, n)
            yield part
            at += n


def key_order(df: DataFrame, *cols: str) -> DataFrame:
    """df in ascending order of cols over its partitions, without a global sort of one task."""
    return df.repartitionByRange(partitions(df.sparkSession), *cols).sortWithinPartitions(*cols)


def remainder(col: str, by: int):
    """crc32 of a column's text modulo by; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % by
