"""Shared-folder scratch tables and small helpers of the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: What is written for queries whose results may still be read: paths, and names of tables.
_written: list[tuple[str, str]] = []
#: Bytes of text in a bucket, and of a file's text to a byte of the scan's estimate.
BUCKET_BYTES, EXPANDS = 64 << 20, 3


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only for a session on this machine that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "graphloom-scratch")
    return f"{base.rstrip('/')}/graphloom"


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(("path", path))
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Drops at its end what operators wrote within. It yields ``materialize`` for what shall stay.

    Results are lazy: read or write them within, or keep them."""
    before, kept = len(_written), []

    def keep(df: DataFrame, name: str, codec: str = "lz4_raw") -> DataFrame:
        out = materialize(df, name, codec)
        kept.append(_written[-1])
        return out

    try:
        yield keep
    finally:
        mine = [x for x in _written[before:] if x not in kept]
        _written[before:] = kept
        for kind, name in mine:
            drop(spark, kind, name)


def drop(spark: SparkSession, kind: str, name: str) -> None:
    if kind == "table":
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(docs: DataFrame) -> int:
    """About the bytes of text that a frame reads, by the planner's estimate; 0 where it has none."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 0 if size >= 1 << 55 else size * EXPANDS


def buckets(docs: DataFrame) -> int:
    """Buckets for the texts of docs: more where they would not fit a task."""
    return min(max(shuffle_partitions(docs.sparkSession), -(-text_bytes(docs) // BUCKET_BYTES)), 100_000)


def materialize(df: DataFrame, name: str, codec: str = "lz4_raw") -> DataFrame:
    """Write df to the shared folder and reread it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """Write df as a table bucketed by key, so that later joins on the key don't shuffle it."""
    spark = df.sparkSession
    table = f"graphloom_{name}_{uuid.uuid4().hex}"
    _written.append(("table", table))
    (
        df.repartition(buckets, key)
        .write.option("path", scratch_path(spark, name))
        # Rows hold whole blobs: size checks go row by row, so that row groups stay small.
        .option("parquet.block.size", str(16 << 20))
        .option("parquet.block.size.row.check.min", "1")
        .option("parquet.page.size.row.check.min", "1")
        .option("parquet.enable.dictionary", "false")
        .option("compression", "uncompressed")
        .bucketBy(buckets, key)
        .saveAsTable(table)
    )
    return spark.table(table)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, even where body is a nest of lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
