"""Staged parquet: reuse, filtered reads, append and compaction."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from millgauge.operators.joins import in_values_of

LITERAL_LIST_LIMIT = 1_000


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``, seen by all executors.

    Only a local session that names none gets a folder of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        shared = os.path.join(tempfile.gettempdir(), "millgauge")
    return shared.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name under this application's part of the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/{app}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write the rows to the shared folder and read them back.

    For a table that several later passes read: they scan files with only their own columns, and a
    lost executor re-reads files instead of recomputing what came before.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Does the path exist on whatever file system it names?"""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(target))


def is_complete(spark: SparkSession, path: str) -> bool:
    """Was the staged table written to the end (success marker present)?"""
    return path_exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def materialize(
    spark: SparkSession, build: Callable[[], DataFrame], path: str, partition_by: Sequence[str] = ()
) -> DataFrame:
    """Read the staged table if it is complete, else build, write and read it back.

    A half-written table (no success marker) is rebuilt. Reading back cuts the lineage, so a lost
    executor re-reads files instead of recomputing the stages before.
    """
    if not is_complete(spark, path):
        writer = build().write.mode("overwrite").option("compression", "snappy")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    return spark.read.parquet(path)


def ingest(
    spark: SparkSession, staged: str, raw: str, read_raw: Callable[[str], DataFrame]
) -> DataFrame:
    """The staged table if complete, else the raw file; an error if neither exists."""
    if is_complete(spark, staged):
        return spark.read.parquet(staged)
    if path_exists(spark, raw):
        return read_raw(raw)
    raise FileNotFoundError(f"neither {staged} nor {raw} exists")


def read_keys(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    key: str,
    values: Sequence[object] | DataFrame,
) -> DataFrame:
    """Chosen columns of the rows whose key is listed.

    A short literal list is pushed into the parquet scan; a table of keys, or a longer list,
    becomes a semi-join.
    """
    table = spark.read.parquet(path)
    if isinstance(values, DataFrame):
        return in_values_of(table, values, key, values.columns[0]).select(*columns)
    if len(values) > LITERAL_LIST_LIMIT:
        listed = spark.createDataFrame([(v,) for v in values], [key])
        return in_values_of(table, listed, key, key).select(*columns)
    return table.where(F.col(key).isin(list(values))).select(*columns)


def append(df: DataFrame, path: str) -> None:
    """Add rows to a parquet dataset."""
    df.write.mode("append").option("compression", "snappy").parquet(path)


def compact(
    spark: SparkSession, source: str | Sequence[str], target: str, target_bytes: int = 512 * 1024 * 1024
) -> DataFrame:
    """Rewrite a dataset of many parts, or several datasets of one kind, into files of about ``target_bytes``."""
    sources = [source] if isinstance(source, str) else list(source)
    size = 0
    for path in sources:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        size += fs.getContentSummary(hadoop).getLength()
    files = max(1, math.ceil(size / target_bytes))
    (
        spark.read.parquet(*sources)
        .coalesce(files)
        .write.mode("overwrite")
        .option("compression", "snappy")
        .parquet(target)
    )
    return spark.read.parquet(target)
