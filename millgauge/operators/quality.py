"""Row-count reconciliation, coverage counts and panel balance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from millgauge.operators.joins import coverage
from millgauge.operators.ranks import first_by_order


def reconcile(raw: DataFrame, staged: DataFrame) -> DataFrame:
    """One row ``(raw_rows, staged_rows, missing_rows, matches)`` comparing real counts."""
    counts = raw.agg(F.count(F.lit(1)).alias("raw_rows")).withColumn(
        "staged_rows", staged.agg(F.count(F.lit(1))).scalar()
    )
    return counts.withColumns(
        {
            "missing_rows": F.col("raw_rows") - F.col("staged_rows"),
            "matches": F.col("raw_rows") == F.col("staged_rows"),
        }
    )


def coverage_report(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """One row: how many keys of ``df`` the other table lacks."""
    return coverage(df, other, key).agg(F.count(F.lit(1)).alias("missing_keys"))


def balanced(df: DataFrame, entity: str, period: str) -> DataFrame:
    """One row ``(entities, periods, panel_rows, balanced)``."""
    return df.agg(
        F.count_distinct(F.col(entity)).alias("entities"),
        F.count_distinct(F.col(period)).alias("periods"),
        F.count(F.lit(1)).alias("panel_rows"),
    ).withColumn("balanced", F.col("entities") * F.col("periods") == F.col("panel_rows"))


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in an explicit order (files have no row order in Spark)."""
    return first_by_order(df, keys, order)


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return (
        df.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    )
