"""Index panels: annual means, balancing, smoothing, hierarchy, rebasing and deflation.

Panels hold one row per entity and period, so a group is as long as the number of periods.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def annualise(
    df: DataFrame, entity: Sequence[str], year: str, value: str, into: str | None = None
) -> DataFrame:
    """Mean per entity and year, ignoring nulls; an all-null year stays null."""
    return df.groupBy(*entity, year).agg(F.avg(value).alias(into or value))


def _fit_at(points: Column, x0: Column, y0: Column, span: float) -> Column:
    """Local quadratic fit at ``x0`` over ``array<struct<x,y>>`` with tricube weights."""
    n = F.size(points)
    near = F.floor(n * F.lit(float(span)) + F.lit(1e-5)).cast("int")
    distances = F.sort_array(F.transform(points, lambda p: F.abs(p["x"] - x0)))
    reach = F.get(distances, F.greatest(F.least(near, n), F.lit(1)) - 1)

    def weighted(p: Column, h: Column) -> Column:
        u = F.try_divide(p["x"] - x0, h)
        d = F.abs(u)
        return F.struct(
            u.alias("u"),
            F.when(d < 1, F.pow(1 - F.pow(d, F.lit(3.0)), F.lit(3.0)))
            .otherwise(F.lit(0.0))
            .alias("w"),
            p["y"].alias("y"),
        )

    def sums(rows: Column) -> Column:
        zero = F.struct(*[F.lit(0.0).alias(s) for s in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2")])
        return F.aggregate(
            rows,
            zero,
            lambda a, r: F.struct(
                (a["s0"] + r["w"]).alias("s0"),
                (a["s1"] + r["w"] * r["u"]).alias("s1"),
                (a["s2"] + r["w"] * r["u"] * r["u"]).alias("s2"),
                (a["s3"] + r["w"] * r["u"] * r["u"] * r["u"]).alias("s3"),
                (a["s4"] + r["w"] * r["u"] * r["u"] * r["u"] * r["u"]).alias("s4"),
                (a["t0"] + r["w"] * r["y"]).alias("t0"),
                (a["t1"] + r["w"] * r["u"] * r["y"]).alias("t1"),
                (a["t2"] + r["w"] * r["u"] * r["u"] * r["y"]).alias("t2"),
            ),
        )

    def intercept(m: Column) -> Column:
        a = m["s2"] * m["s4"] - m["s3"] * m["s3"]
        det = (
            m["s0"] * a
            - m["s1"] * (m["s1"] * m["s4"] - m["s2"] * m["s3"])
            + m["s2"] * (m["s1"] * m["s3"] - m["s2"] * m["s2"])
        )
        top = (
            m["t0"] * a
            - m["s1"] * (m["t1"] * m["s4"] - m["s3"] * m["t2"])
            + m["s2"] * (m["t1"] * m["s3"] - m["s2"] * m["t2"])
        )
        return F.try_divide(top, det)

    def fit(h: Column) -> Column:
        rows = F.transform(points, lambda p: weighted(p, h))
        distinct_x = F.size(
            F.array_distinct(F.transform(F.filter(rows, lambda r: r["w"] > 0), lambda r: r["u"]))
        )
        solved = F.transform(F.array(sums(rows)), intercept)[0]
        return F.when(distinct_x >= 3, F.coalesce(solved, y0)).otherwise(y0)

    return F.when(n < 4, y0).otherwise(F.transform(F.array(reach), fit)[0])


def loess(
    df: DataFrame, by: Sequence[str], x: str, columns: Mapping[str, str], span: float = 0.75
) -> DataFrame:
    """Add fitted values of a local quadratic regression per group, for one or more series.

    ``columns`` maps a value column to the column for its fit. Direct fit at every point: the
    ``floor(n * span)`` nearest points, tricube weights, weighted least squares of degree two.
    Where fewer than three distinct points carry weight (or a series has fewer than four points)
    the value passes through unchanged. Null values take no part and get no fit. Each row holds
    its group's series as an array, so the group must be a panel: one row per period.
    """
    group = W.partitionBy(*by)
    points = {
        f"_points_{y}": F.collect_list(
            F.when(
                F.col(y).isNotNull(),
                F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")),
            )
        ).over(group)
        for y in columns
    }
    fits = {
        into: F.when(
            F.col(y).isNotNull(),
            _fit_at(
                F.col(f"_points_{y}"), F.col(x).cast("double"), F.col(y).cast("double"), span
            ),
        )
        for y, into in columns.items()
    }
    return df.withColumns(points).withColumns(fits).drop(*points)


def coalesce_levels(df: DataFrame, levels: Sequence[str], into: str) -> DataFrame:
    """First non-null of the level columns, most specific first."""
    return df.withColumn(into, F.coalesce(*levels))


def rebase(
    df: DataFrame, entity: str, year: str, value: str, bases: Sequence[int], template: str = "hpi_index_{year}"
) -> DataFrame:
    """Multipliers to base years: ``base value / value``, null when either is missing."""
    panel = W.partitionBy(entity)
    return df.withColumns(
        {
            template.format(year=b): F.try_divide(
                F.max(F.when(F.col(year) == b, F.col(value))).over(panel), F.col(value)
            )
            for b in bases
        }
    )


def deflate(df: DataFrame, factors: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Products ``{into: (money column, multiplier column)}``; a null multiplier gives null."""
    return df.withColumns({into: F.col(m) * F.col(f) for into, (m, f) in factors.items()})
