"""Exact quantiles, distribution tables, box-plot statistics and median confidence intervals."""

from __future__ import annotations

import statistics
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millgauge.operators.heavy import HOT_ROWS, Running, attach, has_heavy, running_totals
from millgauge.operators.selection import (
    FETCH_ROWS,
    between,
    interpolated,
    listed_quantiles,
    long_values,
    quantile_ranks,
    select_ranks,
    value_bins,
)
from millgauge.sources.staged import cut_lineage


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    probs: Mapping[str, Sequence[float]],
    hot_rows: int | None = None,
) -> DataFrame:
    """Exact, linearly interpolated quantiles: one array column per measure in ``probs``.

    With a group of more than ``hot_rows`` rows (at most 10,000) the narrow columns are staged and the
    quantiles selected digit by digit: a group costs a bounded number of counts, whatever its size. Else
    every group is a sorted list of at most that length. Both give a group without values a row of nulls.
    """
    narrow = df.select(*by, *probs)
    fetch_rows = min(hot_rows or FETCH_ROWS, FETCH_ROWS)
    if not has_heavy(narrow, by, fetch_rows):
        return listed_quantiles(narrow, by, probs)
    narrow = cut_lineage(narrow, "measures")
    long = long_values(narrow, by, list(probs))
    found = select_ranks(value_bins(long, by), long, by, quantile_ranks(list(probs.values())), fetch_rows)
    return interpolated(found, by, probs)


def exact_quantiles_sorted(
    df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """The same quantiles by sorting: value counts, running totals, two order statistics each.

    A group without values gives a row with null.
    """
    groups = df.select(*by).distinct() if by else None
    ranked = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    spec = Running("_end", [F.col(value)], F.col("_rows"), "_n")
    ranked = running_totals(ranked, by, [spec], hot_rows)
    hits = None
    for p in probs:
        for r in (F.floor(F.lit(float(p)) * (F.col("_n") - 1)), F.ceil(F.lit(float(p)) * (F.col("_n") - 1))):
            hit = (r >= F.col("_end") - F.col("_rows")) & (r < F.col("_end"))
            entry = F.when(hit, F.array(r))
            hits = F.coalesce(entry, F.array().cast("array<bigint>")) if hits is None else F.concat(
                hits, F.coalesce(entry, F.array().cast("array<bigint>"))
            )
    found = (
        ranked.withColumn("_hits", F.array_distinct(hits))
        .where(F.size("_hits") > 0)
        .select(*by, "_n", value, F.explode("_hits").alias("_r"))
        .groupBy(*by, "_n")
        .agg(
            F.map_from_entries(
                F.collect_list(F.struct("_r", F.col(value).cast("double").alias("_v")))
            ).alias("_ranked")
        )
    )
    found = found.select(
        *by,
        F.array(*[between(lambda r: F.element_at("_ranked", r), F.col("_n"), p) for p in probs]).alias(value),
    )
    return found if groups is None else join_null_safe(groups, found, by)


def distribution(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Sequence[float] = (0.10, 0.25, 0.50, 0.75, 0.90),
    prefix: str = "tax_rate",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Median, mean, sd, chosen percentiles, interquartile range and coefficient of variation."""
    points = sorted({*probs, 0.25, 0.5, 0.75})
    moments = df.groupBy(*by).agg(
        F.avg(value).alias(f"{prefix}_mean"), F.stddev_samp(value).alias(f"{prefix}_sd")
    )
    quantiles = exact_quantiles(df, by, {value: points}, hot_rows)
    at = {p: F.col(value)[points.index(p)] for p in points}
    table = join_null_safe(moments, quantiles, by)
    return table.select(
        *by,
        at[0.5].alias(f"{prefix}_median"),
        f"{prefix}_mean",
        f"{prefix}_sd",
        *[at[p].alias(f"{prefix}_{round(p * 100)}pct") for p in probs],
        (at[0.75] - at[0.25]).alias("iqr_diff75_25"),
        F.try_divide(F.col(f"{prefix}_sd"), F.col(f"{prefix}_mean")).alias("coeff_of_var"),
    )


def join_null_safe(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on same-named keys where null matches null."""
    renamed = right.withColumnsRenamed({k: f"_key_{i}" for i, k in enumerate(by)})
    match = None
    for i, k in enumerate(by):
        same = left[k].eqNullSafe(renamed[f"_key_{i}"])
        match = same if match is None else match & same
    return left.join(renamed, match, how).drop(*[f"_key_{i}" for i in range(len(by))])


def interquartile_range(
    df: DataFrame, by: Sequence[str], value: str, into: str, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """One row per group with its interquartile range."""
    q = exact_quantiles(df, by, {value: [0.25, 0.75]}, hot_rows)
    return q.select(*by, (F.col(value)[1] - F.col(value)[0]).alias(into))


def boxplot(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    limits: tuple[float, float] | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Box-plot numbers per group without outliers, in order of the box width.

    Whiskers are the most extreme values within 1.5 box widths of the box. ``limits`` leaves out
    values off the axis before anything is computed, as a chart with fixed axis limits does.
    ``order_iqr`` is taken before that cut, so the ordering does not depend on the axis.
    """
    shown = df if limits is None else df.where(F.col(value).between(*limits))
    q = exact_quantiles(shown, by, {value: [0.25, 0.5, 0.75]}, hot_rows).select(
        *by,
        F.col(value)[0].alias("q1"),
        F.col(value)[1].alias("median"),
        F.col(value)[2].alias("q3"),
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    boxes = (
        join_null_safe(shown, q, by, "inner")
        .groupBy(*by, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        )
    )
    order = interquartile_range(df, by, value, "order_iqr", hot_rows)
    return join_null_safe(boxes, order, by).orderBy("order_iqr", *by)


def _interval_rank():
    """The rank function as a closure: Spark ships it by value, so executors need not import this module."""
    import numpy as np

    def rank_of(size: int, conf: float) -> int:
        n = int(size)
        if n <= 0:
            return 0
        reach = int(40 * max(n, 1) ** 0.5) + 40
        low, high = max(0, n // 2 - reach), min(n, n // 2 + reach)
        k = np.arange(low, high, dtype="float64")
        logs = np.concatenate([[0.0], np.cumsum(np.log(n - k) - np.log(k + 1))])
        weight = np.exp(logs - logs.max())
        cdf = np.cumsum(weight) / weight.sum()
        # the same small slack the usual quantile routines use, so exact hits are not lost to rounding
        return low + int(np.searchsorted(cdf, (1 - conf) / 2 * (1 - 64 * np.finfo(float).eps), side="left"))

    return rank_of


def median_interval_rank(size: int, conf: float) -> int:
    """Smallest k with P(Binomial(size, 1/2) <= k) >= (1 - conf) / 2.

    Probabilities are built outwards from the mode by their ratios, over the part of the range
    that carries any weight, so the cost grows with the square root of ``size``.
    """
    return _interval_rank()(size, conf)


def median_ci(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    conf: float = 0.90,
    prefix: str = "TaxRate_median",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Median with its exact two-sided confidence interval from order statistics.

    A group without values gives a row with nulls. Bounds are the k-th smallest and k-th largest value with k the binomial quantile at
    ``(1 - conf) / 2``; both are null when the group is too small for a bound (k = 0). The table from
    group size to k is broadcast: groups of different sizes in a table of N rows number at most
    ``sqrt(2 N)``, 1.4 million for 10^12 rows.
    """

    rank_of = _interval_rank()

    @F.pandas_udf("long")
    def rank_for(sizes: pd.Series) -> pd.Series:
        known = {n: rank_of(n, conf) for n in sizes.unique()}
        return sizes.map(known)

    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    spec = Running("_end", [F.col(value)], F.col("_rows"), "_n")
    ranked = running_totals(counts, by, [spec], hot_rows)
    sizes = counts.groupBy(*by).agg(F.sum("_rows").alias("_size"))
    ks = sizes.select("_size").distinct().withColumn("_k", rank_for("_size"))
    ranked = attach(ranked, ks.withColumnRenamed("_size", "_n"), ["_n"])

    def at(rank: Column) -> Column:
        hit = (rank > F.col("_end") - F.col("_rows")) & (rank <= F.col("_end"))
        return F.max(F.when(hit, F.col(value)))

    middle = (at(F.expr("(_n + 1) div 2")) + at(F.expr("_n div 2 + 1"))) / 2
    bounds = ranked.groupBy(*by).agg(
        middle.alias(f"{prefix}_est"),
        F.max(F.when(F.col("_k") > 0, F.lit(1))).alias("_has"),
        at(F.col("_k")).alias("_lo"),
        at(F.col("_n") - F.col("_k") + 1).alias("_hi"),
    ).select(
        *by,
        f"{prefix}_est",
        F.when(F.col("_has") == 1, F.col("_lo")).alias(f"{prefix}_lo_ci"),
        F.when(F.col("_has") == 1, F.col("_hi")).alias(f"{prefix}_hi_ci"),
    )
    return join_null_safe(df.select(*by).distinct(), bounds, by) if by else bounds


def compare_with_statutory(
    df: DataFrame, statutory: str, prefix: str = "TaxRate_median"
) -> DataFrame:
    """Difference to the statutory rate and whether that rate lies outside the interval.

    A missing statutory rate or bound falls to ``Within CI``, the default branch.
    """
    outside = (F.col(f"{prefix}_lo_ci") > F.col(statutory)) | (
        F.col(f"{prefix}_hi_ci") < F.col(statutory)
    )
    return df.withColumns(
        {
            "tax_rate_diff": F.col(f"{prefix}_est") - F.col(statutory),
            "outside_ci": F.when(outside, "Outside CI").otherwise("Within CI"),
        }
    )


def normal_critical_value(conf: float = 0.90) -> float:
    """Two-sided standard-normal critical value."""
    return statistics.NormalDist().inv_cdf((1 + conf) / 2)


def two_sample_z(
    wide: DataFrame,
    high: str = "5",
    low: str = "1",
    measure: str = "TaxRate",
    conf: float = 0.90,
) -> DataFrame:
    """Gap tests between two bins of a pivoted summary, on means and on medians.

    Both tests share the standard error of the means. A missing input leaves the statistic and
    its flag null.
    """
    critical = normal_critical_value(conf)

    def c(stat: str, bin_: str) -> Column:
        return F.col(f"`{measure}{stat}_{bin_}`")

    error = F.sqrt(
        F.try_divide(F.pow(c("_std", high), 2), F.col(f"`count_{high}`"))
        + F.try_divide(F.pow(c("_std", low), 2), F.col(f"`count_{low}`"))
    )
    out = {}
    for short, stat in (("mean", "_mean"), ("med", "_median")):
        gap = c(stat, high) - c(stat, low)
        test = F.try_divide(gap, error)
        out[f"test_stat_{short}"] = test
        out[f"gt_critval_{short}"] = F.when(test > critical, 1).when(test.isNotNull(), 0)
        out[f"{measure}_{high}_{low}_diff_{short}"] = gap
    out["ratio"] = F.try_divide(c("_median", high), c("", low))
    out["ratio_fixed"] = F.try_divide(c("_median", high), c("_median", low))
    return wide.withColumns(out)


def margin_of_error(df: DataFrame, measure: str = "TaxRate", conf: float = 0.90) -> DataFrame:
    """Mean plus or minus ``z * std / sqrt(count)``."""
    z = normal_critical_value(conf)
    moe = F.lit(z) * F.try_divide(F.col(f"{measure}_std"), F.sqrt(F.col("count")))
    return df.withColumns(
        {
            f"{measure}_moe": moe,
            f"{measure}_upper": F.col(f"{measure}_mean") + moe,
            f"{measure}_lower": F.col(f"{measure}_mean") - moe,
        }
    )
