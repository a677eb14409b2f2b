"""City analysis: rate distributions, bin tables, quintile gaps, statutory comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from millgauge.functions.bins import rank_quartile
from millgauge.operators.heavy import HOT_ROWS
from millgauge.operators.joins import equi_join, in_values_of
from millgauge.operators.quality import dedupe
from millgauge.operators.quantiles import (
    boxplot,
    compare_with_statutory,
    distribution,
    exact_quantiles,
    interquartile_range,
    join_null_safe,
    margin_of_error,
    median_ci,
    two_sample_z,
)
from millgauge.operators.ranks import dense_rank_values, keep_modal_period, ntile
from millgauge.operators.reshape import pivot_multi
from millgauge.sources.staged import cut_lineage

# The columns of the published quintile table.
QUINTILE_VALUES = (
    "count",
    "SaleAmt_median",
    "SaleAmt_mean",
    "TaxRate",
    "TaxRate_median",
    "TaxRate_mean",
    "TaxRate_std",
    "AssdValue_SaleAmt_Ratio_median",
    "TaxAmt_sum",
    "SaleAmt_sum",
)
CITY = ("city_geoid", "city_name", "city_state_code")


def busiest_year_sales(tiles: DataFrame, benchmark: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """Trimmed sales of each city's busiest year, for cities the benchmark covers.

    The busiest year is chosen over all tiles, before any filter; tied years all stay, and a year
    with a single sale does not count. The rows are staged, as every table made of them reads them again.
    """
    chosen = keep_modal_period(
        tiles, ["city_geoid"], "SaleRecordingYear", ties="dense", min_total=1
    ).where(
        (F.col("TaxRate") > 0)
        & (F.col("TaxRate") <= max_rate)
        & (F.col("TaxRate_Outliers") == "Middle 96%")
        & F.col("city_geoid").isNotNull()
        & (F.col("RecentSaleByYear") == 1)
    )
    covered = in_values_of(chosen, benchmark, "city_geoid", "place_id", "int")
    named = covered.withColumn(
        "city_state", F.concat("city_name", F.lit(", "), "city_state_code")
    ).withColumn("city_geoid_int", F.col("city_geoid").try_cast("int"))
    return cut_lineage(named, "busiest_sales")


def with_city_spread(
    sales: DataFrame,
    thresholds: Sequence[int] = (18, 36, 54),
    tiebreak: str = "PropertyID",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """City interquartile range, its rank and quartile, and the sale quintile (1 = lowest price)."""
    spread = interquartile_range(sales, ["city_state"], "TaxRate", "IQR_city", hot_rows)
    spread = dense_rank_values(spread, "IQR_city", "IQR_rank", hot_rows)
    spread = spread.withColumn("IQR_quartile", rank_quartile(F.col("IQR_rank"), thresholds))
    joined = join_null_safe(sales, spread, ["city_state"])
    return ntile(joined, "SaleAmt", 5, ["city_state"], tiebreak, "sale_quintile", hot_rows)


def distribution_table(sales: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Rate distribution per city."""
    return distribution(
        sales, ["city_geoid", "city_name", "city_state"], "TaxRate", hot_rows=hot_rows
    )


def boxplot_table(
    sales: DataFrame, limits: tuple[float, float] = (0.0, 0.08), hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Box-plot numbers per city on a fixed axis, narrowest city first."""
    return boxplot(sales, ["city_state"], "TaxRate", limits, hot_rows)


def benchmark_rates(benchmark: DataFrame) -> DataFrame:
    """One row of statutory rates per place: the first in table order."""
    one = dedupe(benchmark, ["place_id"], [F.col("table_order").asc(), F.col("table_group").asc()])
    return one.select(
        "place_id",
        F.col("tax_rate_median_value").alias("statutory_tax_rate_median"),
        F.col("tax_rate_150k").alias("statutory_tax_rate_150k"),
        F.col("tax_rate_300k").alias("statutory_tax_rate_300k"),
    )


def distinct_rates(benchmark: DataFrame) -> DataFrame:
    """Distinct place and median-value rate pairs."""
    return benchmark.select("place_id", "tax_rate_median_value").distinct()


def rate_medians(
    sales: DataFrame, by: Sequence[str], hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Median rate and sale count per group."""
    medians = exact_quantiles(sales, by, {"TaxRate": [0.5]}, hot_rows).select(
        *by, F.col("TaxRate")[0].alias("TaxRate_median")
    )
    counts = sales.groupBy(*by).agg(F.count(F.lit(1)).alias("count"))
    return join_null_safe(medians, counts, by)


def statutory_effective_table(
    sales: DataFrame,
    benchmark: DataFrame,
    totals: DataFrame,
    bands: Sequence[str] = ("2 - $120K-$180K", "4 - $270K-$330K"),
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Effective medians (overall and in two price bands) beside the statutory rates.

    ``TaxRate_median_summary`` carries the same median from the summary tables as a cross-check.
    """
    city = [*CITY, "SaleRecordingYear"]
    overall = rate_medians(sales, city, hot_rows)
    by_band = rate_medians(sales, ["city_geoid", "SaleBinsNarrow"], hot_rows).where(
        F.col("SaleBinsNarrow").isin(*bands)
    )
    wide = pivot_multi(by_band, ["city_geoid"], "SaleBinsNarrow", ["count", "TaxRate_median"], bands)
    joined = equi_join(
        overall.withColumn("city_geoid_int", F.col("city_geoid").try_cast("int")),
        wide,
        ["city_geoid"],
        "left",
    )
    joined = equi_join(joined, benchmark_rates(benchmark), {"city_geoid_int": "place_id"}, "left")
    check = totals.select(
        F.col("city_geoid").try_cast("int").alias("_city"),
        F.col("TaxRate_median").alias("TaxRate_median_summary"),
    )
    joined = equi_join(joined, check, {"city_geoid_int": "_city"}, "left")
    return joined.select(
        *city,
        F.concat("city_name", F.lit(", "), "city_state_code").alias("city_state"),
        "TaxRate_median",
        *[F.col(f"`TaxRate_median_{b}`") for b in bands],
        "TaxRate_median_summary",
        "statutory_tax_rate_median",
        "statutory_tax_rate_150k",
        "statutory_tax_rate_300k",
    )


def busiest_rows(
    table: DataFrame, cell: Sequence[str], entity: str = "city_geoid", period: str = "SaleRecordingYear"
) -> DataFrame:
    """Per cell (city, or city and bin), the row of the year with most sales in that city.

    Year totals are summed over the given rows; the earlier year wins a tie. Works on summary
    tables, where a city has at most bins times years rows.
    """
    totals = table.groupBy(entity, period).agg(F.sum("count").alias("count_sum"))
    joined = join_null_safe(table, totals, [entity, period])
    return dedupe(joined, cell, [F.col("count_sum").desc(), F.col(period).asc()])


def totals_table(total: DataFrame, benchmark: DataFrame) -> DataFrame:
    """City totals of the busiest year beside the statutory rate, with margins of error."""
    covered = in_values_of(total, benchmark, "city_geoid", "place_id", "int")
    busiest = busiest_rows(covered, ["city_geoid"]).withColumns(
        {
            "city_state": F.concat("city_name", F.lit(", "), "city_state_code"),
            "city_geoid_int": F.col("city_geoid").try_cast("int"),
        }
    )
    joined = equi_join(busiest, distinct_rates(benchmark), {"city_geoid_int": "place_id"}, "left")
    return margin_of_error(joined).withColumn(
        "TaxRate_coefficient_of_variation", F.try_divide("TaxRate_std", "TaxRate")
    ).withColumnRenamed("tax_rate_median_value", "TaxRate_median_statutory")


def quintile_rows(quintiles: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Quintile summary rows of each city's busiest year."""
    covered = in_values_of(quintiles, benchmark, "city_geoid", "place_id", "int")
    return busiest_rows(covered, ["city_geoid", "SaleAmt_Quintile"]).withColumn(
        "city_state", F.concat("city_name", F.lit(", "), "city_state_code")
    )


def quintile_gaps(rows: DataFrame, city: Sequence[str], conf: float = 0.90) -> DataFrame:
    """One row per city and year with all quintile values and the bottom-against-top tests.

    Quintile 1 holds the highest prices, quintile 5 the lowest.
    """
    wide = pivot_multi(
        rows,
        [*city, "city_state", "SaleRecordingYear"],
        "SaleAmt_Quintile",
        QUINTILE_VALUES,
        ["1", "2", "3", "4", "5"],
    )
    return two_sample_z(wide, "5", "1", "TaxRate", conf).orderBy(
        F.col("city_population2022").desc_nulls_last(), "city_geoid"
    )


def quintile_chart_rows(rows: DataFrame, gaps: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Data behind the quintile chart: top and bottom rows, ordered by the median gap."""
    joined = equi_join(
        rows,
        gaps.select("city_geoid", "TaxRate_5_1_diff_mean", "TaxRate_5_1_diff_med"),
        ["city_geoid"],
        "left",
    ).withColumn("city_geoid_int", F.col("city_geoid").try_cast("int"))
    joined = equi_join(joined, distinct_rates(benchmark), {"city_geoid_int": "place_id"}, "left")
    return joined.where(F.col("SaleAmt_Quintile").isin("1", "5")).orderBy(
        "TaxRate_5_1_diff_med", "city_state", "SaleAmt_Quintile"
    )


def interval_table(
    sales: DataFrame, benchmark: DataFrame, conf: float = 0.90, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Median confidence interval per city and whether the statutory rate lies inside."""
    ci = median_ci(sales, [*CITY, "SaleRecordingYear"], "TaxRate", conf, hot_rows=hot_rows)
    joined = equi_join(
        ci.withColumn("city_geoid_int", F.col("city_geoid").try_cast("int")),
        distinct_rates(benchmark),
        {"city_geoid_int": "place_id"},
        "left",
    )
    return compare_with_statutory(joined, "tax_rate_median_value").withColumn(
        "city_state", F.concat("city_name", F.lit(", "), "city_state_code")
    )
