"""Wide bin reports per city and their combination with the statutory rates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from millgauge.functions import bins, clean
from millgauge.operators.joins import equi_join
from millgauge.operators.reshape import pivot_multi
from millgauge.plans.analysis import busiest_rows

# The columns of the published reports.
GEO = (
    "city_geoid",
    "city_name",
    "city_state_code",
    "city_population2020",
    "city_population2022",
    "city_rank",
)
VALUES = (
    "count",
    "TaxAmt_mean",
    "SaleAmt_mean",
    "TaxRate_mean",
    "TaxAmt_median",
    "SaleAmt_median",
    "TaxRate_median",
    "TaxRate",
)

# Short labels of the report columns.
NARROW_LABELS = {"2 - $120K-$180K": "120K_180K", "4 - $270K-$330K": "270K_330K"}
WIDE_LABELS = {"2 - $100K-$200K": "100K_200K", "4 - $250K-$350K": "250K_350K"}
ELEVEN_LABELS = dict(
    zip(
        [b.label for b in bins.ELEVEN],
        [
            "under100K",
            *[f"{i}00K_{i + 1}00K" for i in range(1, 9)],
            "900K_1M",
            "over1M",
        ],
    )
)
QUINTILE_LABELS = {str(i): str(i) for i in range(1, 6)}
TOTAL_LABELS = {"Total": "Total"}


def bin_report(
    summary: DataFrame,
    bin_column: str,
    labels: Mapping[str, str],
    mode: str = "Snapshot",
    geo: Sequence[str] = GEO,
    values: Sequence[str] = VALUES,
    cities: Sequence[str] | None = None,
    period: str = "SaleRecordingYear",
) -> DataFrame:
    """One row per city with ``{value}_{label}`` columns, most populous city first.

    In snapshot mode each city and bin shows the year with most sales in that city (over the listed
    bins); pooled mode has a single period. ``cities`` restricts the report.
    """
    rows = summary.where(F.col(bin_column).isin(*labels))
    if cities is not None:
        rows = rows.where(F.col(geo[0]).isin(*cities))
    rows = rows.withColumn(bin_column, clean.recode(F.col(bin_column), labels))
    ids = list(geo)
    if mode == "Snapshot":
        rows = busiest_rows(rows, [geo[0], bin_column], geo[0], period)
        ids.append(period)
    wide = pivot_multi(rows, ids, bin_column, values, list(labels.values()))
    return wide.withColumn(geo[0], F.col(geo[0]).try_cast("int")).orderBy(
        F.col("city_population2022").desc_nulls_last(), geo[0]
    )


def total_report(
    summary: DataFrame,
    mode: str = "Snapshot",
    geo: Sequence[str] = GEO,
    values: Sequence[str] = VALUES,
    cities: Sequence[str] | None = None,
    period: str = "SaleRecordingYear",
) -> DataFrame:
    """City totals, not pivoted."""
    rows = summary if cities is None else summary.where(F.col(geo[0]).isin(*cities))
    columns = [*geo, "Total", *values]
    if mode == "Snapshot":
        rows = busiest_rows(rows, [geo[0], "Total"], geo[0], period)
        columns.insert(len(geo), period)
    return (
        rows.select(*columns)
        .withColumn(geo[0], F.col(geo[0]).try_cast("int"))
        .orderBy(F.col("city_population2022").desc_nulls_last(), geo[0], "Total")
    )


# The columns of the published benchmark table.
BENCHMARK_COLUMNS = (
    "year",
    "table_state",
    "table_city",
    "place_id",
    "city_name",
    "state_code",
    "state_name",
    "population_2020",
    "tax_rate_median_value",
    "tax_rate_median_value_assessment_limits",
    "tax_rate_150k",
    "tax_rate_300k",
)


def combined_report(
    benchmark: DataFrame,
    total: DataFrame,
    narrow: DataFrame,
    wide: DataFrame,
    eleven: DataFrame,
    columns: Sequence[str] = BENCHMARK_COLUMNS,
) -> DataFrame:
    """Statutory-rate spine with the city medians and counts of all reports joined on.

    The eleven-band medians share two labels with the wide bands and get a ``bins_`` prefix there.
    """

    def pick(report: DataFrame, fields: Sequence[str], prefix: str = "") -> DataFrame:
        return report.select(
            F.col("city_geoid").alias("_city"),
            *[F.col(f"`{f}`").alias(f"{prefix}{f}") for f in fields],
        )

    spine = benchmark.select(*columns).distinct()
    out = equi_join(spine, pick(total, ["count", "TaxRate_median"]), {"place_id": "_city"}, "left")
    for report, labels in ((narrow, NARROW_LABELS), (wide, WIDE_LABELS)):
        fields = [f"{v}_{l}" for v in ("count", "TaxRate_median") for l in labels.values()]
        out = equi_join(out, pick(report, fields), {"place_id": "_city"}, "left")
    fields = [f"TaxRate_median_{l}" for l in ELEVEN_LABELS.values()]
    return equi_join(out, pick(eleven, fields, "bins_"), {"place_id": "_city"}, "left")
