"""Optional side tables around the main pipeline."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from millgauge.functions.bins import quantile_of_percentile
from millgauge.operators.joins import equi_join
from millgauge.plans.etl import MIN_YEAR, ROLL_CLASS


def sale_year_counts(ranked: DataFrame, min_year: int = MIN_YEAR) -> DataFrame:
    """How many years each property has a qualifying newest sale in."""
    qualifying = (
        F.col("PropertyID").isNotNull()
        & (F.col("SaleRecordingYear") >= min_year)
        & (F.col("SaleFlag") == 1)
        & (F.col("RecentSaleByYear") == 1)
    )
    return ranked.where(qualifying).groupBy("PropertyID").agg(
        F.count(F.lit(1)).alias("SaleYearCount")
    )


def value_series(
    table: DataFrame,
    year: str,
    values: Mapping[str, str],
    positive: str,
    min_year: int | None = None,
) -> DataFrame:
    """One kind of value per property and year from a roll or value history.

    ``values`` maps source to output columns; rows without a positive ``positive`` value, a year or
    a property id are left out, and years before ``min_year`` if given.
    """
    kept = table.where(
        F.col("PropertyID").isNotNull() & F.col(year).isNotNull() & (F.col(positive) > 0)
    )
    if min_year is not None:
        kept = kept.where(F.col(year) >= min_year)
    return kept.select("PropertyID", year, *[F.col(a).alias(b) for a, b in values.items()])


def sales_with_series(
    sales: DataFrame,
    roll: DataFrame,
    tax_series: DataFrame,
    crosswalk: DataFrame,
    hpi: DataFrame,
    static: Sequence[str] = ("APN", "FIPS"),
) -> DataFrame:
    """Sales with the property's current roll row, and the tax of the sale year where known.

    Unlike the main staging join, a sale without a tax row, place or index stays.
    """
    current = roll.where((F.col("PropertyClassID") == ROLL_CLASS) & (F.col("TaxAmt") > 0)).select(
        "PropertyID",
        *static,
        F.col("TaxYear").alias("TaxYear_Current"),
        F.col("TaxAmt").alias("TaxAmt_Current"),
    )
    joined = equi_join(sales, current, ["PropertyID"], "inner")
    joined = equi_join(
        joined, tax_series, {"PropertyID": "PropertyID", "SaleRecordingYear": "TaxYear"}, "left"
    )
    joined = equi_join(joined, crosswalk.drop("APN", "FIPS", "geometry"), ["PropertyID"], "left")
    index = hpi.select("county_fips", "year", "hpi_index_2021")
    return equi_join(joined, index, {"FIPS": "county_fips", "SaleRecordingYear": "year"}, "left")


def county_quantiles(tiles: DataFrame) -> DataFrame:
    """Deciles and quintiles of the county percentiles of price and rate."""
    return tiles.withColumns(
        {
            f"{measure}_County_{name}": quantile_of_percentile(
                F.col(f"{measure}_County_Percentile"), groups
            )
            for measure in ("SaleAmt", "TaxRate")
            for name, groups in (("Decile", 10), ("Quintile", 5))
        }
    )
