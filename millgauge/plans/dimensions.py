"""Dimension tables: county crosswalk, balanced price-index panel, places and polygon layers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from millgauge.functions import clean
from millgauge.operators.heavy import HOT_ROWS
from millgauge.operators.joins import equi_join
from millgauge.operators.panel import annualise, coalesce_levels, loess, rebase
from millgauge.operators.ranks import fill_down_up, global_rank
from millgauge.operators.reshape import complete, union_all

# Area-type labels, territories left out, the place summary level, the name cut.
AREA_TYPES = {
    "Metropolitan Statistical Area": "MSA",
    "Micropolitan Statistical Area": "muSA",
}
TERRITORIES = ("60", "66", "69", "72", "74", "78")
PLACE_LEVEL = "162"
NAME_CUT = r"(\[|-|]|/|[(])"
LEVELS = ("hpi_county", "hpi_metro", "hpi_nonmetro", "hpi_state")


def county_crosswalk(states: DataFrame, cbsa: DataFrame, population: DataFrame) -> DataFrame:
    """Counties with their metro area (or a state residual) and population.

    ``states``: state_codes, state_fips, state_name, county_code, county_name. ``cbsa``: the
    delineation file with its original headers. ``population``: GEOID, estimate.
    """
    areas = clean.sanitise_columns(cbsa, r"\s+|\.|/")
    areas = areas.select(
        F.concat(
            clean.pad_left(F.col("fips_state_code"), 2), clean.pad_left(F.col("fips_county_code"), 3)
        ).alias("county_fips"),
        F.col("cbsa_code").cast("string").alias("cbsa_fips"),
        "cbsa_title",
        F.col("metropolitan_micropolitan_statistical_area").alias("area_type"),
        "central_outlying_county",
    )
    counties = states.withColumn("county_fips", F.concat("state_fips", "county_code"))
    joined = equi_join(counties, areas, ["county_fips"], "left")
    people = population.select("GEOID", F.col("estimate").cast("double").alias("county_pop20"))
    return equi_join(joined, people, {"county_fips": "GEOID"}, "left").withColumns(
        {
            "cbsa_fips": F.coalesce("cbsa_fips", F.concat(F.lit("state_"), "state_fips")),
            "cbsa_title": F.coalesce("cbsa_title", F.concat(F.lit("Non-CBSA "), "state_name")),
            "area_type": F.coalesce(
                clean.recode(F.col("area_type"), AREA_TYPES, F.col("area_type")), F.lit("Non-CBSA")
            ),
            "central_outlying_county": F.coalesce("central_outlying_county", F.lit("Residual")),
            "county_pop20": F.coalesce("county_pop20", F.lit(0.0)),
        }
    )


def index_levels(
    counties: DataFrame,
    hpi_county: DataFrame,
    hpi_metro: DataFrame,
    hpi_nonmetro: DataFrame,
    hpi_state: DataFrame,
    min_year: int = 2000,
    last_year: int = 2023,
) -> DataFrame:
    """County-year grid with the county, metro, non-metro and state index side by side.

    The last year is added for every county whose file does not reach it. Quarterly sources are averaged per year. The county-year grid is completed once: the left
    joins after it keep its rows, and a county's state and metro area do not vary.
    """
    listed = counties.where(~F.col("state_fips").isin(*TERRITORIES))
    county = hpi_county.select(
        "county_fips",
        F.col("year").try_cast("int").alias("year"),
        clean.grouped_number(F.col("hpi"), (".", "")).alias("hpi_county"),
    ).where(F.col("year") >= min_year)
    extra = listed.select(
        "county_fips", F.lit(last_year).alias("year"), F.lit(None).cast("double").alias("hpi_county")
    )
    extra = extra.join(county.select("county_fips", "year"), ["county_fips", "year"], "left_anti")
    attributes = listed.select("county_fips", "cbsa_fips")
    grid = complete(union_all([county, extra]), ["county_fips"], "year")
    grid = equi_join(grid, attributes, ["county_fips"], "left").withColumn(
        "state_fips", F.substring("county_fips", 1, 2)
    )

    codes = listed.select("state_codes", F.col("state_fips").alias("_state")).distinct()
    metro = annualise(
        hpi_metro.select(
            F.col("fips").cast("string").alias("cbsa_fips"),
            "year",
            clean.grouped_number(F.col("index"), ("-", "")).alias("index"),
        ),
        ["cbsa_fips"],
        "year",
        "index",
        "hpi_metro",
    ).where(F.col("year") >= min_year)
    nonmetro = annualise(hpi_nonmetro, ["state"], "year", "index", "hpi_nonmetro").where(
        F.col("year") >= min_year
    )
    nonmetro = equi_join(nonmetro, codes, {"state": "state_codes"}, "left").select(
        F.col("_state").alias("state_fips"), "year", "hpi_nonmetro"
    )
    state = annualise(hpi_state, ["state_code"], "year", "index", "hpi_state").where(
        F.col("year") >= min_year
    )
    state = equi_join(state, codes, {"state_code": "state_codes"}, "left").select(
        F.col("_state").alias("state_fips"), "year", "hpi_state"
    )
    state = complete(state, ["state_fips"], "year")

    joined = equi_join(grid, state, ["state_fips", "year"], "left", null_safe=True)
    joined = equi_join(joined, nonmetro, ["state_fips", "year"], "left", null_safe=True)
    return equi_join(joined, metro, ["cbsa_fips", "year"], "left", null_safe=True)


def smooth_levels(levels: DataFrame, span: float = 0.75) -> DataFrame:
    """Missing cells of each level from a local regression over its filled series."""
    filled = fill_down_up(
        levels, ["county_fips", "state_fips", "cbsa_fips"], "year", {c: f"{c}_fill" for c in LEVELS}
    )
    fitted = loess(
        filled, ["county_fips"], "year", {f"{c}_fill": f"{c}_fill_hpi_impute" for c in LEVELS}, span
    )
    return fitted.select(
        "year",
        "county_fips",
        "state_fips",
        "cbsa_fips",
        *[F.coalesce(c, f"{c}_fill_hpi_impute").alias(c) for c in LEVELS],
    )


def county_index(
    levels: DataFrame, bases: Sequence[int] = (2023, 2021), span: float = 0.75
) -> DataFrame:
    """Balanced county panel of multipliers to each base year."""
    smoothed = coalesce_levels(smooth_levels(levels, span), LEVELS, "hpi_index")
    rebased = rebase(smoothed, "county_fips", "year", "hpi_index", bases)
    return rebased.select("county_fips", "year", *[f"hpi_index_{b}" for b in bases])


def place_population(estimates: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """City populations with a national rank, from the population-estimates file."""
    lower = clean.sanitise_columns(estimates)
    cities = lower.where(F.col("sumlev").cast("string") == PLACE_LEVEL).select(
        clean.pad_left(F.col("state"), 2).alias("state_fips_city"),
        clean.pad_left(F.col("place"), 5).alias("place"),
        F.col("name").alias("cityname"),
        F.col("stname"),
        "popestimate2020",
        "popestimate2021",
        "popestimate2022",
    )
    cities = cities.withColumn("placeid", F.concat("state_fips_city", "place"))
    return global_rank(cities, "popestimate2022", "placeid", "city_rank", hot_rows)


def city_places(places: DataFrame, population: DataFrame, state_codes: Sequence[str]) -> DataFrame:
    """City polygons with short names, populations and ranks, for the listed states."""
    shapes = clean.sanitise_columns(places)
    joined = equi_join(
        shapes,
        population.select("placeid", "popestimate2020", "popestimate2022", "city_rank"),
        {"geoid": "placeid"},
        "left",
    )
    return joined.where(F.col("stusps").isin(*state_codes)).select(
        F.col("geoid").alias("city_geoid"),
        clean.split_first(F.col("name"), NAME_CUT).alias("city_name"),
        F.col("stusps").alias("city_state_code"),
        F.col("popestimate2020").alias("city_population2020"),
        F.col("popestimate2022").alias("city_population2022"),
        "city_rank",
        "rings",
    )


def polygon_layer(shapes: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """A layer with lower-cased headers reduced to renamed attributes and the geometry.

    ``names`` maps source columns to output columns, for example the school-district, congressional
    district or postal-area attributes.
    """
    lower = clean.sanitise_columns(shapes)
    return lower.select(*[F.col(a).alias(b) for a, b in names.items()], "rings")
