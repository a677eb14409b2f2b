"""From raw property roll and deeds to summary tables.

Every step is a DataFrame function; :func:`run` composes them with staged parquet in between.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from millgauge import schemas
from millgauge.functions import bins, clean
from millgauge.functions.geo import with_geohash
from millgauge.operators.heavy import HOT_ROWS
from millgauge.operators.joins import Level, equi_join, fallback_lookup, role_lookup
from millgauge.operators.lookup import skew_safe_lookup
from millgauge.operators.panel import deflate
from millgauge.operators.quality import coverage_report, duplicates
from millgauge.operators.ranks import percentile_ranks
from millgauge.operators.recency import newest_per_period
from millgauge.operators.spatial import Layer, layered_join, located_only
from millgauge.operators.summary import POOLED, SNAPSHOT, Mode, summary_cube
from millgauge.sources import export, staged
from millgauge.sources.delimited import read_delimited
from millgauge.sources.increments import Grown, grow
from millgauge.sources.manifest import Built, Manifest, fingerprint, kept_stage, whole_stage

# Code domains and qualifying codes of the source files.
ROLL_CLASS = "R"
OWNER_OCCUPIED = ("B", "O", "Y")
GEO_STATUS = ("5", "7", "9", "A", "B", "X", "R")
PROPERTY_CLASS = ("R", "C", "O", "F", "I", "T", "A", "V", "E")
LAND_USE = (10, 9309)
PARTIAL_INTEREST = tuple(str(i) for i in range(1, 10))
DOCUMENT_TYPE = (
    *(str(i) for i in range(1, 100)),
    *("A", "B", "C", "D", "E", "F", "G", "H", "K", "DT", "L", "M", "N", "O"),
)
TRANSACTION_TYPE = tuple(str(i) for i in range(1, 7))
SALES_PRICE_CODE = tuple(str(i) for i in range(1, 45))
MORTGAGE_TRANSACTION_TYPE = tuple(str(i) for i in range(1, 7))
MORTGAGE_TYPE = tuple(str(i) for i in range(1, 35))
SALE_ID_PREFIX = ("1", "6")
SALE_TRANSACTION = ("2", "3")

YES_FLAGS = (
    "MatchedFlag",
    "ResaleFlag",
    "NewConstructionFlag",
    "InterFamilyFlag",
    "ForeclosureFlag",
    "ReoSaleFlag",
)
DEED_DOMAINS = {
    "PartialInterestFlag": PARTIAL_INTEREST,
    "DocumentType": DOCUMENT_TYPE,
    "TransactionType": TRANSACTION_TYPE,
    "SalesPriceCode": SALES_PRICE_CODE,
    "FirstMtgLoanTransType": MORTGAGE_TRANSACTION_TYPE,
    "FirstMtgLoanType": MORTGAGE_TYPE,
}
DEED_COLUMNS = (
    "PropertyID",
    "RecordingDate",
    "SaleAmt",
    "SalesPriceCode",
    "TransferTax",
    "FATransactionID",
    "FirstMtgAmt",
    "TransactionType",
    "FATransactionID_1",
    "RecordingYear",
    "SaleYear",
)
COUNTY_COLUMNS = tuple(f.name for f in schemas.COUNTY_CBSA.fields)
CITY_COLUMNS = (
    "city_geoid",
    "city_name",
    "city_state_code",
    "city_population2020",
    "city_population2022",
    "city_rank",
    "city_places_area",
)
MIN_YEAR = 2019


def qualifying_roll(raw: DataFrame) -> DataFrame:
    """Residential rows with a property id."""
    return raw.where((F.col("PropertyClassID") == ROLL_CLASS) & F.col("PropertyID").isNotNull())


def clean_annual(raw: DataFrame) -> DataFrame:
    """Cleaned roll. All derivations read the input row, so the joined code uses unpadded parts."""
    c = F.col
    return (
        qualifying_roll(raw)
        .withColumns(
            {
                "PropertyID": c("PropertyID").try_cast("long"),
                "FIPS": clean.pad_left(c("FIPS"), 5),
                "FATimeStamp": clean.parse_yyyymmdd(c("FATimeStamp")),
                "CurrentSaleRecordingDate": clean.parse_yyyymmdd(c("CurrentSaleRecordingDate")),
                "AssdYear": c("AssdYear").try_cast("short"),
                "MarketYear": c("MarketYear").try_cast("short"),
                "TaxYear": c("TaxYear").try_cast("short"),
                "TaxAmt": c("TaxAmt") / 100,
                "OwnerOccupied": clean.flag(c("OwnerOccupied"), OWNER_OCCUPIED),
                "SitusLatitude": clean.sentinel_null(c("SitusLatitude"), 0.0),
                "SitusLongitude": clean.sentinel_null(c("SitusLongitude"), 0.0),
                "SitusCensusTract": clean.pad_left(c("SitusCensusTract"), 6),
                "SitusCensusBlock": clean.pad_left(c("SitusCensusBlock"), 4),
                "SitusGeoStatusCode": clean.domain(c("SitusGeoStatusCode"), GEO_STATUS),
                "PropertyClassID": clean.domain(c("PropertyClassID"), PROPERTY_CLASS),
                "LandUseCode": clean.in_range(c("LandUseCode"), *LAND_USE),
                "FIPS_SitusCensusTract": clean.concat_or_first(c("FIPS"), c("SitusCensusTract")),
            }
        )
        .withColumn("CurrentSaleRecordingYear", F.year("CurrentSaleRecordingDate"))
    )


def qualifying_deeds(raw: DataFrame) -> DataFrame:
    """Deeds with a positive price and a property id."""
    return raw.where((F.col("SaleAmt") > 0) & F.col("PropertyID").isNotNull())


def clean_deed_fields(raw: DataFrame) -> DataFrame:
    """All cleaned deed fields, before the projection to the staged columns."""
    c = F.col
    return (
        qualifying_deeds(raw)
        .withColumns(
            {
                "RecordingYearSlice": F.substring(c("RecordingDate").cast("string"), 1, 4),
                "PropertyID": c("PropertyID").try_cast("long"),
                "FIPS": clean.pad_left(c("FIPS"), 5),
                "RecordingDate": clean.parse_yyyymmdd(c("RecordingDate")),
                "SaleDate": clean.parse_yyyymmdd(c("SaleDate")),
                "FATimeStamp": clean.parse_yyyymmdd(c("FATimeStamp")),
                "FATransactionID_1": F.substring(c("FATransactionID").cast("string"), 1, 1),
                "ArmsLengthFlag": clean.tri_flag(c("ArmsLengthFlag"), "T", "F"),
                **{f: clean.flag(c(f), ("Y",)) for f in YES_FLAGS},
                **{f: clean.domain(c(f), codes) for f, codes in DEED_DOMAINS.items()},
            }
        )
        .withColumns(
            {
                "RecordingYear": F.year("RecordingDate"),
                "SaleYear": F.year("SaleDate"),
                "FATimeStampYear": F.year("FATimeStamp"),
            }
        )
    )


def clean_deeds(raw: DataFrame) -> DataFrame:
    """Cleaned deeds with the staged columns only."""
    return clean_deed_fields(raw).select(*DEED_COLUMNS)


def qualifying_history(raw: DataFrame) -> DataFrame:
    """Value-history rows with a property id."""
    return raw.where(F.col("PropertyID").isNotNull())


def clean_history(raw: DataFrame) -> DataFrame:
    """Value history: typed ids and years."""
    return qualifying_history(raw).withColumns(
        {
            "PropertyID": F.col("PropertyID").try_cast("long"),
            "FIPS": clean.pad_left(F.col("FIPS"), 5),
            **{
                y: F.col(y).try_cast("short")
                for y in ("AssdYear", "MarketValueYear", "ApprYear", "TaxableYear")
            },
        }
    )


def flag_sales(deeds: DataFrame) -> DataFrame:
    """Sale year (sale date first, else recording date) and the 0/1 qualifying flag."""
    sale = F.col("FATransactionID_1").isin(*SALE_ID_PREFIX) & F.col("TransactionType").isin(
        *SALE_TRANSACTION
    )
    return deeds.withColumns(
        {
            "SaleRecordingYear": F.coalesce("SaleYear", "RecordingYear").cast("short"),
            "SaleFlag": F.when(sale, 1).otherwise(0),
        }
    )


def rank_sales(deeds: DataFrame, min_year: int = MIN_YEAR) -> DataFrame:
    """The newest deed per property and recording year, if it is a qualifying sale.

    Ranks run over all deeds, so a newer non-qualifying deed hides an older sale. Ties on the
    recording date go to the smaller transaction id.
    """
    recent = deeds.where((F.col("RecordingYear") >= min_year) | (F.col("SaleYear") >= min_year))
    newest = newest_per_period(
        flag_sales(recent), "PropertyID", "RecordingYear", "RecordingDate", "FATransactionID"
    )
    return newest.where((F.col("SaleFlag") == 1) & (F.col("SaleRecordingYear") >= min_year))


def geocode(
    annual: DataFrame,
    block_groups: DataFrame,
    tracts_2020: DataFrame,
    tracts_2010: DataFrame,
    counties: DataFrame,
    layers: Sequence[Layer],
    geohash_precision: int = 18,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Crosswalk: coordinates with fallbacks, county attributes, polygon layers, geohash.

    Coordinates fall back from the parcel to its block group, its 2020 tract and its 2010 tract,
    longitude and latitude independently. A property inside overlapping polygons keeps one row per
    polygon.
    """
    parcels = annual.select(
        "PropertyID",
        "APN",
        "FIPS",
        "SitusLongitude",
        "SitusLatitude",
        clean.geography_code(
            F.col("FIPS"), F.col("SitusCensusTract"), F.col("SitusCensusBlock"), length=12
        ).alias("_block_group"),
        clean.geography_code(F.col("FIPS"), F.col("SitusCensusTract"), length=11).alias("_tract"),
    )
    placed = fallback_lookup(
        parcels,
        [
            Level(block_groups, "_block_group", "block_group_fips", {"SitusLongitude": "lon", "SitusLatitude": "lat"}),
            Level(tracts_2020, "_tract", "tract_fips", {"SitusLongitude": "lon", "SitusLatitude": "lat"}),
            Level(tracts_2010, "_tract", "tract_fips_2010", {"SitusLongitude": "lon_10", "SitusLatitude": "lat_10"}),
        ],
        join=lambda *side: skew_safe_lookup(*side, hot_rows),
    ).drop("_block_group", "_tract")
    side = counties.select(*COUNTY_COLUMNS).withColumn("_county", F.col("county_fips"))
    placed = equi_join(placed, side, {"FIPS": "_county"}, "left")
    # Parcels without coordinates are dropped before the spatial join, where they would share one key.
    # Their geohash is taken before it too, once per parcel and not once per polygon around it.
    valid = located_only(placed, "SitusLongitude", "SitusLatitude")
    hashed = with_geohash(valid, "SitusLatitude", "SitusLongitude", "geohash", geohash_precision)
    labelled = layered_join(
        staged.cut_lineage(hashed, "located"), layers, "PropertyID", "SitusLongitude", "SitusLatitude", hot_rows
    )
    return labelled.select(*[c for c in labelled.columns if c != "geohash"], "geohash")


def stage_sales(
    ranked: DataFrame,
    annual: DataFrame,
    crosswalk: DataFrame,
    hpi: DataFrame,
    min_year: int = MIN_YEAR,
) -> DataFrame:
    """Qualifying sales with their tax year's roll row, their place, and three price indices.

    The index of the sale year must exist; those of the assessment and market years may be missing
    (also when those years lie before ``min_year``).
    """
    sales = ranked.where(
        F.col("PropertyID").isNotNull()
        & (F.col("SaleRecordingYear") >= min_year)
        & (F.col("SaleFlag") == 1)
        & (F.col("RecentSaleByYear") == 1)
        & (F.col("SaleAmt") > 0)
    ).select(
        "PropertyID",
        "SaleRecordingYear",
        "SaleAmt",
        "FATransactionID",
        "RecentSaleByYear",
        "MostRecentSale",
    )
    taxed = annual.where(
        F.col("PropertyID").isNotNull()
        & (F.col("PropertyClassID") == ROLL_CLASS)
        & (F.col("TaxAmt") > 0)
    ).select(
        "PropertyID",
        "APN",
        "PropertyClassID",
        "FIPS",
        "TaxYear",
        "TaxAmt",
        "CurrentSaleRecordingYear",
        "CurrentSalesPrice",
        "AssdYear",
        "AssdTotalValue",
        "MarketYear",
        "MarketTotalValue",
    )
    places = crosswalk.drop("APN", "FIPS", "geometry").withColumnsRenamed(
        {
            "SitusLongitude": "SitusLongitude_imputed",
            "SitusLatitude": "SitusLatitude_imputed",
        }
    )
    index = hpi.withColumn("year", F.col("year").cast("short")).where(F.col("year") >= min_year)
    joined = equi_join(
        sales, taxed, {"PropertyID": "PropertyID", "SaleRecordingYear": "TaxYear"}, "inner"
    )
    joined = equi_join(joined, places, ["PropertyID"], "inner")
    return role_lookup(
        joined,
        index,
        "FIPS",
        "county_fips",
        "year",
        "hpi_index_2021",
        {
            "hpi_index_2021_sale": ("SaleRecordingYear", "inner"),
            "hpi_index_2021_assd": ("AssdYear", "left"),
            "hpi_index_2021_market": ("MarketYear", "left"),
        },
    )


def add_rates(staging: DataFrame) -> DataFrame:
    """Effective rates, index-adjusted money, imputed assessed value and assessment ratios.

    A zero denominator gives null, so means skip it.
    """
    c = F.col
    adjusted = deflate(
        staging.withColumn("TaxRate", F.try_divide("TaxAmt", "SaleAmt")),
        {
            "SaleAmt_HPI2021": ("SaleAmt", "hpi_index_2021_sale"),
            "TaxAmt_HPI2021": ("TaxAmt", "hpi_index_2021_sale"),
            "AssdTotalValue_HPI2021": ("AssdTotalValue", "hpi_index_2021_assd"),
            "MarketTotalValue_HPI2021": ("MarketTotalValue", "hpi_index_2021_market"),
        },
    )
    imputed = adjusted.withColumn(
        "AssdTotalValue_HPI2021_Imputed",
        clean.substitute(
            c("AssdTotalValue"),
            c("MarketTotalValue"),
            c("AssdTotalValue_HPI2021"),
            c("MarketTotalValue_HPI2021"),
        ),
    )
    ratio = F.try_divide("AssdTotalValue_HPI2021_Imputed", "SaleAmt_HPI2021")
    return imputed.withColumns(
        {
            "TaxRate_HPI2021": F.try_divide("TaxAmt_HPI2021", "SaleAmt_HPI2021"),
            "AssdValue_SaleAmt_Ratio": ratio,
            "TaxAmt_to_AssdValue_SaleAmt_Ratio": F.try_divide(c("TaxAmt_HPI2021"), ratio),
        }
    )


def add_bins(rated: DataFrame, split_year: int = MIN_YEAR) -> DataFrame:
    """Price bands, period band, the constant total bin and the tail labels."""
    price = F.col("SaleAmt_HPI2021")
    return rated.withColumns(
        {
            "SaleRecordingYear_Bins": bins.period_band(F.col("SaleRecordingYear"), split_year),
            "SaleBinsWide": bins.price_band(price, bins.WIDE),
            "SaleBinsNarrow": bins.price_band(price, bins.NARROW),
            "SaleBins": bins.price_band(price, bins.ELEVEN),
            "Total": F.lit("Total"),
            "Sale_Outliers": bins.tail_band(F.col("SaleAmt_County_Percentile")),
            "TaxRate_Outliers": bins.tail_band(F.col("TaxRate_County_Percentile")),
        }
    )


def tile_sales(
    staging: DataFrame,
    within: Sequence[str] = ("SaleRecordingYear", "FIPS"),
    split_year: int = MIN_YEAR,
    tiebreak: str | Sequence[str] = "FATransactionID",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Rates, county-year percentiles of price and rate, and all labels.

    Where overlapping polygons repeat a sale, add their keys to ``tiebreak``.
    """
    rated = add_rates(staging)
    percentiles = {"SaleAmt_County_Percentile": "SaleAmt", "TaxRate_County_Percentile": "TaxRate"}
    ranked = percentile_ranks(rated, percentiles, within, tiebreak, hot_rows)
    return add_bins(ranked, split_year)


@dataclass(frozen=True)
class Inputs:
    """Where the raw files and dimension tables are, and where stages and results go."""

    annual: str
    deeds: str
    work: str
    block_groups: DataFrame
    tracts_2020: DataFrame
    tracts_2010: DataFrame
    counties: DataFrame
    hpi: DataFrame
    layers: Sequence[Layer]
    history: str | None = None
    geo: Sequence[str] = CITY_COLUMNS
    modes: Sequence[Mode] = field(default_factory=lambda: (SNAPSHOT, POOLED))
    min_year: int = MIN_YEAR
    hot_rows: int | None = HOT_ROWS


#: Part of every fingerprint: raise it when a stage would come out differently from the same inputs.
VERSION = 1


def counted(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """The counts of a stage and of its raw rows, as ``reconcile`` gives them, without reading either again."""
    raw, kept = manifest.expected, manifest.rows
    schema = "raw_rows long, staged_rows long, missing_rows long, matches boolean"
    return spark.createDataFrame([(raw, kept, raw - kept, raw == kept)], schema)


def refresh_crosswalk(spark: SparkSession, annual: DataFrame, inputs: Inputs, folder: str) -> Grown:
    """The crosswalk with all parcels of the roll: only those it has never seen are geocoded.

    Other reference tables or polygon layers start it anew.
    """
    tables = [inputs.block_groups, inputs.tracts_2020, inputs.tracts_2010, inputs.counties, *[x.polygons for x in inputs.layers]]
    layers = [(x.name, x.cell, x.columns) for x in inputs.layers]
    with_these = fingerprint(spark, params={"layers": layers, "version": VERSION}, tables=tables)

    def derive(parcels: DataFrame) -> DataFrame:
        return geocode(
            parcels,
            inputs.block_groups,
            inputs.tracts_2020,
            inputs.tracts_2010,
            inputs.counties,
            inputs.layers,
            hot_rows=inputs.hot_rows,
        )

    return grow(spark, folder, annual, "PropertyID", derive, with_these)


def run(spark: SparkSession, inputs: Inputs) -> dict[str, DataFrame]:
    """Run all stages, reusing those that still hold, and return the staged tables and checks by name.

    A stage is built anew if its raw file, a parameter, a reference table or a stage before it has
    changed, or if some of its files are gone; see :mod:`millgauge.sources.manifest`. ``stages`` tells for
    each stage how many rows it has and why it was built in this run (null if it was reused).
    """

    def at(name: str) -> str:
        return f"{inputs.work.rstrip('/')}/{name}"

    checks: dict[str, DataFrame] = {}
    built: dict[str, Built] = {}

    def keep(name: str, build, before=(), params=None, tables=(), **given) -> DataFrame:
        known = {"version": VERSION, **(params or {})}
        wanted = fingerprint(spark, params=known, tables=tables, before=before)
        built[name] = kept_stage(spark, at(name), build, wanted, **given)
        return built[name].rows

    def take(name: str, path: str, schema, qualifying, cleaned) -> DataFrame:
        """Stage a raw file; without the raw file, reuse its stage if that is whole."""
        if not staged.path_exists(spark, path):
            found = whole_stage(spark, at(name))
            if found is None:
                raise FileNotFoundError(f"neither a whole {at(name)} nor {path} exists")
            built[name] = found
            return found.rows
        raw = read_delimited(spark, path, schema)
        wanted = fingerprint(spark, [path], {"version": VERSION, "schema": schema.json()})
        built[name] = kept_stage(spark, at(name), lambda: cleaned(raw), wanted, lambda: qualifying(raw).count())
        checks[f"{name}_count"] = counted(spark, built[name].manifest)
        return built[name].rows

    annual = take("annual", inputs.annual, schemas.ANNUAL, qualifying_roll, clean_annual)
    deeds = take("deeds", inputs.deeds, schemas.DEEDS, qualifying_deeds, clean_deeds)
    ranked = keep(
        "ranked_sales",
        lambda: rank_sales(deeds, inputs.min_year),
        [built["deeds"].token],
        {"min_year": inputs.min_year},
    )
    places = refresh_crosswalk(spark, annual, inputs, at("crosswalk"))
    crosswalk = places.rows
    staging = keep(
        "sales_staging",
        lambda: stage_sales(ranked, annual, crosswalk, inputs.hpi, inputs.min_year),
        [built["annual"].token, built["ranked_sales"].token, places.token],
        {"min_year": inputs.min_year},
        [inputs.hpi],
    )
    keys = [layer.key for layer in inputs.layers]
    tiles = keep(
        "sales_staging_tiles",
        lambda: tile_sales(
            staging,
            split_year=inputs.min_year,
            tiebreak=["FATransactionID", *keys],
            hot_rows=inputs.hot_rows,
        ),
        [built["sales_staging"].token],
        {"min_year": inputs.min_year, "tiebreak": keys},
    )
    summary = keep(
        "summary",
        lambda: summary_cube(tiles, inputs.geo, modes=inputs.modes, hot_rows=inputs.hot_rows),
        [built["sales_staging_tiles"].token],
        {"geo": list(inputs.geo), "modes": list(inputs.modes)},
        partition_by=export.CUBE_KEYS,
    )
    out = {
        "annual": annual,
        "deeds": deeds,
        "ranked_sales": ranked,
        "crosswalk": crosswalk,
        "sales_staging": staging,
        "sales_staging_tiles": tiles,
        "summary": summary,
        "crosswalk_missing": coverage_report(annual, crosswalk, "PropertyID"),
        "crosswalk_duplicates": duplicates(crosswalk, "PropertyID"),
    }
    if inputs.history:
        out["history"] = take(
            "history", inputs.history, schemas.HISTORY, qualifying_history, clean_history
        )
    told = [(name, b.manifest.rows, b.reason) for name, b in built.items()]
    told.append(("crosswalk", crosswalk.count(), "grown" if places.new_keys else None))
    out["stages"] = spark.createDataFrame(told, "stage string, rows long, reason string")
    return out | checks
