"""The pipeline end to end on the stand-in tables: sales, tiles, summaries, city analysis, reports."""

from pyspark.sql import functions as F

from millgauge.operators.joins import equi_join
from millgauge.operators.ranks import percentile_rank
from millgauge.functions.bins import tail_band
from millgauge.operators.summary import (
    MEASURES,
    POOLED,
    SNAPSHOT,
    one_table,
    summarise,
    summary,
    summary_cube,
)
from millgauge.plans import analysis, etl, report, variants
from millgauge.sources.staged import cut_lineage
from verification.registry import case, steady, steady_sql
from verification.standins import (
    CITIES,
    DEEDS,
    GEO,
    INDEX,
    MIN_YEAR,
    PLACES,
    QUARTERLY,
    RANKED,
    RATES,
    ROLL,
    TO_STAGING,
    TO_TILES,
    deeds,
    index,
    places,
    rates,
    roll,
    staged,
    staging,
    tiles,
)

DIGITS = {"sum": 3, "mean": 5, "median": 5, "std": 5}
FAMILIES = ("Total", "SaleBins", "SaleBinsWide", "SaleBinsNarrow")
QUANTILE_FAMILIES = {"SaleAmt_Decile": 10, "SaleAmt_Quintile": 5}
SQL_STAT = {"sum": "sum", "mean": "avg", "median": "median", "std": "stddev_samp"}
RATES_LIKE = ("TaxRate", "AssdValue_SaleAmt_Ratio")


def digits(measure: str, stat: str) -> int:
    return 9 if measure in RATES_LIKE else DIGITS[stat]


def stat_columns(measures=MEASURES):
    return [(f"{m}_{s}", m, s) for m, stats in measures.items() for s in stats]


def round_stats(df):
    return df.withColumns(
        {
            **{n: steady(n, digits(m, s)) for n, m, s in stat_columns() if n in df.columns},
            **{c: F.round(c, 9) for c in RATES_LIKE if c in df.columns},
            **{c: F.round(c, 3) for c in ("SaleAmt_Total", "SaleAmt_GeoTotal") if c in df.columns},
        }
    )


def quoted(name: str) -> str:
    return f'"{name}"'


def measure_list(mode, quantile: bool) -> str:
    """The 25 measures of one summary table in SQL."""
    adjust = "_HPI2021" if mode.name == "Pooled" else ""
    source = {
        "TaxAmt": f'"TaxAmt{adjust}"',
        "TaxRate": '"TaxRate"' if quantile else f'"TaxRate{adjust}"',
        "SaleAmt": f'"SaleAmt{adjust}"',
    }
    columns = [
        'count(*) AS "count"',
        'count(DISTINCT "PropertyID") AS "PropertyID_nunique"',
        f'count({source["TaxAmt"]}) AS "TaxAmt_notnull"',
        f'count({source["SaleAmt"]}) AS "SaleAmt_notnull"',
    ]
    for name, m, s in stat_columns():
        column = source.get(m, f'"{m}"')
        columns.append(f'{SQL_STAT[s]}({column}) AS "{name}"')
    return ",\n      ".join(columns)


def cube_part(mode, family: str, groups: int | None, geo=GEO) -> str:
    adjust = "_HPI2021" if mode.name == "Pooled" else ""
    rows = f"""SELECT * FROM tiles WHERE "TaxRate_Outliers" = 'Middle 96%' AND "{mode.recency}" = 1"""
    bin_sql = f'"{family}"'
    if groups:
        rows = f"""SELECT *, CAST(ceil(ceil(CAST(row_number() OVER (PARTITION BY "{mode.period}", city_geoid
          ORDER BY "SaleAmt{adjust}" DESC, "PropertyID") AS DOUBLE)
          / count(*) OVER (PARTITION BY "{mode.period}", city_geoid) * 100) / {100 // groups}) AS INTEGER) AS quantile_bin
          FROM ({rows})"""
        bin_sql = "CAST(quantile_bin AS VARCHAR)"
    return f"""SELECT '{mode.name}' AS "mode", '{family}' AS bin_family, {", ".join(geo)}, {bin_sql} AS bin,
      CAST("{mode.period}" AS VARCHAR) AS period, {measure_list(mode, bool(groups))}
    FROM ({rows}) GROUP BY {", ".join(geo)}, {bin_sql}, "{mode.period}" """


def finish(parts: str) -> str:
    """Ratios, totals and rounding of a cube in SQL."""
    keep = ['"mode"', "bin_family", *GEO, "bin", "period", '"count"', '"PropertyID_nunique"', '"TaxAmt_notnull"', '"SaleAmt_notnull"']
    stats = [f'{steady_sql(quoted(n), digits(m, s))} AS "{n}"' for n, m, s in stat_columns()]
    extra = [
        'round("TaxAmt_sum" / nullif("SaleAmt_sum", 0), 9) AS "TaxRate"',
        'round("AssdTotalValue_HPI2021_Imputed_sum" / nullif("SaleAmt_sum", 0), 9) AS "AssdValue_SaleAmt_Ratio"',
        'round(sum("SaleAmt_sum") OVER (PARTITION BY "mode", bin_family), 3) AS "SaleAmt_Total"',
        'CAST(sum("count") OVER (PARTITION BY "mode", bin_family) AS BIGINT) AS "count_Total"',
        'round(sum("SaleAmt_sum") OVER (PARTITION BY "mode", bin_family, city_geoid), 3) AS "SaleAmt_GeoTotal"',
        'CAST(sum("count") OVER (PARTITION BY "mode", bin_family, city_geoid) AS BIGINT) AS "count_GeoTotal"',
    ]
    return f"SELECT {', '.join([*keep, *stats, *extra])} FROM ({parts})"


CITY_STATS = ", ".join(
    f'{steady_sql(f"{SQL_STAT[s]}({quoted(m)})", digits(m, s))} AS "{m}_{s}"'
    for m in ("TaxAmt", "TaxRate", "SaleAmt")
    for s in MEASURES[m]
)


@case(
    "city_year_summary",
    f"""WITH {DEEDS}, {RANKED}, {ROLL}, {CITIES}, {PLACES}, joined AS (
      SELECT r."PropertyID", r."SaleRecordingYear", city_geoid, city_name, t."FIPS", r."SaleAmt", t."TaxAmt",
        t."TaxAmt" / r."SaleAmt" AS "TaxRate", r."FATransactionID"
      FROM ranked r JOIN roll t ON t."PropertyID" = r."PropertyID" AND t."TaxYear" = r."SaleRecordingYear"
      JOIN places p ON p."PropertyID" = r."PropertyID" WHERE t."TaxAmt" > 0),
    pct AS (SELECT *, ceil(CAST(row_number() OVER (PARTITION BY "SaleRecordingYear", "FIPS" ORDER BY "TaxRate" DESC, "FATransactionID") AS DOUBLE)
      / count(*) OVER (PARTITION BY "SaleRecordingYear", "FIPS") * 100) AS pct FROM joined)
    SELECT city_geoid, city_name, CAST("SaleRecordingYear" AS INTEGER) AS sale_year, count(*) AS "count",
      count(DISTINCT "PropertyID") AS "PropertyID_nunique", count("TaxAmt") AS "TaxAmt_notnull", count("SaleAmt") AS "SaleAmt_notnull",
      {CITY_STATS},
      round(sum("TaxAmt") / sum("SaleAmt"), 9) AS effective_rate
    FROM pct WHERE NOT (pct <= 2 OR pct >= 99) GROUP BY 1, 2, 3""",
)
def city_year_summary(spark, d):
    """Flagship: latest qualifying sales, their tax rates, trimmed, summarised per city and year.

    The joined sales are staged, so the steps after them read a narrow table instead of repeating
    the joins.
    """

    def joined():
        sales = etl.rank_sales(deeds(spark, d), MIN_YEAR)
        taxed = roll(spark, d).where(F.col("TaxAmt") > 0)
        out = equi_join(
            sales,
            taxed.select("PropertyID", "FIPS", "TaxYear", "TaxAmt"),
            {"PropertyID": "PropertyID", "SaleRecordingYear": "TaxYear"},
        )
        return equi_join(out, places(spark, d), ["PropertyID"]).select(
            "PropertyID",
            "FATransactionID",
            F.col("SaleRecordingYear").cast("int").alias("sale_year"),
            "city_geoid",
            "city_name",
            "FIPS",
            "SaleAmt",
            "TaxAmt",
            F.try_divide("TaxAmt", "SaleAmt").alias("TaxRate"),
        )

    rated = staged(spark, d, "taxed_sales", joined)
    ranked = percentile_rank(rated, "TaxRate", ["sale_year", "FIPS"], "FATransactionID", "pct")
    trimmed = ranked.where(tail_band(F.col("pct")) == "Middle 96%")
    measures = {m: MEASURES[m] for m in ("TaxAmt", "TaxRate", "SaleAmt")}
    table = summarise(trimmed, ["city_geoid", "city_name", "sale_year"], measures=measures)
    return round_stats(table).withColumn(
        "effective_rate", F.round(F.try_divide("TaxAmt_sum", "SaleAmt_sum"), 9)
    )


TILE_ROUND = {
    "TaxRate": 9,
    "SaleAmt_HPI2021": 4,
    "TaxAmt_HPI2021": 4,
    "AssdTotalValue_HPI2021_Imputed": 4,
    "TaxRate_HPI2021": 9,
    "AssdValue_SaleAmt_Ratio": 8,
    "TaxAmt_to_AssdValue_SaleAmt_Ratio": 4,
}
TILE_LABELS = (
    "SaleAmt_County_Percentile",
    "TaxRate_County_Percentile",
    "SaleRecordingYear_Bins",
    "SaleBinsWide",
    "SaleBinsNarrow",
    "SaleBins",
    "Total",
    "Sale_Outliers",
    "TaxRate_Outliers",
)


@case(
    "staged_sales",
    f"""WITH {TO_STAGING}
    SELECT "PropertyID", CAST("SaleRecordingYear" AS INTEGER) AS "SaleRecordingYear", "FATransactionID", "SaleAmt", "TaxAmt",
      "MostRecentSale", city_geoid, round(sale_index, 7) AS sale_index,
      round(assd_index, 7) AS assd_index, round(market_index, 7) AS market_index FROM staging""",
)
def staged_sales(spark, d):
    return staging(spark, d).select(
        "PropertyID",
        F.col("SaleRecordingYear").cast("int").alias("SaleRecordingYear"),
        "FATransactionID",
        "SaleAmt",
        "TaxAmt",
        "MostRecentSale",
        "city_geoid",
        *[
            F.round(f"hpi_index_2021_{role}", 7).alias(f"{role}_index")
            for role in ("sale", "assd", "market")
        ],
    )


@case(
    "tiles",
    f"""WITH {TO_TILES}
    SELECT "PropertyID", "FATransactionID", {", ".join(f'round("{c}", {n}) AS "{c}"' for c, n in TILE_ROUND.items())},
      {", ".join(f'"{c}"' for c in TILE_LABELS)} FROM tiles""",
)
def sale_tiles(spark, d):
    """Built afresh here; the queries below read the staged table."""
    return etl.tile_sales(staging(spark, d), split_year=1999).select(
        "PropertyID",
        "FATransactionID",
        *[F.round(c, n).alias(c) for c, n in TILE_ROUND.items()],
        *TILE_LABELS,
    )


@case(
    "summary_cube",
    f"WITH {TO_TILES} "
    + finish(
        " UNION ALL ".join(
            cube_part(mode, family, groups)
            for mode in (SNAPSHOT, POOLED)
            for family, groups in [*[(f, None) for f in FAMILIES], *QUANTILE_FAMILIES.items()]
        )
    ),
)
def cube(spark, d):
    """All twelve summary tables from one pass over the tiles."""
    return round_stats(summary_cube(tiles(spark, d), GEO))


@case(
    "summary_cube_heavy",
    f"WITH {TO_TILES} "
    + finish(
        " UNION ALL ".join(
            cube_part(mode, family, groups)
            for mode in (SNAPSHOT, POOLED)
            for family, groups in [("Total", None), ("SaleAmt_Quintile", 5)]
        )
    ),
)
def cube_heavy(spark, d):
    """Two families of the cube with groups above 30 rows on the heavy-group path."""
    return round_stats(
        summary_cube(
            tiles(spark, d), GEO, ["Total"], {"SaleAmt_Quintile": 5}, hot_rows=30
        )
    )


@case(
    "summary_single",
    f"""WITH {TO_TILES}, t AS ({finish(cube_part(SNAPSHOT, "SaleBinsNarrow", None))})
    SELECT city_geoid, bin AS "SaleBinsNarrow", CAST(period AS INTEGER) AS "SaleRecordingYear", "count", "TaxRate",
      "TaxRate_median", "count_Total" FROM t""",
)
def summary_single(spark, d):
    one = round_stats(summary(tiles(spark, d), GEO, "SaleBinsNarrow", SNAPSHOT))
    return one.select(
        "city_geoid",
        "SaleBinsNarrow",
        "SaleRecordingYear",
        "count",
        "TaxRate",
        "TaxRate_median",
        "count_Total",
    )


@case(
    "sale_year_counts",
    f"""WITH {DEEDS}, {RANKED} SELECT "PropertyID", count(*) AS "SaleYearCount" FROM ranked GROUP BY 1""",
)
def sale_year_counts(spark, d):
    return variants.sale_year_counts(etl.rank_sales(deeds(spark, d), MIN_YEAR), MIN_YEAR)


@case(
    "value_series",
    f"""WITH {ROLL} SELECT "PropertyID", "TaxYear", "MarketTotalValue" AS market_value FROM roll
    WHERE "MarketTotalValue" > 0 AND "TaxYear" >= 1998""",
)
def value_series(spark, d):
    named = {"MarketTotalValue": "market_value"}
    return variants.value_series(roll(spark, d), "TaxYear", named, "MarketTotalValue", 1998)


@case(
    "sales_with_series",
    f"""WITH {DEEDS}, {RANKED}, {ROLL}, {CITIES}, {PLACES}, {QUARTERLY}, {INDEX},
    newest AS (SELECT * FROM roll WHERE "TaxYear" = 2000 AND "TaxAmt" > 0)
    SELECT r."PropertyID", r."FATransactionID", r."SaleAmt", n."TaxAmt" AS "TaxAmt_Current", s."TaxAmt" AS tax_of_sale_year,
      city_geoid, round(h.hpi_index_2021, 7) AS hpi_index_2021
    FROM ranked r JOIN newest n ON n."PropertyID" = r."PropertyID"
    LEFT JOIN roll s ON s."PropertyID" = r."PropertyID" AND s."TaxYear" = r."SaleRecordingYear" AND s."TaxAmt" > 0
    LEFT JOIN places p ON p."PropertyID" = r."PropertyID"
    LEFT JOIN hpi h ON h.county_fips = n."FIPS" AND h."year" = r."SaleRecordingYear" """,
)
def sales_with_series(spark, d):
    rows = roll(spark, d)
    series = variants.value_series(rows, "TaxYear", {"TaxAmt": "tax_of_sale_year"}, "TaxAmt")
    out = variants.sales_with_series(
        etl.rank_sales(deeds(spark, d), MIN_YEAR),
        rows.where(F.col("TaxYear") == 2000),
        series,
        places(spark, d),
        index(spark, d),
    )
    return out.select(
        "PropertyID",
        "FATransactionID",
        "SaleAmt",
        "TaxAmt_Current",
        "tax_of_sale_year",
        "city_geoid",
        F.round("hpi_index_2021", 7).alias("hpi_index_2021"),
    )


@case(
    "county_quantiles",
    f"""WITH {TO_TILES} SELECT "FATransactionID", CAST(ceil("SaleAmt_County_Percentile" / 10.0) AS INTEGER) AS "SaleAmt_County_Decile",
      CAST(ceil("TaxRate_County_Percentile" / 20.0) AS INTEGER) AS "TaxRate_County_Quintile" FROM tiles""",
)
def county_quantiles(spark, d):
    out = variants.county_quantiles(tiles(spark, d))
    return out.select("FATransactionID", "SaleAmt_County_Decile", "TaxRate_County_Quintile")


# --- city analysis -------------------------------------------------------------------------------

BUSY = f"""{TO_TILES}, {RATES}, busy AS (
  SELECT city_geoid AS g, "SaleRecordingYear" AS y FROM (
    SELECT city_geoid, "SaleRecordingYear", count(*) AS n,
      dense_rank() OVER (PARTITION BY city_geoid ORDER BY count(*) DESC) AS r FROM tiles GROUP BY 1, 2)
  WHERE r = 1 AND n > 1),
micro AS (SELECT t.*, city_name || ', ' || city_state_code AS city_state, CAST(city_geoid AS INTEGER) AS city_int
  FROM tiles t JOIN busy ON g = city_geoid AND y = "SaleRecordingYear"
  WHERE "TaxRate" > 0 AND "TaxRate" <= 0.5 AND "TaxRate_Outliers" = 'Middle 96%' AND "RecentSaleByYear" = 1
    AND CAST(city_geoid AS INTEGER) IN (SELECT place_id FROM rates))"""


def micro(spark, d):
    return analysis.busiest_year_sales(tiles(spark, d), rates(spark, d))


@case(
    "city_spread",
    f"""WITH {BUSY}, spread AS (SELECT city_state, quantile_cont("TaxRate", 0.75) - quantile_cont("TaxRate", 0.25) AS iqr FROM micro GROUP BY 1),
    placed AS (SELECT *, dense_rank() OVER (ORDER BY iqr) AS r FROM spread)
    SELECT "PropertyID", city_state, round(iqr, 9) AS "IQR_city", r AS "IQR_rank",
      CASE WHEN r <= 5 THEN 1 WHEN r <= 10 THEN 2 WHEN r <= 15 THEN 3 ELSE 4 END AS "IQR_quartile",
      CAST(ntile(5) OVER (PARTITION BY city_state ORDER BY "SaleAmt", "PropertyID") AS INTEGER) AS sale_quintile
    FROM micro JOIN placed USING (city_state)""",
)
def city_spread(spark, d):
    out = analysis.with_city_spread(micro(spark, d), (5, 10, 15))
    return out.select(
        "PropertyID",
        "city_state",
        F.round("IQR_city", 9).alias("IQR_city"),
        "IQR_rank",
        "IQR_quartile",
        "sale_quintile",
    )


@case(
    "city_distribution",
    f"""WITH {BUSY}
    SELECT city_geoid, city_name, city_state, round(median("TaxRate"), 9) AS tax_rate_median, round(avg("TaxRate"), 9) AS tax_rate_mean,
      round(stddev_samp("TaxRate"), 9) AS tax_rate_sd, {", ".join(f'round(quantile_cont("TaxRate", {p / 100}), 9) AS tax_rate_{p}pct' for p in (10, 25, 50, 75, 90))},
      round(quantile_cont("TaxRate", 0.75) - quantile_cont("TaxRate", 0.25), 9) AS iqr_diff75_25,
      round(stddev_samp("TaxRate") / avg("TaxRate"), 9) AS coeff_of_var FROM micro GROUP BY 1, 2, 3""",
)
def city_distribution(spark, d):
    out = analysis.distribution_table(micro(spark, d))
    keys = ("city_geoid", "city_name", "city_state")
    return out.select(*keys, *[F.round(c, 9).alias(c) for c in out.columns if c not in keys])


@case(
    "city_boxplot",
    f"""WITH {BUSY}, shown AS (SELECT * FROM micro WHERE "TaxRate" BETWEEN 0 AND 0.08),
    boxes AS (SELECT city_state, quantile_cont("TaxRate", 0.25) AS q1, median("TaxRate") AS m, quantile_cont("TaxRate", 0.75) AS q3 FROM shown GROUP BY 1),
    spread AS (SELECT city_state, quantile_cont("TaxRate", 0.75) - quantile_cont("TaxRate", 0.25) AS iqr FROM micro GROUP BY 1)
    SELECT city_state, round(q1, 9) AS q1, round(m, 9) AS median, round(q3, 9) AS q3, round(min("TaxRate"), 9) AS whisker_low,
      round(max("TaxRate"), 9) AS whisker_high, round(iqr, 9) AS order_iqr
    FROM shown JOIN boxes USING (city_state) JOIN spread USING (city_state)
    WHERE "TaxRate" >= q1 - 1.5 * (q3 - q1) AND "TaxRate" <= q3 + 1.5 * (q3 - q1) GROUP BY city_state, q1, m, q3, iqr""",
)
def city_boxplot(spark, d):
    out = analysis.boxplot_table(micro(spark, d))
    return out.select("city_state", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


@case(
    "statutory_effective_table",
    f"""WITH {BUSY}, totals AS ({cube_part(SNAPSHOT, "Total", None)}),
    best AS (SELECT * FROM (SELECT city_geoid, "TaxRate_median", row_number() OVER (PARTITION BY city_geoid ORDER BY "count" DESC, period) AS r
      FROM totals WHERE CAST(city_geoid AS INTEGER) IN (SELECT place_id FROM rates)) WHERE r = 1),
    one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY table_order) AS r FROM rates) WHERE r = 1),
    overall AS (SELECT city_geoid, city_name, city_state_code, "SaleRecordingYear", city_state, city_int, median("TaxRate") AS m FROM micro GROUP BY ALL),
    bands AS (SELECT city_geoid, median("TaxRate") FILTER ("SaleBinsNarrow" = '2 - $120K-$180K') AS low,
      median("TaxRate") FILTER ("SaleBinsNarrow" = '4 - $270K-$330K') AS high FROM micro GROUP BY 1)
    SELECT o.city_geoid, o.city_name, o.city_state, CAST(o."SaleRecordingYear" AS INTEGER) AS sale_year, round(m, 9) AS "TaxRate_median",
      round(low, 9) AS low_band_median, round(high, 9) AS high_band_median, round(best."TaxRate_median", 9) AS "TaxRate_median_summary",
      round(tax_rate_median_value, 9) AS statutory_tax_rate_median, round(tax_rate_150k, 9) AS statutory_tax_rate_150k
    FROM overall o LEFT JOIN bands USING (city_geoid) LEFT JOIN best USING (city_geoid) LEFT JOIN one ON place_id = city_int""",
)
def statutory_effective_table(spark, d):
    sold, bench = tiles(spark, d), rates(spark, d)
    sales = analysis.busiest_year_sales(sold, bench)
    totals = analysis.totals_table(summary(sold, GEO, "Total"), bench)
    out = analysis.statutory_effective_table(sales, bench, totals)
    return out.select(
        "city_geoid",
        "city_name",
        "city_state",
        F.col("SaleRecordingYear").cast("int").alias("sale_year"),
        F.round("TaxRate_median", 9).alias("TaxRate_median"),
        F.round("`TaxRate_median_2 - $120K-$180K`", 9).alias("low_band_median"),
        F.round("`TaxRate_median_4 - $270K-$330K`", 9).alias("high_band_median"),
        F.round("TaxRate_median_summary", 9).alias("TaxRate_median_summary"),
        F.round("statutory_tax_rate_median", 9).alias("statutory_tax_rate_median"),
        F.round("statutory_tax_rate_150k", 9).alias("statutory_tax_rate_150k"),
    )


Z90 = "1.6448536269514722"


@case(
    "totals_table",
    f"""WITH {TO_TILES}, {RATES}, totals AS ({cube_part(SNAPSHOT, "Total", None)}),
    best AS (SELECT *, "TaxAmt_sum" / "SaleAmt_sum" AS rate, row_number() OVER (PARTITION BY city_geoid ORDER BY "count" DESC, period) AS r
      FROM totals WHERE CAST(city_geoid AS INTEGER) IN (SELECT place_id FROM rates)),
    ref AS (SELECT DISTINCT place_id, tax_rate_median_value FROM rates)
    SELECT city_geoid, CAST(period AS INTEGER) AS sale_year, "count", round(tax_rate_median_value, 9) AS "TaxRate_median_statutory",
      round("TaxRate_mean", 9) AS "TaxRate_mean", round({Z90} * "TaxRate_std" / sqrt("count"), 9) AS "TaxRate_moe",
      round("TaxRate_mean" + {Z90} * "TaxRate_std" / sqrt("count"), 9) AS "TaxRate_upper", round("TaxRate_std" / rate, 7) AS variation
    FROM best LEFT JOIN ref ON place_id = CAST(city_geoid AS INTEGER) WHERE r = 1""",
)
def totals_table(spark, d):
    out = analysis.totals_table(summary(tiles(spark, d), GEO, "Total"), rates(spark, d))
    return out.select(
        "city_geoid",
        F.col("SaleRecordingYear").alias("sale_year"),
        "count",
        F.round("TaxRate_median_statutory", 9).alias("TaxRate_median_statutory"),
        F.round("TaxRate_mean", 9).alias("TaxRate_mean"),
        F.round("TaxRate_moe", 9).alias("TaxRate_moe"),
        F.round("TaxRate_upper", 9).alias("TaxRate_upper"),
        F.round("TaxRate_coefficient_of_variation", 7).alias("variation"),
    )


QUINTILES = f"""{TO_TILES}, {RATES}, q AS ({cube_part(SNAPSHOT, "SaleAmt_Quintile", 5)}),
covered AS (SELECT *, "TaxAmt_sum" / "SaleAmt_sum" AS rate, sum("count") OVER (PARTITION BY city_geoid, period) AS year_total
  FROM q WHERE CAST(city_geoid AS INTEGER) IN (SELECT place_id FROM rates)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city_geoid, bin ORDER BY year_total DESC, period) AS r FROM covered) WHERE r = 1),
wide AS (SELECT city_geoid, period, {", ".join(f"max(CASE WHEN bin = '{b}' THEN {c} END) AS {n}_{b}" for b in (1, 5) for n, c in (("n", '"count"'), ("mean", '"TaxRate_mean"'), ("med", '"TaxRate_median"'), ("sd", '"TaxRate_std"'), ("rate", "rate")))}
  FROM best GROUP BY 1, 2)"""


def _quintiles(spark, d):
    cube_ = summary_cube(
        tiles(spark, d), GEO, [], {"SaleAmt_Quintile": 5}, [SNAPSHOT]
    )
    return one_table(cube_, GEO[0], "SaleAmt_Quintile", SNAPSHOT)


@case(
    "quintile_gaps",
    f"""WITH {QUINTILES}, t AS (SELECT *, sqrt(sd_5 * sd_5 / n_5 + sd_1 * sd_1 / n_1) AS se FROM wide)
    SELECT city_geoid, CAST(period AS INTEGER) AS sale_year, n_1 AS count_1, n_5 AS count_5,
      round((mean_5 - mean_1) / nullif(se, 0), 6) AS test_stat_mean,
      CASE WHEN (mean_5 - mean_1) / nullif(se, 0) > {Z90} THEN 1 WHEN (mean_5 - mean_1) / nullif(se, 0) <= {Z90} THEN 0 END AS gt_critval_mean,
      round((med_5 - med_1) / nullif(se, 0), 6) AS test_stat_med,
      round(med_5 - med_1, 9) AS gap_median, round(med_5 / nullif(rate_1, 0), 6) AS ratio, round(med_5 / nullif(med_1, 0), 6) AS ratio_fixed
    FROM t""",
)
def quintile_gaps(spark, d):
    rows = analysis.quintile_rows(_quintiles(spark, d), rates(spark, d))
    out = analysis.quintile_gaps(rows, GEO)
    return out.select(
        "city_geoid",
        F.col("SaleRecordingYear").alias("sale_year"),
        "count_1",
        "count_5",
        F.round("test_stat_mean", 6).alias("test_stat_mean"),
        "gt_critval_mean",
        F.round("test_stat_med", 6).alias("test_stat_med"),
        F.round("TaxRate_5_1_diff_med", 9).alias("gap_median"),
        F.round("ratio", 6).alias("ratio"),
        F.round("ratio_fixed", 6).alias("ratio_fixed"),
    )


@case(
    "quintile_chart",
    f"""WITH {QUINTILES}, ref AS (SELECT DISTINCT place_id, tax_rate_median_value FROM rates)
    SELECT b.city_geoid, b.bin AS quintile, round(b."TaxRate_median", 9) AS "TaxRate_median", round(w.med_5 - w.med_1, 9) AS gap_median,
      round(tax_rate_median_value, 9) AS statutory
    FROM best b LEFT JOIN wide w ON w.city_geoid = b.city_geoid LEFT JOIN ref ON place_id = CAST(b.city_geoid AS INTEGER)
    WHERE b.bin IN ('1', '5')""",
)
def quintile_chart(spark, d):
    bench = rates(spark, d)
    rows = analysis.quintile_rows(_quintiles(spark, d), bench)
    out = analysis.quintile_chart_rows(rows, analysis.quintile_gaps(rows, GEO), bench)
    return out.select(
        "city_geoid",
        F.col("SaleAmt_Quintile").alias("quintile"),
        F.round("TaxRate_median", 9).alias("TaxRate_median"),
        F.round("TaxRate_5_1_diff_med", 9).alias("gap_median"),
        F.round("tax_rate_median_value", 9).alias("statutory"),
    )


@case(
    "interval_table",
    f"""WITH {BUSY}, ordered AS (SELECT *, row_number() OVER (PARTITION BY city_geoid, "SaleRecordingYear" ORDER BY "TaxRate") AS r,
      count(*) OVER (PARTITION BY city_geoid, "SaleRecordingYear") AS n FROM micro),
    sizes AS (SELECT DISTINCT n FROM ordered),
    cdf AS (SELECT n, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2.0::DOUBLE))) OVER (PARTITION BY n ORDER BY k) AS p
      FROM sizes, LATERAL (SELECT unnest(generate_series(0, n)) AS k)),
    ks AS (SELECT n, min(k) AS k FROM cdf WHERE p >= 0.05 GROUP BY 1),
    ci AS (SELECT city_geoid, "SaleRecordingYear" AS y, city_int, median("TaxRate") AS est, max(CASE WHEN r = k THEN "TaxRate" END) AS lo,
      max(CASE WHEN k > 0 AND r = n - k + 1 THEN "TaxRate" END) AS hi FROM ordered JOIN ks USING (n) GROUP BY 1, 2, 3),
    ref AS (SELECT DISTINCT place_id, tax_rate_median_value AS s FROM rates)
    SELECT city_geoid, CAST(y AS INTEGER) AS sale_year, round(est, 9) AS est, round(lo, 9) AS lo, round(hi, 9) AS hi, round(est - s, 9) AS tax_rate_diff,
      CASE WHEN lo > s OR hi < s THEN 'Outside CI' ELSE 'Within CI' END AS outside_ci FROM ci LEFT JOIN ref ON place_id = city_int""",
)
def interval_table(spark, d):
    out = analysis.interval_table(micro(spark, d), rates(spark, d))
    return out.select(
        "city_geoid",
        F.col("SaleRecordingYear").cast("int").alias("sale_year"),
        F.round("TaxRate_median_est", 9).alias("est"),
        F.round("TaxRate_median_lo_ci", 9).alias("lo"),
        F.round("TaxRate_median_hi_ci", 9).alias("hi"),
        F.round("tax_rate_diff", 9).alias("tax_rate_diff"),
        "outside_ci",
    )


# --- wide reports --------------------------------------------------------------------------------

REPORT_GEO = ("city_geoid", "city_name", "city_state_code", "city_population2022")
REPORT_VALUES = ("count", "TaxRate_median", "SaleAmt_mean")


def report_sql(mode, family: str, groups, labels) -> str:
    listed = ", ".join(f"'{l}'" for l in labels)
    pivot = ", ".join(
        f"max(CASE WHEN bin = '{l}' THEN {v} END) AS \"{n}_{s}\""
        for l, s in labels.items()
        for n, v in (
            ("count", '"count"'),
            ("TaxRate_median", 'round("TaxRate_median", 9)'),
            ("SaleAmt_mean", steady_sql('"SaleAmt_mean"', 5)),
        )
    )
    period = ', CAST(period AS INTEGER) AS "SaleRecordingYear"' if mode is SNAPSHOT else ""
    group = ", period" if mode is SNAPSHOT else ""
    pick = "WHERE r = 1" if mode is SNAPSHOT else ""
    return f"""WITH {TO_TILES}, q AS ({cube_part(mode, family, groups)}),
      listed AS (SELECT *, sum("count") OVER (PARTITION BY city_geoid, period) AS year_total FROM q WHERE bin IN ({listed})),
      best AS (SELECT *, row_number() OVER (PARTITION BY city_geoid, bin ORDER BY year_total DESC, period) AS r FROM listed)
    SELECT CAST(city_geoid AS INTEGER) AS city_geoid, city_name, city_state_code, city_population2022{period}, {pivot}
    FROM best {pick} GROUP BY city_geoid, city_name, city_state_code, city_population2022{group}"""


def _report(df, labels):
    return df.withColumns(
        {
            **{f"TaxRate_median_{l}": F.round(f"TaxRate_median_{l}", 9) for l in labels.values()},
            **{f"SaleAmt_mean_{l}": steady(f"SaleAmt_mean_{l}", 5) for l in labels.values()},
        }
    )


@case("narrow_report", report_sql(SNAPSHOT, "SaleBinsNarrow", None, report.NARROW_LABELS))
def narrow_report(spark, d):
    one = summary(tiles(spark, d), GEO, "SaleBinsNarrow")
    out = report.bin_report(
        one, "SaleBinsNarrow", report.NARROW_LABELS, "Snapshot", REPORT_GEO, REPORT_VALUES
    )
    return _report(out, report.NARROW_LABELS)


@case("eleven_report_pooled", report_sql(POOLED, "SaleBins", None, report.ELEVEN_LABELS))
def eleven_report_pooled(spark, d):
    one = summary(tiles(spark, d), GEO, "SaleBins", POOLED)
    out = report.bin_report(
        one, "SaleBins", report.ELEVEN_LABELS, "Pooled", REPORT_GEO, REPORT_VALUES
    )
    return _report(out, report.ELEVEN_LABELS)


@case("quintile_report", report_sql(SNAPSHOT, "SaleAmt_Quintile", 5, report.QUINTILE_LABELS))
def quintile_report(spark, d):
    out = report.bin_report(
        _quintiles(spark, d),
        "SaleAmt_Quintile",
        report.QUINTILE_LABELS,
        "Snapshot",
        REPORT_GEO,
        REPORT_VALUES,
    )
    return _report(out, report.QUINTILE_LABELS)


@case("wide_report", report_sql(SNAPSHOT, "SaleBinsWide", None, report.WIDE_LABELS))
def wide_report(spark, d):
    one = summary(tiles(spark, d), GEO, "SaleBinsWide")
    out = report.bin_report(one, "SaleBinsWide", report.WIDE_LABELS, "Snapshot", REPORT_GEO, REPORT_VALUES)
    return _report(out, report.WIDE_LABELS)


TOTAL_REPORT_SQL = f"""WITH {TO_TILES}, q AS ({cube_part(SNAPSHOT, "Total", None)}),
  best AS (SELECT *, row_number() OVER (PARTITION BY city_geoid ORDER BY "count" DESC, period) AS r FROM q)
SELECT CAST(city_geoid AS INTEGER) AS city_geoid, city_name, city_state_code, city_population2022, CAST(period AS INTEGER) AS "SaleRecordingYear",
  bin AS "Total", "count", round("TaxRate_median", 9) AS "TaxRate_median", {steady_sql('"SaleAmt_mean"', 5)} AS "SaleAmt_mean" FROM best WHERE r = 1"""


@case("total_report", TOTAL_REPORT_SQL)
def total_report(spark, d):
    """Per city the year with most sales, not pivoted; sales outside every city are one row."""
    out = report.total_report(summary(tiles(spark, d), GEO, "Total"), "Snapshot", REPORT_GEO, REPORT_VALUES)
    return out.withColumns({"TaxRate_median": F.round("TaxRate_median", 9), "SaleAmt_mean": steady("SaleAmt_mean", 5)})


def _picked(report_: str, fields) -> str:
    listed = ", ".join(f'"{f}" AS "{a}"' for f, a in fields)
    return f"(SELECT city_geoid AS city, {listed} FROM ({report_}))"


def _banded(labels):
    return [(f"{v}_{l}",) * 2 for v in ("count", "TaxRate_median") for l in labels.values()]


@case(
    "combined_report",
    f"""WITH {RATES}, spine AS (SELECT DISTINCT place_id, table_city, tax_rate_median_value FROM rates)
    SELECT * EXCLUDE (city, city_1, city_2, city_3) FROM spine
    LEFT JOIN {_picked(TOTAL_REPORT_SQL, [("count", "count"), ("TaxRate_median", "TaxRate_median")])} t ON t.city = place_id
    LEFT JOIN (SELECT city AS city_1, * EXCLUDE (city) FROM {_picked(report_sql(SNAPSHOT, "SaleBinsNarrow", None, report.NARROW_LABELS), _banded(report.NARROW_LABELS))}) ON city_1 = place_id
    LEFT JOIN (SELECT city AS city_2, * EXCLUDE (city) FROM {_picked(report_sql(SNAPSHOT, "SaleBinsWide", None, report.WIDE_LABELS), _banded(report.WIDE_LABELS))}) ON city_2 = place_id
    LEFT JOIN (SELECT city AS city_3, * EXCLUDE (city) FROM {_picked(report_sql(SNAPSHOT, "SaleBins", None, report.ELEVEN_LABELS), [(f"TaxRate_median_{l}", f"bins_TaxRate_median_{l}") for l in report.ELEVEN_LABELS.values()])}) ON city_3 = place_id""",
)
def combined_report(spark, d):
    """Every city of the benchmark with its totals and all band reports beside it."""
    sold = tiles(spark, d)
    families = {"SaleBinsNarrow": report.NARROW_LABELS, "SaleBinsWide": report.WIDE_LABELS, "SaleBins": report.ELEVEN_LABELS}
    cube_ = cut_lineage(summary_cube(sold, GEO, ["Total", *families], {}, [SNAPSHOT]), "cube")
    one = {f: one_table(cube_, GEO[0], f, SNAPSHOT) for f in ("Total", *families)}
    total = report.total_report(one["Total"], "Snapshot", REPORT_GEO, REPORT_VALUES)
    bands = [report.bin_report(one[f], f, labels, "Snapshot", REPORT_GEO, REPORT_VALUES) for f, labels in families.items()]
    out = report.combined_report(rates(spark, d), total, *bands, columns=("place_id", "table_city", "tax_rate_median_value"))
    return out.withColumns({c: F.round(f"`{c}`", 9) for c in out.columns if "TaxRate_median" in c})
