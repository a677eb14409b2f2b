"""The domain tables as derived from the test tables, in Spark and in SQL.

deeds      <- orders (one deed per order)
roll       <- lineitem joined to orders, summed per customer and year
places     <- customer joined to nation and region (city = nation)
index      <- mean order price per nation and quarter, averaged per year, rebased to 1998
rates      <- nation with a rate computed from its key (statutory benchmark), one key listed twice
tiles      <- all of the above through the library's own pipeline steps
points     <- orders or customers at grid coordinates computed from their keys
polygons   <- suppliers as rectangles with a triangular hole and a second part

Coordinates are multiples of 1/64, so both engines compute them exactly and boundary hits occur.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millgauge.operators.joins import equi_join
from millgauge.operators.panel import annualise, rebase
from millgauge.plans import etl
from millgauge.sources.staged import materialize, shared_folder

MIN_YEAR = 1996
BASE_YEAR = 1998
GEO = ["city_geoid", "city_name", "city_state_code", "city_population2022"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Share the rows of a table of very few files among the cores; many files stay as they are.

    For work that costs much per row: a single small file would otherwise be one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) * 4 < cores else df


def staged(spark: SparkSession, d: str, name: str, build) -> DataFrame:
    """A pipeline stage, written once per application and input folder, as the pipeline does."""
    inputs = hashlib.md5(d.encode()).hexdigest()[:12]
    app = spark.sparkContext.applicationId
    return materialize(spark, build, f"{shared_folder(spark)}/{app}/{inputs}/{name}")


def cents(c: Column) -> Column:
    """Whole cents, so that sums are exact."""
    return F.floor(c * 100 + 0.5).cast("long")


def deeds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("PropertyID"),
        F.to_date("o_orderdate").alias("RecordingDate"),
        F.col("o_totalprice").alias("SaleAmt"),
        F.col("o_orderkey").cast("string").alias("FATransactionID"),
        F.substring("o_orderpriority", 1, 1).alias("TransactionType"),
        F.substring(F.col("o_orderkey").cast("string"), 1, 1).alias("FATransactionID_1"),
        F.year("o_orderdate").alias("RecordingYear"),
        F.year("o_orderdate").alias("SaleYear"),
    )


DEEDS = """deeds AS (
  SELECT o_custkey AS "PropertyID", CAST(o_orderdate AS DATE) AS "RecordingDate",
    o_totalprice AS "SaleAmt", CAST(o_orderkey AS VARCHAR) AS "FATransactionID",
    substr(o_orderpriority, 1, 1) AS "TransactionType",
    substr(CAST(o_orderkey AS VARCHAR), 1, 1) AS "FATransactionID_1",
    CAST(year(o_orderdate) AS INTEGER) AS "RecordingYear",
    CAST(year(o_orderdate) AS INTEGER) AS "SaleYear"
  FROM orders)"""

RANKED = f"""ranked_all AS (
  SELECT *, "SaleYear" AS "SaleRecordingYear",
    row_number() OVER (PARTITION BY "RecordingYear", "PropertyID"
      ORDER BY "RecordingDate" DESC, "FATransactionID") AS "RecentSaleByYear",
    row_number() OVER (PARTITION BY "PropertyID"
      ORDER BY "RecordingDate" DESC, "FATransactionID") AS "MostRecentSale",
    CASE WHEN "FATransactionID_1" IN ('1', '6') AND "TransactionType" IN ('2', '3')
      THEN 1 ELSE 0 END AS "SaleFlag"
  FROM deeds WHERE "RecordingYear" >= {MIN_YEAR} OR "SaleYear" >= {MIN_YEAR}),
ranked AS (
  SELECT * FROM ranked_all
  WHERE "SaleFlag" = 1 AND "RecentSaleByYear" = 1 AND "SaleRecordingYear" >= {MIN_YEAR})"""


def roll(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    summed = (
        equi_join(lines, orders, {"l_orderkey": "o_orderkey"})
        .groupBy("o_custkey", F.year("o_orderdate").alias("TaxYear"))
        .agg(
            F.sum(cents(F.col("l_extendedprice") * F.col("l_tax"))).alias("tax"),
            F.sum(cents(F.col("l_extendedprice"))).alias("value"),
        )
    )
    key = F.col("o_custkey")
    value = F.col("value") / 100.0
    return equi_join(summed, customer, {"o_custkey": "c_custkey"}).select(
        key.alias("PropertyID"),
        F.concat(F.lit("APN-"), key.cast("string")).alias("APN"),
        F.lit("R").alias("PropertyClassID"),
        F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("FIPS"),
        "TaxYear",
        (F.col("tax") / 100.0).alias("TaxAmt"),
        F.lit(None).cast("int").alias("CurrentSaleRecordingYear"),
        F.lit(None).cast("double").alias("CurrentSalesPrice"),
        (F.col("TaxYear") - (key % 3).cast("int")).alias("AssdYear"),
        F.when(key % 11 == 0, 0.0).when(key % 13 != 0, value).alias("AssdTotalValue"),
        (F.col("TaxYear") - (key % 2).cast("int")).alias("MarketYear"),
        F.when(key % 7 != 0, value * 1.25).alias("MarketTotalValue"),
    )


ROLL = """roll AS (
  SELECT o_custkey AS "PropertyID", lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS "FIPS", "TaxYear",
    tax / 100.0::DOUBLE AS "TaxAmt",
    CAST("TaxYear" - o_custkey % 3 AS INTEGER) AS "AssdYear",
    CASE WHEN o_custkey % 11 = 0 THEN 0.0::DOUBLE
      WHEN o_custkey % 13 <> 0 THEN assd / 100.0::DOUBLE END AS "AssdTotalValue",
    CAST("TaxYear" - o_custkey % 2 AS INTEGER) AS "MarketYear",
    CASE WHEN o_custkey % 7 <> 0 THEN assd / 100.0::DOUBLE * 1.25::DOUBLE END AS "MarketTotalValue"
  FROM (
    SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS "TaxYear",
      CAST(sum(CAST(floor(l_extendedprice * l_tax * 100 + 0.5) AS BIGINT)) AS BIGINT) AS tax,
      CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS assd
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
  JOIN customer ON c_custkey = o_custkey)"""


def cities(spark: SparkSession, d: str) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    n = F.col("n_nationkey")
    return equi_join(nation, region, {"n_regionkey": "r_regionkey"}).select(
        "n_nationkey",
        F.lpad((n * 1000).cast("string"), 7, "0").alias("city_geoid"),
        F.col("n_name").alias("city_name"),
        F.substring("r_name", 1, 2).alias("city_state_code"),
        (F.lit(900000) - n * 1000).cast("long").alias("city_population2022"),
    )


CITIES = """cities AS (
  SELECT n_nationkey, lpad(CAST(n_nationkey * 1000 AS VARCHAR), 7, '0') AS city_geoid,
    n_name AS city_name, substr(r_name, 1, 2) AS city_state_code,
    CAST(900000 - n_nationkey * 1000 AS BIGINT) AS city_population2022
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def places(spark: SparkSession, d: str) -> DataFrame:
    """Crosswalk: every customer's city, one customer in 23 without one."""
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    keyed = customer.withColumn(
        "c_nationkey", F.when(F.col("c_custkey") % 23 != 0, F.col("c_nationkey"))
    )
    return (
        equi_join(keyed, cities(spark, d), {"c_nationkey": "n_nationkey"}, "left")
        .withColumnRenamed("c_custkey", "PropertyID")
        .drop("c_nationkey")
    )


PLACES = """places AS (
  SELECT c_custkey AS "PropertyID", city_geoid, city_name, city_state_code, city_population2022
  FROM customer LEFT JOIN cities ON c_custkey % 23 <> 0 AND c_nationkey = n_nationkey)"""


def quarterly_index(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return (
        equi_join(orders, customer, {"o_custkey": "c_custkey"})
        .groupBy(
            F.col("c_nationkey"),
            F.year("o_orderdate").alias("year"),
            F.quarter("o_orderdate").alias("quarter"),
        )
        .agg(F.sum(cents(F.col("o_totalprice"))).alias("s"), F.count(F.lit(1)).alias("n"))
        .select("c_nationkey", "year", "quarter", (F.col("s") / F.col("n") / 100000.0).alias("hpi"))
    )


QUARTERLY = """quarterly AS (
  SELECT c_nationkey, CAST(year(o_orderdate) AS INTEGER) AS "year",
    CAST(quarter(o_orderdate) AS INTEGER) AS "quarter",
    CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) / 100000.0::DOUBLE AS hpi
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3)"""


def index(spark: SparkSession, d: str) -> DataFrame:
    yearly = annualise(quarterly_index(spark, d), ["c_nationkey"], "year", "hpi")
    based = rebase(yearly, "c_nationkey", "year", "hpi", [BASE_YEAR], "hpi_index_2021")
    return based.select(
        F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("county_fips"),
        "year",
        "hpi",
        "hpi_index_2021",
    )


INDEX = f"""yearly AS (SELECT c_nationkey, "year", avg(hpi) AS hpi FROM quarterly GROUP BY 1, 2),
hpi AS (
  SELECT lpad(CAST(y.c_nationkey AS VARCHAR), 5, '0') AS county_fips, y."year", y.hpi,
    b.hpi / y.hpi AS hpi_index_2021
  FROM yearly y LEFT JOIN yearly b ON b.c_nationkey = y.c_nationkey AND b."year" = {BASE_YEAR})"""


def rates(spark: SparkSession, d: str) -> DataFrame:
    """Statutory benchmark for four nations in five; the even ones are listed twice."""
    n = F.col("n_nationkey")
    base = table(spark, d, "nation").where(n % 5 != 3)
    one = base.select(
        (n * 1000).cast("int").alias("place_id"),
        F.lit("first").alias("table_group"),
        n.alias("table_order"),
        F.col("n_name").alias("table_city"),
        (F.lit(0.03) + n * 0.0005).alias("tax_rate_median_value"),
        (F.lit(0.02) + n * 0.0005).alias("tax_rate_150k"),
        (F.lit(0.025) + n * 0.0005).alias("tax_rate_300k"),
    )
    two = one.where(F.col("place_id") % 2000 == 0).withColumns(
        {
            "table_group": F.lit("second"),
            "table_order": F.col("table_order") + 100,
            "tax_rate_150k": F.lit(0.09),
        }
    )
    return one.unionByName(two)


RATES = """rates AS (
  SELECT CAST(n_nationkey * 1000 AS INTEGER) AS place_id, 'first' AS table_group,
    n_nationkey AS table_order, n_name AS table_city,
    0.03::DOUBLE + n_nationkey * 0.0005::DOUBLE AS tax_rate_median_value,
    0.02::DOUBLE + n_nationkey * 0.0005::DOUBLE AS tax_rate_150k,
    0.025::DOUBLE + n_nationkey * 0.0005::DOUBLE AS tax_rate_300k
  FROM nation WHERE n_nationkey % 5 <> 3
  UNION ALL
  SELECT CAST(n_nationkey * 1000 AS INTEGER), 'second', n_nationkey + 100, n_name,
    0.03::DOUBLE + n_nationkey * 0.0005::DOUBLE, 0.09::DOUBLE,
    0.025::DOUBLE + n_nationkey * 0.0005::DOUBLE
  FROM nation WHERE n_nationkey % 5 <> 3 AND n_nationkey % 2 = 0)"""


def staging(spark: SparkSession, d: str) -> DataFrame:
    return etl.stage_sales(
        etl.rank_sales(deeds(spark, d), MIN_YEAR),
        roll(spark, d),
        places(spark, d),
        index(spark, d),
        MIN_YEAR,
    )


def tiles(spark: SparkSession, d: str) -> DataFrame:
    def build() -> DataFrame:
        sales = staged(spark, d, "sales_staging", lambda: staging(spark, d))
        return etl.tile_sales(sales, split_year=1999)

    return staged(spark, d, "sales_staging_tiles", build)


STAGING = f"""staging AS (
  SELECT r."PropertyID", r."SaleRecordingYear", r."SaleAmt", r."FATransactionID",
    r."RecentSaleByYear", r."MostRecentSale", t."FIPS", t."TaxAmt", t."AssdYear",
    t."AssdTotalValue", t."MarketYear", t."MarketTotalValue",
    p.city_geoid, p.city_name, p.city_state_code, p.city_population2022,
    s.hpi_index_2021 AS sale_index, a.hpi_index_2021 AS assd_index, m.hpi_index_2021 AS market_index
  FROM ranked r
  JOIN roll t ON t."PropertyID" = r."PropertyID" AND t."TaxYear" = r."SaleRecordingYear"
  JOIN places p ON p."PropertyID" = r."PropertyID"
  JOIN hpi s ON s.county_fips = t."FIPS" AND s."year" = r."SaleRecordingYear" AND s."year" >= {MIN_YEAR}
  LEFT JOIN hpi a ON a.county_fips = t."FIPS" AND a."year" = t."AssdYear" AND a."year" >= {MIN_YEAR}
  LEFT JOIN hpi m ON m.county_fips = t."FIPS" AND m."year" = t."MarketYear" AND m."year" >= {MIN_YEAR}
  WHERE t."TaxAmt" > 0 AND r."SaleAmt" > 0)"""

RATED = """rated AS (
  SELECT *, "TaxAmt_HPI2021" / "SaleAmt_HPI2021" AS "TaxRate_HPI2021",
    "AssdTotalValue_HPI2021_Imputed" / "SaleAmt_HPI2021" AS "AssdValue_SaleAmt_Ratio",
    "TaxAmt_HPI2021" / nullif("AssdTotalValue_HPI2021_Imputed" / "SaleAmt_HPI2021", 0)
      AS "TaxAmt_to_AssdValue_SaleAmt_Ratio"
  FROM (
    SELECT *, "TaxAmt" / "SaleAmt" AS "TaxRate",
      "SaleAmt" * sale_index AS "SaleAmt_HPI2021", "TaxAmt" * sale_index AS "TaxAmt_HPI2021",
      CASE WHEN ("AssdTotalValue" = 0 OR "AssdTotalValue" IS NULL) AND "MarketTotalValue" > 0
        THEN "MarketTotalValue" * market_index ELSE "AssdTotalValue" * assd_index END
        AS "AssdTotalValue_HPI2021_Imputed"
    FROM staging))"""


WIDE_SQL = """CASE WHEN {c} < 100000 THEN '1 - <$100K'
  WHEN {c} BETWEEN 100000 AND 200000 THEN '2 - $100K-$200K'
  WHEN {c} > 200000 AND {c} < 250000 THEN '3 - $200K-$250K'
  WHEN {c} BETWEEN 250000 AND 350000 THEN '4 - $250K-$350K'
  WHEN {c} > 350000 THEN '5 - >$350K' END"""
NARROW_SQL = """CASE WHEN {c} < 120000 THEN '1 - <$120K'
  WHEN {c} BETWEEN 120000 AND 180000 THEN '2 - $120K-$180K'
  WHEN {c} > 180000 AND {c} < 270000 THEN '3 - $180K-$270K'
  WHEN {c} BETWEEN 270000 AND 330000 THEN '4 - $270K-$330K'
  WHEN {c} > 330000 THEN '5 - >$330K' END"""
ELEVEN_SQL = """CASE WHEN {c} < 100000 THEN '1 - <$100K' WHEN {c} >= 1000000 THEN '11 - >$1M'
  ELSE CAST(CAST(floor({c} / 100000) AS INTEGER) + 1 AS VARCHAR) || ' - $'
    || CAST(CAST(floor({c} / 100000) AS INTEGER) * 100 AS VARCHAR) || 'K-$'
    || CASE WHEN {c} >= 900000 THEN '1M'
       ELSE CAST((CAST(floor({c} / 100000) AS INTEGER) + 1) * 100 AS VARCHAR) || 'K' END END"""

TILES = f"""percentiles AS (
  SELECT *,
    CAST(ceil(CAST(row_number() OVER (PARTITION BY "SaleRecordingYear", "FIPS"
      ORDER BY "SaleAmt" DESC, "FATransactionID") AS DOUBLE)
      / count(*) OVER (PARTITION BY "SaleRecordingYear", "FIPS") * 100) AS INTEGER)
      AS "SaleAmt_County_Percentile",
    CAST(ceil(CAST(row_number() OVER (PARTITION BY "SaleRecordingYear", "FIPS"
      ORDER BY "TaxRate" DESC, "FATransactionID") AS DOUBLE)
      / count(*) OVER (PARTITION BY "SaleRecordingYear", "FIPS") * 100) AS INTEGER)
      AS "TaxRate_County_Percentile"
  FROM rated),
tiles AS (
  SELECT *,
    CASE WHEN "SaleRecordingYear" < 1999 THEN 'Pre-1999' ELSE 'Post-1999' END
      AS "SaleRecordingYear_Bins",
    {WIDE_SQL.format(c='"SaleAmt_HPI2021"')} AS "SaleBinsWide",
    {NARROW_SQL.format(c='"SaleAmt_HPI2021"')} AS "SaleBinsNarrow",
    {ELEVEN_SQL.format(c='"SaleAmt_HPI2021"')} AS "SaleBins",
    'Total' AS "Total",
    CASE WHEN "SaleAmt_County_Percentile" <= 2 OR "SaleAmt_County_Percentile" >= 99
      THEN 'Tails' ELSE 'Middle 96%' END AS "Sale_Outliers",
    CASE WHEN "TaxRate_County_Percentile" <= 2 OR "TaxRate_County_Percentile" >= 99
      THEN 'Tails' ELSE 'Middle 96%' END AS "TaxRate_Outliers"
  FROM percentiles)"""

TO_STAGING = ",\n".join([DEEDS, RANKED, ROLL, CITIES, PLACES, QUARTERLY, INDEX, STAGING])
TO_TILES = ",\n".join([TO_STAGING, RATED, TILES])


def points(spark: SparkSession, d: str) -> DataFrame:
    """Orders at grid coordinates; one in 19 has none."""
    k = F.col("o_orderkey")
    located = k % 19 != 0
    return spread(table(spark, d, "orders").select("o_orderkey")).select(
        k.alias("point_id"),
        F.when(located, F.lit(-90.0) + (k * 37 % 997) / 64.0).alias("lon"),
        F.when(located, F.lit(30.0) + (k * 53 % 691) / 64.0).alias("lat"),
    )


POINTS = """points AS (
  SELECT o_orderkey AS point_id,
    CASE WHEN o_orderkey % 19 <> 0 THEN -90.0::DOUBLE + (o_orderkey * 37 % 997) / 64.0::DOUBLE END AS lon,
    CASE WHEN o_orderkey % 19 <> 0 THEN 30.0::DOUBLE + (o_orderkey * 53 % 691) / 64.0::DOUBLE END AS lat
  FROM orders)"""

# Vertices as offsets in units of 1/64 degree from the centre, scaled by half-width h: ring, x, y.
# Shell counter-clockwise, hole clockwise (every third polygon), second shell (every fifth).
SHAPE = {
    "shell": ("", [(-2, -2), (2, -2), (2, 2), (-2, 2)]),
    "hole": ("s_suppkey % 3 = 0", [(-1, -1), (0, 1), (1, -1)]),
    "second": ("s_suppkey % 5 = 0", [(3, 0), (4, 0), (3, 1)]),
}


def polygons(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    cx = F.lit(-90.0) + (k * 41 % 997) / 64.0
    cy = F.lit(30.0) + (k * 67 % 691) / 64.0
    h = (k % 7 + 2) / 64.0 * 4

    def ring(vertices) -> Column:
        return F.array(
            *[F.struct((cx + h * x).alias("x"), (cy + h * y).alias("y")) for x, y in vertices]
        )

    rings = []
    for condition, vertices in SHAPE.values():
        one = F.array(ring(vertices))
        rings.append(one if not condition else F.when(F.expr(condition), one).otherwise(F.slice(one, 1, 0)))
    return table(spark, d, "supplier").select(
        k.alias("polygon_id"), F.col("s_name").alias("polygon_name"), F.concat(*rings).alias("rings")
    )


def _polygon_sql() -> str:
    arms = []
    for r, (condition, vertices) in enumerate(SHAPE.values()):
        listed = ", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(vertices))
        n = len(vertices)
        where = f"WHERE {condition}" if condition else ""
        arms.append(
            f"SELECT s_suppkey AS polygon_id, s_name AS polygon_name, {r} AS ring, v.i, {n} AS n, "
            "-90.0::DOUBLE + (s_suppkey * 41 % 997) / 64.0::DOUBLE + (s_suppkey % 7 + 2) / 64.0::DOUBLE * 4 * v.x AS x, "
            "30.0::DOUBLE + (s_suppkey * 67 % 691) / 64.0::DOUBLE + (s_suppkey % 7 + 2) / 64.0::DOUBLE * 4 * v.y AS y "
            f"FROM supplier CROSS JOIN (VALUES {listed}) v(i, x, y) {where}"
        )
    return (
        "vertices AS (" + " UNION ALL ".join(arms) + "),\n"
        "edges AS (SELECT a.polygon_id, a.polygon_name, a.ring, a.i, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 "
        "FROM vertices a JOIN vertices b ON b.polygon_id = a.polygon_id AND b.ring = a.ring "
        "AND b.i = (a.i + 1) % a.n)"
    )


POLYGONS = _polygon_sql()

INSIDE = """boxes AS (
  SELECT polygon_id, min(x1) AS minx, max(x1) AS maxx, min(y1) AS miny, max(y1) AS maxy
  FROM edges GROUP BY 1),
candidates AS (
  SELECT point_id, lon, lat, polygon_id FROM points JOIN boxes
  ON lon >= minx AND lon <= maxx AND lat >= miny AND lat <= maxy),
inside AS (
  SELECT point_id, polygon_id, min(polygon_name) AS polygon_name
  FROM candidates JOIN edges USING (polygon_id)
  GROUP BY 1, 2
  HAVING sum(CASE WHEN (y1 > lat) <> (y2 > lat)
      AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1 THEN 1 ELSE 0 END) % 2 = 1
    AND max(CASE WHEN (lon - x1) * (y2 - y1) - (lat - y1) * (x2 - x1) = 0
      AND lon BETWEEN least(x1, x2) AND greatest(x1, x2)
      AND lat BETWEEN least(y1, y2) AND greatest(y1, y2) THEN 1 ELSE 0 END) = 0)"""
