"""Dimension tables of places: counties with their metro areas, cities with populations and ranks."""

from pyspark.sql import functions as F

from millgauge.plans import dimensions
from verification.registry import case
from verification.standins import table


@case(
    "county_crosswalk",
    """WITH states AS (SELECT c_custkey AS k, substr(n_name, 1, 2) AS state_codes, lpad(c_nationkey::VARCHAR, 2, '0') AS state_fips, n_name AS state_name,
        CASE WHEN c_custkey < 100 THEN lpad(c_custkey::VARCHAR, 3, '0') ELSE c_custkey::VARCHAR END AS county_code, c_name AS county_name
      FROM customer JOIN nation ON n_nationkey = c_nationkey)
    SELECT state_codes, state_fips, state_name, county_code, county_name, state_fips || county_code AS county_fips,
      CASE WHEN k % 3 <> 0 THEN (10000 + k % 50)::VARCHAR ELSE 'state_' || state_fips END AS cbsa_fips,
      CASE WHEN k % 3 <> 0 THEN 'Area ' || (k % 50) ELSE 'Non-CBSA ' || state_name END AS cbsa_title,
      CASE WHEN k % 3 = 0 THEN 'Non-CBSA' WHEN k % 4 = 0 THEN 'MSA' WHEN k % 4 = 1 THEN 'muSA' ELSE 'Other Area' END AS area_type,
      CASE WHEN k % 3 <> 0 AND k % 5 <> 0 THEN 'Central' ELSE 'Residual' END AS central_outlying_county,
      CASE WHEN k % 7 <> 0 THEN (k * 10)::DOUBLE ELSE 0.0::DOUBLE END AS county_pop20 FROM states""",
)
def county_crosswalk(spark, d):
    """Customers as counties of their nation: two thirds in a metro area, some without a population."""
    k = F.col("c_custkey")
    customer = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    state = F.lpad(F.col("c_nationkey").cast("string"), 2, "0")
    code = F.when(k < 100, F.lpad(k.cast("string"), 3, "0")).otherwise(k.cast("string"))
    states = customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(
        F.substring("n_name", 1, 2).alias("state_codes"),
        state.alias("state_fips"),
        F.col("n_name").alias("state_name"),
        code.alias("county_code"),
        F.col("c_name").alias("county_name"),
    )
    kind = F.when(k % 4 == 0, "Metropolitan Statistical Area").when(k % 4 == 1, "Micropolitan Statistical Area")
    areas = customer.where(k % 3 != 0).select(
        (F.lit(10000) + k % 50).cast("int").alias("CBSA Code"),
        F.concat(F.lit("Area "), (k % 50).cast("string")).alias("CBSA Title"),
        kind.otherwise("Other Area").alias("Metropolitan/Micropolitan Statistical Area"),
        F.when(k % 5 != 0, "Central").alias("Central/Outlying County"),
        F.col("c_nationkey").cast("string").alias("FIPS State Code"),
        k.cast("string").alias("FIPS County Code"),
    )
    people = customer.where(k % 7 != 0).select(F.concat(state, code).alias("GEOID"), (k * 10).alias("estimate"))
    return dimensions.county_crosswalk(states, areas, people)


@case(
    "city_places",
    """WITH estimates AS (SELECT lpad(c_nationkey::VARCHAR, 2, '0') || CASE WHEN c_custkey < 10000 THEN lpad(c_custkey::VARCHAR, 5, '0') ELSE c_custkey::VARCHAR END AS placeid,
        c_custkey AS k, 'S' || (c_nationkey % 6) AS state, n_name, c_custkey % 90 * 7 AS p20, CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 97 END AS p22
      FROM customer JOIN nation ON n_nationkey = c_nationkey),
    listed AS (SELECT *, row_number() OVER (ORDER BY p22 DESC NULLS LAST, placeid) AS place FROM estimates WHERE k % 4 <> 0)
    SELECT e.placeid AS city_geoid, 'City ' || e.k || ' ' AS city_name, e.state AS city_state_code, l.p20 AS city_population2020, l.p22 AS city_population2022,
      CASE WHEN l.p22 IS NOT NULL THEN l.place END AS city_rank, (1 + e.k % 2)::INTEGER AS parts
    FROM estimates e LEFT JOIN listed l USING (placeid) WHERE e.state IN ('S0', 'S2', 'S5')""",
)
def city_places(spark, d):
    """Customers as cities: populations ranked over the whole country, shapes of the listed states."""
    k = F.col("c_custkey")
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    cities = customer.join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    estimates = cities.select(
        F.when(k % 4 != 0, "162").otherwise("050").alias("SUMLEV"),
        F.col("c_nationkey").cast("string").alias("STATE"),
        k.cast("string").alias("PLACE"),
        F.lit("x").alias("NAME"),
        F.col("n_name").alias("STNAME"),
        (k % 90 * 7).alias("POPESTIMATE2020"),
        F.lit(0).alias("POPESTIMATE2021"),
        F.when(k % 13 != 0, k % 97).alias("POPESTIMATE2022"),
    )
    corner = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1))
    place = F.when(k < 10000, F.lpad(k.cast("string"), 5, "0")).otherwise(k.cast("string"))
    shapes = cities.select(
        F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), place).alias("GEOID"),
        F.concat(F.lit("City "), k.cast("string"), F.lit(" (part)-"), F.col("n_name")).alias("NAME"),
        F.concat(F.lit("S"), (F.col("c_nationkey") % 6).cast("string")).alias("STUSPS"),
        F.when(k % 2 == 0, F.array(ring)).otherwise(F.array(ring, ring)).alias("rings"),
    )
    found = dimensions.city_places(shapes, dimensions.place_population(estimates), ["S0", "S2", "S5"])
    return found.withColumn("parts", F.size("rings")).drop("rings")
