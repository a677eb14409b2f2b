"""Joins, set operations, reshaping, sorts and data-quality checks."""

from functools import reduce

from pyspark.sql import functions as F

from millgauge.functions import clean
from millgauge.operators import quality
from millgauge.operators.heavy import Running, running_totals
from millgauge.operators.joins import (
    Level,
    coverage,
    equi_join,
    fallback_lookup,
    in_values_of,
    role_lookup,
    spine_join,
)
from millgauge.operators.lookup import skew_safe_lookup
from millgauge.operators.reshape import (
    complete,
    first_distinct,
    pivot_multi,
    pivot_single,
    to_long,
    union_all,
)
from verification.registry import case
from verification.standins import (
    CITIES,
    DEEDS,
    INDEX,
    QUARTERLY,
    RANKED,
    RATES,
    ROLL,
    MIN_YEAR,
    cities,
    deeds,
    index,
    rates,
    roll,
    table,
)
from millgauge.plans import etl


@case(
    "semi_join_benchmark",
    f"""WITH {RATES}, {CITIES}
    SELECT c_custkey, city_geoid FROM customer JOIN cities ON c_nationkey = n_nationkey
    WHERE CAST(city_geoid AS INTEGER) IN (SELECT place_id FROM rates)""",
)
def semi_join_benchmark(spark, d):
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    placed = equi_join(customer, cities(spark, d), {"c_nationkey": "n_nationkey"})
    covered = in_values_of(placed, rates(spark, d), "city_geoid", "place_id", "int")
    return covered.select("c_custkey", "city_geoid")


@case(
    "anti_join_coverage",
    """SELECT c_custkey FROM customer WHERE c_custkey NOT IN
      (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997)""",
)
def anti_join_coverage(spark, d):
    sold = table(spark, d, "orders").where(F.year("o_orderdate") == 1997)
    return coverage(
        table(spark, d, "customer"), sold.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey"
    )


@case(
    "coverage_count",
    """SELECT count(*) AS missing_keys FROM customer WHERE c_custkey NOT IN
      (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""",
)
def coverage_count(spark, d):
    sold = table(spark, d, "orders").where(F.col("o_totalprice") > 400000)
    return quality.coverage_report(
        table(spark, d, "customer"), sold.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey"
    )


@case(
    "composite_inner_join",
    f"""WITH {DEEDS}, {RANKED}, {ROLL}
    SELECT r."PropertyID" AS property_id, r."FATransactionID" AS sale_id, r."SaleRecordingYear" AS sale_year,
      r."SaleAmt" AS price, t."TaxAmt" AS tax
    FROM ranked r JOIN roll t ON t."PropertyID" = r."PropertyID" AND t."TaxYear" = r."SaleRecordingYear" """,
)
def composite_inner_join(spark, d):
    sales = etl.rank_sales(deeds(spark, d), MIN_YEAR)
    joined = equi_join(
        sales,
        roll(spark, d).select("PropertyID", "TaxYear", "TaxAmt"),
        {"PropertyID": "PropertyID", "SaleRecordingYear": "TaxYear"},
    )
    return joined.select(
        F.col("PropertyID").alias("property_id"),
        F.col("FATransactionID").alias("sale_id"),
        F.col("SaleRecordingYear").cast("int").alias("sale_year"),
        F.col("SaleAmt").alias("price"),
        F.col("TaxAmt").alias("tax"),
    )


@case(
    "left_join_dim",
    f"""WITH {CITIES}
    SELECT c_custkey, city_name, r.city_state_code
    FROM customer LEFT JOIN cities ON c_nationkey = n_nationkey AND n_nationkey % 4 <> 0
    LEFT JOIN (SELECT DISTINCT city_state_code, city_state_code AS k FROM cities) r ON r.k = cities.city_state_code""",
)
def left_join_dim(spark, d):
    dim = cities(spark, d)
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    some = dim.where(F.col("n_nationkey") % 4 != 0).select(
        "n_nationkey", "city_name", F.col("city_state_code").alias("state")
    )
    states = dim.select("city_state_code", F.col("city_state_code").alias("k")).distinct()
    joined = equi_join(customer, some, {"c_nationkey": "n_nationkey"}, "left")
    return equi_join(joined, states, {"state": "k"}, "left").select(
        "c_custkey", "city_name", "city_state_code"
    )


@case(
    "null_safe_left_join",
    """WITH l AS (SELECT c_custkey, CASE WHEN c_nationkey % 6 <> 0 THEN c_nationkey END AS k FROM customer),
      r AS (SELECT CASE WHEN n_nationkey <> 1 THEN n_nationkey END AS k, n_name FROM nation)
    SELECT c_custkey, n_name FROM l LEFT JOIN r ON l.k IS NOT DISTINCT FROM r.k""",
)
def null_safe_left_join(spark, d):
    left = table(spark, d, "customer").select(
        "c_custkey", F.when(F.col("c_nationkey") % 6 != 0, F.col("c_nationkey")).alias("k")
    )
    right = table(spark, d, "nation").select(
        F.when(F.col("n_nationkey") != 1, F.col("n_nationkey")).alias("k"), "n_name"
    )
    return equi_join(left, right, ["k"], "left", null_safe=True).select("c_custkey", "n_name")


@case(
    "role_playing_lookup",
    f"""WITH {ROLL}, {QUARTERLY}, {INDEX}
    SELECT t."PropertyID" AS property_id, t."TaxYear" AS tax_year,
      round(s.hpi_index_2021, 6) AS tax_index, round(a.hpi_index_2021, 6) AS assd_index,
      round(m.hpi_index_2021, 6) AS market_index,
      round(t."TaxAmt" * s.hpi_index_2021, 4) AS tax_real
    FROM roll t
    JOIN hpi s ON s.county_fips = t."FIPS" AND s."year" = t."TaxYear" AND s."year" >= 1997
    LEFT JOIN hpi a ON a.county_fips = t."FIPS" AND a."year" = t."AssdYear" AND a."year" >= 1997
    LEFT JOIN hpi m ON m.county_fips = t."FIPS" AND m."year" = t."MarketYear" AND m."year" >= 1997""",
)
def role_playing_lookup(spark, d):
    dim = index(spark, d).where(F.col("year") >= 1997)
    looked = role_lookup(
        roll(spark, d),
        dim,
        "FIPS",
        "county_fips",
        "year",
        "hpi_index_2021",
        {
            "tax_index": ("TaxYear", "inner"),
            "assd_index": ("AssdYear", "left"),
            "market_index": ("MarketYear", "left"),
        },
    )
    return looked.select(
        F.col("PropertyID").alias("property_id"),
        F.col("TaxYear").alias("tax_year"),
        F.round("tax_index", 6).alias("tax_index"),
        F.round("assd_index", 6).alias("assd_index"),
        F.round("market_index", 6).alias("market_index"),
        F.round(F.col("TaxAmt") * F.col("tax_index"), 4).alias("tax_real"),
    )


FALLBACK_LON = "CASE WHEN c_custkey % 3 = 0 THEN c_custkey / 64.0::DOUBLE END"
FALLBACK_LAT = "CASE WHEN c_custkey % 4 = 0 THEN c_custkey / 128.0::DOUBLE END"


@case(
    "fallback_lookup",
    f"""WITH base AS (
      SELECT c_custkey, {FALLBACK_LON} AS lon, {FALLBACK_LAT} AS lat,
        lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || c_mktsegment AS code, c_nationkey FROM customer),
    fine AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || 'MACHINERY' AS code,
      n_nationkey + 0.5::DOUBLE AS lon, NULL::DOUBLE AS lat FROM nation),
    coarse AS (SELECT n_nationkey AS k, n_nationkey + 0.25::DOUBLE AS lon, n_nationkey - 0.25::DOUBLE AS lat
      FROM nation WHERE n_nationkey % 5 <> 0)
    SELECT c_custkey, coalesce(base.lon, fine.lon, coarse.lon) AS lon,
      coalesce(base.lat, fine.lat, coarse.lat) AS lat
    FROM base LEFT JOIN fine ON fine.code = base.code LEFT JOIN coarse ON coarse.k = c_nationkey""",
)
def fallback(spark, d):
    key = F.col("c_custkey")
    base = table(spark, d, "customer").select(
        "c_custkey",
        F.when(key % 3 == 0, key / 64.0).alias("lon"),
        F.when(key % 4 == 0, key / 128.0).alias("lat"),
        clean.geography_code(
            F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.col("c_mktsegment")
        ).alias("code"),
        "c_nationkey",
    )
    nation = table(spark, d, "nation")
    n = F.col("n_nationkey")
    fine = nation.select(
        F.concat(F.lpad(n.cast("string"), 2, "0"), F.lit("MACHINERY")).alias("fine_code"),
        (n + 0.5).alias("x"),
        F.lit(None).cast("double").alias("y"),
    )
    coarse = nation.where(n % 5 != 0).select(n, (n + 0.25).alias("x"), (n - 0.25).alias("y"))
    names = {"lon": "x", "lat": "y"}
    return fallback_lookup(
        base,
        [Level(fine, "code", "fine_code", names), Level(coarse, "c_nationkey", "n_nationkey", names)],
    ).select("c_custkey", "lon", "lat")


CROWDED_CODE = "CASE WHEN o_orderkey % 3 = 0 THEN '07-A' WHEN o_orderkey % 5 <> 1 THEN lpad(CAST(o_custkey % 30 AS VARCHAR), 2, '0') || '-' || chr(CAST(65 + o_orderkey % 2 AS INTEGER)) END"


@case(
    "fallback_lookup_heavy",
    f"""WITH base AS (SELECT o_orderkey, o_custkey % 30 AS k, {CROWDED_CODE} AS code, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey / 64.0::DOUBLE END AS lon FROM orders),
    fine AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '-' || side AS code, CASE WHEN n_nationkey % 4 <> 3 THEN n_nationkey + 0.5::DOUBLE END AS lon,
      CASE WHEN side = 'A' THEN n_nationkey - 0.5::DOUBLE END AS lat FROM nation, (VALUES ('A'), ('B')) s(side))
    SELECT o_orderkey, coalesce(base.lon, fine.lon, n_nationkey + 0.25::DOUBLE) AS lon, coalesce(fine.lat, n_nationkey - 0.25::DOUBLE) AS lat
    FROM base LEFT JOIN fine ON fine.code = base.code LEFT JOIN nation ON n_nationkey = k""",
)
def fallback_lookup_heavy(spark, d):
    """A third of the orders under one code, a seventh without one: hot keys and nulls do not share a task."""
    key, n = F.col("o_orderkey"), F.col("n_nationkey")
    own = F.concat(F.lpad((F.col("o_custkey") % 30).cast("string"), 2, "0"), F.lit("-"), F.when(key % 2 == 0, "A").otherwise("B"))
    base = table(spark, d, "orders").select(
        "o_orderkey",
        (F.col("o_custkey") % 30).alias("k"),
        F.when(key % 3 == 0, "07-A").when(key % 5 != 1, own).alias("code"),
        F.when(key % 11 == 0, key / 64.0).alias("lon"),
    )
    nation = table(spark, d, "nation")
    sides = nation.select(n, F.explode(F.array(F.lit("A"), F.lit("B"))).alias("side"))
    fine = sides.select(
        F.concat(F.lpad(n.cast("string"), 2, "0"), F.lit("-"), "side").alias("fine_code"),
        F.when(n % 4 != 3, n + 0.5).alias("x"),
        F.when(F.col("side") == "A", n - 0.5).alias("y"),
    )
    coarse = nation.select(n, (n + 0.25).alias("x"), (n - 0.25).alias("y"))
    names = {"lon": "x", "lat": "y"}
    levels = [Level(fine, "code", "fine_code", names), Level(coarse, "k", "n_nationkey", names)]
    placed = fallback_lookup(base, levels, join=lambda *side: skew_safe_lookup(*side, hot_rows=500))
    return placed.select("o_orderkey", "lon", "lat")


@case(
    "summary_spine_join",
    """WITH a AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1),
      b AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1),
      c AS (SELECT c_nationkey AS k, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
    SELECT n_name, customers, suppliers, orders FROM nation
    LEFT JOIN a ON a.k = n_nationkey LEFT JOIN b ON b.k = n_nationkey LEFT JOIN c ON c.k = n_nationkey""",
)
def summary_spine(spark, d):
    customer = table(spark, d, "customer")
    orders = table(spark, d, "orders")
    count = lambda name: F.count(F.lit(1)).alias(name)
    sold = equi_join(orders, customer.select("c_custkey", "c_nationkey"), {"o_custkey": "c_custkey"})
    return spine_join(
        table(spark, d, "nation"),
        [
            (customer.groupBy("c_nationkey").agg(count("customers")), {"n_nationkey": "c_nationkey"}),
            (
                table(spark, d, "supplier").groupBy("s_nationkey").agg(count("suppliers")),
                {"n_nationkey": "s_nationkey"},
            ),
            (sold.groupBy("c_nationkey").agg(count("orders")), {"n_nationkey": "c_nationkey"}),
        ],
    ).select("n_name", "customers", "suppliers", "orders")


@case(
    "union_tables",
    """SELECT c_custkey AS id, c_nationkey AS nation, c_mktsegment AS segment, 'customer' AS kind FROM customer
    UNION ALL SELECT s_suppkey, s_nationkey, NULL, 'supplier' FROM supplier
    UNION ALL SELECT n_nationkey, n_nationkey, NULL, 'nation' FROM nation""",
)
def union_tables(spark, d):
    return union_all(
        [
            table(spark, d, "customer").select(
                F.col("c_custkey").alias("id"),
                F.col("c_nationkey").alias("nation"),
                F.col("c_mktsegment").alias("segment"),
                F.lit("customer").alias("kind"),
            ),
            table(spark, d, "supplier").select(
                F.lit("supplier").alias("kind"),
                F.col("s_nationkey").alias("nation"),
                F.col("s_suppkey").alias("id"),
            ),
            table(spark, d, "nation").select(
                F.col("n_nationkey").cast("long").alias("id"),
                F.col("n_nationkey").alias("nation"),
                F.lit("nation").alias("kind"),
            ),
        ]
    )


@case(
    "union_per_state",
    """SELECT c_nationkey AS nation, CAST(c_nationkey % 5 AS INTEGER) AS part, count(*) AS customers
    FROM customer GROUP BY ALL""",
)
def union_per_state(spark, d):
    """One table per state bound together, as the dimension builder does state by state."""
    counts = (
        table(spark, d, "customer")
        .groupBy(F.col("c_nationkey").alias("nation"))
        .agg(F.count(F.lit(1)).alias("customers"))
    )
    return reduce(
        lambda a, b: a.unionByName(b),
        [
            counts.where(F.col("nation") % 5 == p).withColumn("part", F.lit(p))
            for p in range(5)
        ],
    ).select("nation", "part", "customers")


SPARSE = """sparse AS (
  SELECT c_nationkey AS nation, CAST(year(o_orderdate) AS INTEGER) AS sale_year, count(*) AS sales,
    CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS total
  FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE (c_nationkey + year(o_orderdate)) % 3 <> 0 GROUP BY 1, 2)"""


WHOLE = SPARSE.replace("sparse AS", "whole AS").replace("WHERE (c_nationkey + year(o_orderdate)) % 3 <> 0 ", "")


def sparse(spark, d, gaps=True):
    """Orders per nation and year; with gaps, a third of the cells is missing, to be completed or filled."""
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    joined = equi_join(table(spark, d, "orders"), customer, {"o_custkey": "c_custkey"})
    year = F.year("o_orderdate")
    return (
        joined.where(((F.col("c_nationkey") + year) % 3 != 0) | F.lit(not gaps))
        .groupBy(F.col("c_nationkey").alias("nation"), year.alias("sale_year"))
        .agg(
            F.count(F.lit(1)).alias("sales"),
            F.sum(F.floor("o_totalprice").cast("long")).alias("total"),
        )
    )


@case(
    "complete_grid",
    f"""WITH {SPARSE}
    SELECT nation, sale_year, sales, total FROM (SELECT DISTINCT nation FROM sparse)
    CROSS JOIN (SELECT DISTINCT sale_year FROM sparse) LEFT JOIN sparse USING (nation, sale_year)""",
)
def complete_grid(spark, d):
    return complete(sparse(spark, d), ["nation"], "sale_year")


@case(
    "complete_nested",
    f"""WITH {SPARSE}, named AS (SELECT s.*, n_name, n_regionkey FROM sparse s JOIN nation ON nation = n_nationkey)
    SELECT nation, n_name, n_regionkey, sale_year, coalesce(sales, 0) AS sales, total
    FROM (SELECT DISTINCT nation, n_name, n_regionkey FROM named)
    CROSS JOIN (SELECT DISTINCT sale_year FROM named) LEFT JOIN named USING (nation, n_name, n_regionkey, sale_year)""",
)
def complete_nested(spark, d):
    named = equi_join(sparse(spark, d), table(spark, d, "nation"), {"nation": "n_nationkey"})
    return complete(named, ["nation", "n_name", "n_regionkey"], "sale_year", fill={"sales": 0})


@case(
    "balanced_check",
    f"""WITH {SPARSE}
    SELECT count(DISTINCT nation) AS entities, count(DISTINCT sale_year) AS periods, count(*) AS panel_rows,
      count(DISTINCT nation) * count(DISTINCT sale_year) = count(*) AS balanced FROM sparse""",
)
def balanced_check(spark, d):
    return quality.balanced(sparse(spark, d), "nation", "sale_year")


@case(
    "unpivot_long",
    f"""WITH {WHOLE}
    SELECT nation, sale_year, 'sales' AS measure, sales AS amount FROM whole
    UNION ALL SELECT nation, sale_year, 'total', total FROM whole""",
)
def unpivot_long(spark, d):
    return to_long(
        sparse(spark, d, gaps=False), ["nation", "sale_year"], ["sales", "total"], "measure", "amount"
    )


@case(
    "pivot_single",
    """SELECT c_nationkey, max(CASE WHEN s = 'F' THEN n END) AS "F_n", max(CASE WHEN s = 'O' THEN n END) AS "O_n",
      max(CASE WHEN s = 'P' THEN n END) AS "P_n"
    FROM (SELECT c_nationkey, o_orderstatus AS s, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
      GROUP BY 1, 2) GROUP BY 1""",
)
def pivot_one(spark, d):
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    counts = (
        equi_join(table(spark, d, "orders"), customer, {"o_custkey": "c_custkey"})
        .groupBy("c_nationkey", "o_orderstatus")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return pivot_single(counts, ["c_nationkey"], "o_orderstatus", "n", ["F", "O", "P"])


@case(
    "pivot_multi",
    f"""WITH {WHOLE}
    SELECT nation, {", ".join(f'max(CASE WHEN sale_year = {y} THEN sales END) AS sales_{y}, max(CASE WHEN sale_year = {y} THEN total END) AS total_{y}' for y in range(1995, 2002))}
    FROM whole GROUP BY 1""",
)
def pivot_many(spark, d):
    return pivot_multi(
        sparse(spark, d, gaps=False), ["nation"], "sale_year", ["sales", "total"], list(range(1995, 2002))
    )


@case(
    "distinct_rows",
    """SELECT c_nationkey, c_mktsegment, distinct_nations FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)
    CROSS JOIN (SELECT count(DISTINCT c_nationkey) AS distinct_nations FROM customer)""",
)
def distinct_rows(spark, d):
    customer = table(spark, d, "customer")
    size = customer.agg(F.count_distinct("c_nationkey")).scalar()
    return (
        customer.select("c_nationkey", "c_mktsegment")
        .distinct()
        .withColumn("distinct_nations", size)
    )


@case(
    "first_n_distinct",
    "SELECT DISTINCT c_nationkey FROM customer ORDER BY 1 LIMIT 10",
)
def first_n_distinct(spark, d):
    return first_distinct(table(spark, d, "customer"), "c_nationkey", 10)


@case(
    "sorted_report",
    """SELECT n_name, customers, row_number() OVER (ORDER BY customers DESC, region, n_name) AS place
    FROM (SELECT n_name, n_regionkey AS region, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey
      GROUP BY 1, 2)""",
)
def sorted_report(spark, d):
    """A later sort is primary and an earlier one breaks its ties."""
    joined = equi_join(
        table(spark, d, "customer"), table(spark, d, "nation"), {"c_nationkey": "n_nationkey"}
    )
    counted = joined.groupBy("n_name", "n_regionkey").agg(F.count(F.lit(1)).alias("customers"))
    order = [-F.col("customers"), F.col("n_regionkey"), F.col("n_name")]
    placed = running_totals(counted, [], [Running("place", order)])
    return placed.select("n_name", "customers", "place").orderBy("place")


@case(
    "count_reconcile",
    """SELECT (SELECT count(*) FROM orders WHERE o_totalprice > 2000) AS raw_rows, count(*) AS staged_rows,
      (SELECT count(*) FROM orders WHERE o_totalprice > 2000) - count(*) AS missing_rows,
      (SELECT count(*) FROM orders WHERE o_totalprice > 2000) = count(*) AS matches
    FROM orders WHERE o_totalprice > 2000 AND o_orderpriority <> '3-MEDIUM'""",
)
def count_reconcile(spark, d):
    raw = table(spark, d, "orders").where(F.col("o_totalprice") > 2000)
    return quality.reconcile(raw, raw.where(F.col("o_orderpriority") != "3-MEDIUM"))


@case(
    "duplicate_keys",
    "SELECT o_custkey, count(*) AS copies FROM orders GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_keys(spark, d):
    return quality.duplicates(table(spark, d, "orders"), "o_custkey")
