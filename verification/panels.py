"""Price-index panels: annual means, smoothing, hierarchy, rebasing."""

from pyspark.sql import functions as F

from millgauge.operators.panel import annualise, coalesce_levels, deflate, loess, rebase
from millgauge.operators.joins import equi_join
from millgauge.plans import dimensions
from verification.registry import case, steady, steady_sql
from verification.standins import QUARTERLY, quarterly_index, table


def loess_sql(source: str, group: str, x: str, y: str, name: str, span: float = 0.75) -> str:
    """Direct local quadratic fit in SQL, as CTEs ending in ``name(group, x, fitted)``."""
    return f"""{name}_pts AS (SELECT {group} AS g, CAST({x} AS DOUBLE) AS x, {y} AS y,
    count(*) OVER (PARTITION BY {group}) AS n FROM {source} WHERE {y} IS NOT NULL),
  {name}_pairs AS (SELECT a.g, a.x AS x0, a.y AS y0, a.n, b.x, b.y, abs(b.x - a.x) AS dist,
    row_number() OVER (PARTITION BY a.g, a.x ORDER BY abs(b.x - a.x)) AS r
    FROM {name}_pts a JOIN {name}_pts b ON a.g IS NOT DISTINCT FROM b.g),
  {name}_reach AS (SELECT g, x0, max(dist) AS h FROM {name}_pairs
    WHERE r <= greatest(least(floor(n * {span} + 1e-5), n), 1) GROUP BY 1, 2),
  {name}_w AS (SELECT p.g, p.x0, p.y0, p.n, (p.x - p.x0) / nullif(h, 0) AS u, p.y,
    CASE WHEN dist / nullif(h, 0) < 1 THEN pow(1 - pow(dist / h, 3), 3) ELSE 0 END AS w
    FROM {name}_pairs p JOIN {name}_reach q ON p.g IS NOT DISTINCT FROM q.g AND p.x0 = q.x0),
  {name}_s AS (SELECT g, x0, max(y0) AS y0, max(n) AS n, count(DISTINCT CASE WHEN w > 0 THEN u END) AS c,
    sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * u * u * u) AS s3, sum(w * u * u * u * u) AS s4,
    sum(w * y) AS t0, sum(w * u * y) AS t1, sum(w * u * u * y) AS t2 FROM {name}_w GROUP BY 1, 2),
  {name} AS (SELECT g, x0 AS x, CASE WHEN n < 4 OR c < 3 THEN y0 ELSE
    (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2))
    / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)) END AS fitted FROM {name}_s)"""


@case(
    "base_period_rebase",
    f"""WITH {QUARTERLY}, y AS (SELECT c_nationkey AS nation, "year", avg(hpi) AS hpi FROM quarterly GROUP BY 1, 2)
    SELECT y.nation, y."year" AS index_year, {steady_sql("y.hpi", 8)} AS hpi, {steady_sql("a.hpi / y.hpi", 8)} AS hpi_index_1998,
      {steady_sql("b.hpi / y.hpi", 8)} AS hpi_index_2000, {steady_sql("100000 * (a.hpi / y.hpi)", 4)} AS deflated
    FROM y LEFT JOIN y a ON a.nation = y.nation AND a."year" = 1998
    LEFT JOIN y b ON b.nation = y.nation AND b."year" = 2000""",
)
def base_period_rebase(spark, d):
    yearly = annualise(quarterly_index(spark, d), ["c_nationkey"], "year", "hpi")
    based = rebase(yearly, "c_nationkey", "year", "hpi", [1998, 2000])
    money = deflate(
        based.withColumn("price", F.lit(100000)), {"deflated": ("price", "hpi_index_1998")}
    )
    return money.select(
        F.col("c_nationkey").alias("nation"),
        F.col("year").alias("index_year"),
        *[steady(c, 8).alias(c) for c in ("hpi", "hpi_index_1998", "hpi_index_2000")],
        steady("deflated", 4).alias("deflated"),
    )


@case(
    "loess_panel",
    f"""WITH {QUARTERLY}, series AS (SELECT c_nationkey AS nation, "year" * 4 + "quarter" AS t,
        CASE WHEN (c_nationkey + "year" + "quarter") % 9 <> 0 THEN hpi END AS hpi FROM quarterly),
      {loess_sql("series", "nation", "t", "hpi", "fit")}
    SELECT g AS nation, CAST(x AS INTEGER) AS t, round(fitted, 7) AS fitted FROM fit""",
)
def loess_panel(spark, d):
    q = quarterly_index(spark, d)
    hidden = (F.col("c_nationkey") + F.col("year") + F.col("quarter")) % 9 == 0
    series = q.select(
        F.col("c_nationkey").alias("nation"),
        (F.col("year") * 4 + F.col("quarter")).alias("t"),
        F.when(~hidden, F.col("hpi")).alias("hpi"),
    )
    fitted = loess(series, ["nation"], "t", {"hpi": "fitted"})
    return fitted.where(F.col("hpi").isNotNull()).select(
        "nation", "t", F.round("fitted", 7).alias("fitted")
    )


@case(
    "index_hierarchy",
    f"""WITH {QUARTERLY}, n AS (SELECT c_nationkey AS nation, "year", avg(hpi) AS v FROM quarterly
        WHERE (c_nationkey + "year") % 4 <> 0 GROUP BY 1, 2),
      r AS (SELECT n_regionkey AS region, "year", avg(hpi) AS v FROM quarterly JOIN nation ON n_nationkey = c_nationkey
        WHERE (n_regionkey + "year") % 3 <> 0 GROUP BY 1, 2),
      w AS (SELECT "year", avg(hpi) AS v FROM quarterly GROUP BY 1)
    SELECT n_nationkey AS nation, w."year" AS index_year, {steady_sql("coalesce(n.v, r.v, w.v)", 8)} AS hpi_index
    FROM nation CROSS JOIN w LEFT JOIN n ON n.nation = n_nationkey AND n."year" = w."year"
    LEFT JOIN r ON r.region = n_regionkey AND r."year" = w."year" """,
)
def index_hierarchy(spark, d):
    q = quarterly_index(spark, d)
    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    q = equi_join(q, nation, {"c_nationkey": "n_nationkey"}).withColumnRenamed(
        "c_nationkey", "nation"
    )
    fine = annualise(
        q.where((F.col("nation") + F.col("year")) % 4 != 0), ["nation"], "year", "hpi", "fine"
    )
    middle = annualise(
        q.where((F.col("n_regionkey") + F.col("year")) % 3 != 0),
        ["n_regionkey"],
        "year",
        "hpi",
        "middle",
    )
    world = annualise(q, [], "year", "hpi", "world")
    years = world.agg(F.collect_list("year")).scalar()
    grid = nation.withColumn("year", F.explode(years))
    joined = equi_join(grid, fine, {"n_nationkey": "nation", "year": "year"}, "left")
    joined = equi_join(joined, middle, ["n_regionkey", "year"], "left")
    joined = equi_join(joined, world, ["year"], "left")
    return coalesce_levels(joined, ["fine", "middle", "world"], "hpi_index").select(
        F.col("n_nationkey").alias("nation"),
        F.col("year").alias("index_year"),
        steady("hpi_index", 8).alias("hpi_index"),
    )


def counties(spark, d):
    """Nations as counties, regions as states, three nations in four in a metro area."""
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    state = F.lpad(r.cast("string"), 2, "0")
    return table(spark, d, "nation").select(
        F.concat(state, F.lpad(n.cast("string"), 3, "0")).alias("county_fips"),
        state.alias("state_fips"),
        F.concat(F.lit("S"), r.cast("string")).alias("state_codes"),
        F.when(n % 4 != 0, F.concat(F.lit("M"), (n % 7).cast("string")))
        .otherwise(F.concat(F.lit("state_"), state))
        .alias("cbsa_fips"),
        n.alias("nation"),
        r.alias("region"),
    )


COUNTIES = """counties AS (SELECT lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS county_fips,
  lpad(CAST(n_regionkey AS VARCHAR), 2, '0') AS state_fips, 'S' || n_regionkey AS state_codes,
  CASE WHEN n_nationkey % 4 <> 0 THEN 'M' || (n_nationkey % 7) ELSE 'state_' || lpad(CAST(n_regionkey AS VARCHAR), 2, '0') END AS cbsa_fips,
  n_nationkey AS nation, n_regionkey AS region FROM nation)"""

PANEL_SQL = f"""{QUARTERLY}, {COUNTIES},
raw AS (SELECT * FROM quarterly JOIN counties ON nation = c_nationkey),
c0 AS (SELECT county_fips, "year", CASE WHEN (nation + "year") % 5 <> 0 THEN round(avg(hpi), 3) END AS hpi_county FROM raw
  WHERE nation % 8 <> 3 AND "year" >= 1996 GROUP BY county_fips, "year", nation),
c1 AS (SELECT * FROM c0 UNION ALL SELECT county_fips, 2003, NULL FROM counties),
years AS (SELECT DISTINCT "year" FROM c1),
grid AS (SELECT c.county_fips, c.cbsa_fips, c.state_fips, y."year", c1.hpi_county FROM counties c CROSS JOIN years y
  LEFT JOIN c1 ON c1.county_fips = c.county_fips AND c1."year" = y."year"),
metro AS (SELECT cbsa_fips, "year", avg(v) AS hpi_metro FROM (SELECT cbsa_fips, "year", "quarter",
    CASE WHEN ("quarter" + "year") % 4 <> 0 THEN round(avg(hpi), 3) END AS v FROM raw WHERE nation % 4 <> 0 GROUP BY 1, 2, 3)
  WHERE "year" >= 1996 GROUP BY 1, 2),
nonmetro AS (SELECT state_fips, "year", avg(v) AS hpi_nonmetro FROM (SELECT state_fips, "year", "quarter", avg(hpi) AS v
    FROM raw WHERE nation % 4 = 0 AND region <> 2 GROUP BY 1, 2, 3) WHERE "year" >= 1996 GROUP BY 1, 2),
state AS (SELECT state_fips, "year", avg(v) AS hpi_state FROM (SELECT state_fips, "year", "quarter", avg(hpi) AS v
    FROM raw WHERE "year" <> 1999 GROUP BY 1, 2, 3) WHERE "year" >= 1996 GROUP BY 1, 2),
levels AS (SELECT g.*, s.hpi_state, n.hpi_nonmetro, m.hpi_metro FROM grid g
  LEFT JOIN state s ON s.state_fips = g.state_fips AND s."year" = g."year"
  LEFT JOIN nonmetro n ON n.state_fips = g.state_fips AND n."year" = g."year"
  LEFT JOIN metro m ON m.cbsa_fips = g.cbsa_fips AND m."year" = g."year"),
filled AS (SELECT county_fips, "year", {", ".join(f'''coalesce(
    last_value({c} IGNORE NULLS) OVER (PARTITION BY county_fips ORDER BY "year" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value({c} IGNORE NULLS) OVER (PARTITION BY county_fips ORDER BY "year" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}'''
    for c in dimensions.LEVELS)} FROM levels),
{", ".join(loess_sql("filled", "county_fips", '"year"', c, f"fit_{c}") for c in dimensions.LEVELS)},
smoothed AS (SELECT l.county_fips, l."year", coalesce(
    {", ".join(f"coalesce(l.{c}, f_{c}.fitted)" for c in dimensions.LEVELS)}) AS hpi_index FROM levels l
  {" ".join(f'LEFT JOIN fit_{c} f_{c} ON f_{c}.g = l.county_fips AND f_{c}.x = l."year"' for c in dimensions.LEVELS)})"""


def panel_levels(spark, d):
    listed = counties(spark, d)
    raw = equi_join(
        quarterly_index(spark, d), listed, {"c_nationkey": "nation"}
    ).withColumnRenamed("c_nationkey", "nation")
    year, quarter = F.col("year"), F.col("quarter")
    county = (
        raw.where(F.col("nation") % 8 != 3)
        .groupBy("county_fips", "year", "nation")
        .agg(F.round(F.avg("hpi"), 3).alias("v"))
        .select(
            "county_fips",
            "year",
            F.when((F.col("nation") + year) % 5 == 0, ".")
            .otherwise(F.col("v").cast("string"))
            .alias("hpi"),
        )
    )
    metro = (
        raw.where(F.col("nation") % 4 != 0)
        .groupBy(F.col("cbsa_fips").alias("fips"), "year", "quarter")
        .agg(F.round(F.avg("hpi"), 3).alias("v"))
        .select(
            "fips",
            "year",
            F.when((quarter + year) % 4 == 0, "-").otherwise(F.col("v").cast("string")).alias("index"),
        )
    )
    nonmetro = (
        raw.where((F.col("nation") % 4 == 0) & (F.col("region") != 2))
        .groupBy(F.col("state_codes").alias("state"), "year", "quarter")
        .agg(F.avg("hpi").alias("index"))
    )
    state = (
        raw.where(year != 1999)
        .groupBy(F.col("state_codes").alias("state_code"), "year", "quarter")
        .agg(F.avg("hpi").alias("index"))
    )
    return dimensions.index_levels(listed, county, metro, nonmetro, state, 1996, 2003)


@case(
    "index_levels",
    f"""WITH {PANEL_SQL}
    SELECT county_fips, state_fips, cbsa_fips, "year" AS index_year, {", ".join(f"round({c}, 6) AS {c}" for c in dimensions.LEVELS)} FROM levels""",
)
def index_levels(spark, d):
    return panel_levels(spark, d).select(
        "county_fips",
        "state_fips",
        "cbsa_fips",
        F.col("year").alias("index_year"),
        *[F.round(c, 6).alias(c) for c in dimensions.LEVELS],
    )


@case(
    "county_index",
    f"""WITH {PANEL_SQL}
    SELECT s.county_fips, s."year" AS index_year, round(a.hpi_index / s.hpi_index, 7) AS hpi_index_2001,
      round(b.hpi_index / s.hpi_index, 7) AS hpi_index_1998
    FROM smoothed s LEFT JOIN smoothed a ON a.county_fips = s.county_fips AND a."year" = 2001
    LEFT JOIN smoothed b ON b.county_fips = s.county_fips AND b."year" = 1998""",
)
def county_index(spark, d):
    """The whole index build: four levels, fills, smoothing, fallback, rebasing."""
    out = dimensions.county_index(panel_levels(spark, d), (2001, 1998))
    return out.select(
        "county_fips",
        F.col("year").alias("index_year"),
        F.round("hpi_index_2001", 7).alias("hpi_index_2001"),
        F.round("hpi_index_1998", 7).alias("hpi_index_1998"),
    )
