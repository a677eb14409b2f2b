"""Quantiles, distribution tables, box plots, intervals, gap tests and group summaries."""

from pyspark.sql import functions as F

from millgauge.operators import quantiles as q
from millgauge.operators.joins import equi_join
from millgauge.operators.reshape import pivot_multi
from millgauge.operators.summary import summarise, with_ratios, with_totals
from millgauge.operators.ranks import percentile_rank
from millgauge.functions.bins import quantile_of_percentile
from verification.registry import case, shift, steady
from verification.standins import CITIES, ROLL, cities, rates, RATES, roll, table

PRICES = """prices AS (SELECT o_orderkey, o_custkey, c_nationkey AS nation, CAST(year(o_orderdate) AS INTEGER) AS sale_year,
  o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey)"""


def prices(spark, d):
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    joined = equi_join(table(spark, d, "orders"), customer, {"o_custkey": "c_custkey"})
    return joined.select(
        "o_orderkey",
        "o_custkey",
        F.col("c_nationkey").alias("nation"),
        F.year("o_orderdate").alias("sale_year"),
        F.col("o_totalprice").alias("price"),
    )


def rounded(df, digits):
    return df.withColumns({c: steady(c, n) for c, n in digits.items()})


QUANTILE_SQL = f"""WITH {PRICES}
SELECT nation, round(quantile_cont(price, 0.1), 4) AS p10, round(quantile_cont(price, 0.5), 4) AS p50,
  round(quantile_cont(price, 0.99), 4) AS p99, round(quantile_cont(o_custkey, 0.25), 4) AS key25
FROM prices GROUP BY 1"""


def _quantiles(spark, d, **options):
    wanted = {"price": [0.1, 0.5, 0.99], "o_custkey": [0.25]}
    table_ = q.exact_quantiles(prices(spark, d), ["nation"], wanted, **options)
    return table_.select(
        "nation",
        *[F.round(F.col("price")[i], 4).alias(n) for i, n in enumerate(["p10", "p50", "p99"])],
        F.round(F.col("o_custkey")[0], 4).alias("key25"),
    )


@case("exact_quantiles", QUANTILE_SQL)
def exact_quantiles(spark, d):
    return _quantiles(spark, d)


@case("exact_quantiles_heavy", QUANTILE_SQL)
def exact_quantiles_heavy(spark, d):
    """The same quantiles with every nation treated as a heavy group."""
    return _quantiles(spark, d, hot_rows=100)


NULL_QUANTILE_SQL = f"""WITH {PRICES}
SELECT nation, round(quantile_cont(CASE WHEN nation % 5 <> 0 AND o_orderkey % 3 <> 0 THEN price END, 0.3), 4) AS p30
FROM prices GROUP BY 1"""


def _null_quantiles(spark, d, **options):
    gaps = prices(spark, d).withColumn(
        "price", F.when((F.col("nation") % 5 != 0) & (F.col("o_orderkey") % 3 != 0), F.col("price"))
    )
    found = q.exact_quantiles(gaps, ["nation"], {"price": [0.3]}, **options)
    return found.select("nation", F.round(F.col("price")[0], 4).alias("p30"))


@case("exact_quantiles_nulls", NULL_QUANTILE_SQL)
def exact_quantiles_nulls(spark, d):
    """Groups with gaps, and groups without any value, which still have a row."""
    return _null_quantiles(spark, d)


@case("exact_quantiles_nulls_heavy", NULL_QUANTILE_SQL)
def exact_quantiles_nulls_heavy(spark, d):
    return _null_quantiles(spark, d, hot_rows=100)


@case(
    "exact_quantiles_sorted",
    f"""WITH {PRICES}
    SELECT sale_year, round(quantile_cont(price, 0.25), 4) AS p25, round(quantile_cont(price, 0.75), 4) AS p75
    FROM prices GROUP BY 1""",
)
def exact_quantiles_sorted(spark, d):
    out = q.exact_quantiles_sorted(prices(spark, d), ["sale_year"], "price", [0.25, 0.75], 500)
    return out.select(
        "sale_year",
        F.round(F.col("price")[0], 4).alias("p25"),
        F.round(F.col("price")[1], 4).alias("p75"),
    )


@case(
    "distribution_table",
    f"""WITH {PRICES}
    SELECT nation, round(median(price) + 1.37e-05, 4) AS price_median, round(avg(price) + 1.37e-05, 4) AS price_mean,
      round(stddev_samp(price) + 1.37e-05, 4) AS price_sd, round(quantile_cont(price, 0.1) + 1.37e-05, 4) AS price_10pct,
      round(quantile_cont(price, 0.25) + 1.37e-05, 4) AS price_25pct, round(quantile_cont(price, 0.5) + 1.37e-05, 4) AS price_50pct,
      round(quantile_cont(price, 0.75) + 1.37e-05, 4) AS price_75pct, round(quantile_cont(price, 0.9) + 1.37e-05, 4) AS price_90pct,
      round(quantile_cont(price, 0.75) - quantile_cont(price, 0.25) + 1.37e-05, 4) AS iqr_diff75_25,
      round(stddev_samp(price) / avg(price) + 1.37e-09, 8) AS coeff_of_var FROM prices GROUP BY 1""",
)
def distribution_table(spark, d):
    out = q.distribution(prices(spark, d), ["nation"], "price", prefix="price")
    digits = {c: 8 if c == "coeff_of_var" else 4 for c in out.columns if c != "nation"}
    return rounded(out, digits)


@case(
    "boxplot_stats",
    f"""WITH {PRICES}, shown AS (SELECT * FROM prices WHERE price BETWEEN 20000 AND 480000),
    boxes AS (SELECT nation, quantile_cont(price, 0.25) AS q1, median(price) AS m, quantile_cont(price, 0.75) AS q3
      FROM shown GROUP BY 1),
    whiskers AS (SELECT nation, min(price) AS lo, max(price) AS hi FROM shown JOIN boxes USING (nation)
      WHERE price BETWEEN q1 - 0.2 * (q3 - q1) AND q3 + 0.2 * (q3 - q1) GROUP BY 1),
    wide AS (SELECT nation, min(price) AS lo, max(price) AS hi FROM shown JOIN boxes USING (nation)
      WHERE price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1),
    spread AS (SELECT nation, quantile_cont(price, 0.75) - quantile_cont(price, 0.25) AS order_iqr FROM prices GROUP BY 1)
    SELECT nation, round(q1 + 1.37e-05, 4) AS q1, round(m + 1.37e-05, 4) AS median, round(q3 + 1.37e-05, 4) AS q3, wide.lo AS whisker_low,
      wide.hi AS whisker_high, round(order_iqr + 1.37e-05, 4) AS order_iqr
    FROM boxes JOIN wide USING (nation) JOIN spread USING (nation)""",
)
def boxplot_stats(spark, d):
    out = q.boxplot(prices(spark, d), ["nation"], "price", limits=(20000.0, 480000.0))
    return rounded(out, {c: 4 for c in ("q1", "median", "q3", "order_iqr")})


MEDIAN_CI_SQL = f"""{PRICES},
ordered AS (SELECT *, row_number() OVER (PARTITION BY nation, sale_year ORDER BY price) AS r,
  count(*) OVER (PARTITION BY nation, sale_year) AS n FROM prices),
sizes AS (SELECT DISTINCT n FROM ordered),
cdf AS (SELECT n, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2.0::DOUBLE)))
  OVER (PARTITION BY n ORDER BY k) AS p FROM sizes, LATERAL (SELECT unnest(generate_series(0, n)) AS k)),
ks AS (SELECT n, min(k) AS k FROM cdf WHERE p >= 0.05 GROUP BY 1),
ci AS (SELECT nation, sale_year, median(price) AS est,
    max(CASE WHEN r = k THEN price END) AS lo, max(CASE WHEN k > 0 AND r = n - k + 1 THEN price END) AS hi
  FROM ordered JOIN ks USING (n) GROUP BY 1, 2)"""


def _median_ci(spark, d, **options):
    return q.median_ci(prices(spark, d), ["nation", "sale_year"], "price", 0.90, "price", **options)


@case(
    "median_ci",
    f"""WITH {MEDIAN_CI_SQL}
    SELECT nation, sale_year, round(est + 1.37e-05, 4) AS price_est, lo AS price_lo_ci, hi AS price_hi_ci FROM ci""",
)
def median_ci(spark, d):
    return rounded(_median_ci(spark, d), {"price_est": 4})


@case(
    "median_ci_heavy",
    f"""WITH {MEDIAN_CI_SQL}
    SELECT nation, sale_year, round(est + 1.37e-05, 4) AS price_est, lo AS price_lo_ci, hi AS price_hi_ci FROM ci""",
)
def median_ci_heavy(spark, d):
    return rounded(_median_ci(spark, d, hot_rows=40), {"price_est": 4})


@case(
    "statutory_comparison",
    f"""WITH {MEDIAN_CI_SQL}, ref AS (SELECT n_nationkey AS nation, 200000.0::DOUBLE + 3000 * n_nationkey AS statutory
      FROM nation WHERE n_nationkey % 6 <> 0)
    SELECT nation, sale_year, round(est - statutory, 4) AS tax_rate_diff,
      CASE WHEN lo > statutory OR hi < statutory THEN 'Outside CI' ELSE 'Within CI' END AS outside_ci
    FROM ci LEFT JOIN ref USING (nation)""",
)
def statutory_comparison(spark, d):
    n = F.col("n_nationkey")
    ref = table(spark, d, "nation").where(n % 6 != 0).select(
        n, (F.lit(200000.0) + n * 3000).alias("statutory")
    )
    joined = equi_join(_median_ci(spark, d), ref, {"nation": "n_nationkey"}, "left")
    out = q.compare_with_statutory(joined, "statutory", "price")
    return out.select(
        "nation", "sale_year", F.round("tax_rate_diff", 4).alias("tax_rate_diff"), "outside_ci"
    )


QUINTILES_SQL = f"""{PRICES},
placed AS (SELECT *, CAST(ceil(ceil(CAST(row_number() OVER (PARTITION BY nation ORDER BY price DESC, o_orderkey) AS DOUBLE)
  / count(*) OVER (PARTITION BY nation) * 100) / 20) AS INTEGER) AS quintile FROM prices),
stats AS (SELECT nation, quintile, count(*) AS n, avg(price) AS mean, median(price) AS med, stddev_samp(price) AS sd,
  sum(price) / sum(o_custkey) AS rate FROM placed GROUP BY 1, 2),
wide AS (SELECT nation,
  {", ".join(f"max(CASE WHEN quintile = {b} THEN {c} END) AS {c}_{b}" for b in (1, 5) for c in ("n", "mean", "med", "sd", "rate"))}
  FROM stats GROUP BY 1)"""


def _quintile_wide(spark, d):
    ranked = percentile_rank(prices(spark, d), "price", ["nation"], "o_orderkey", "pct")
    rows = ranked.withColumn("quintile", quantile_of_percentile(F.col("pct"), 5))
    stats = rows.groupBy("nation", "quintile").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("price").alias("Price_mean"),
        F.median("price").alias("Price_median"),
        F.stddev_samp("price").alias("Price_std"),
        (F.sum("price") / F.sum("o_custkey")).alias("Price"),
    )
    values = ["count", "Price_mean", "Price_median", "Price_std", "Price"]
    return pivot_multi(stats, ["nation"], "quintile", values, [1, 2, 3, 4, 5])


@case(
    "two_sample_z",
    f"""WITH {QUINTILES_SQL}, t AS (SELECT *, sqrt(sd_5 * sd_5 / n_5 + sd_1 * sd_1 / n_1) AS se FROM wide)
    SELECT nation, round((mean_5 - mean_1) / se + 1.37e-07, 6) AS test_stat_mean, round((med_5 - med_1) / se + 1.37e-07, 6) AS test_stat_med,
      CASE WHEN (mean_5 - mean_1) / se > 1.6448536269514722 THEN 1 ELSE 0 END AS gt_critval_mean,
      CASE WHEN (med_5 - med_1) / se > 1.6448536269514722 THEN 1 ELSE 0 END AS gt_critval_med FROM t""",
)
def two_sample_z(spark, d):
    out = q.two_sample_z(_quintile_wide(spark, d), "5", "1", "Price")
    return rounded(out, {"test_stat_mean": 6, "test_stat_med": 6}).select(
        "nation", "test_stat_mean", "test_stat_med", "gt_critval_mean", "gt_critval_med"
    )


@case(
    "two_sample_z_reversed",
    f"""WITH {QUINTILES_SQL}, t AS (SELECT *, sqrt(sd_5 * sd_5 / n_5 + sd_1 * sd_1 / n_1) AS se FROM wide)
    SELECT nation, round((mean_1 - mean_5) / se + 1.37e-07, 6) AS test_stat_mean,
      CASE WHEN (mean_1 - mean_5) / se > 1.6448536269514722 THEN 1 ELSE 0 END AS gt_critval_mean FROM t""",
)
def two_sample_z_reversed(spark, d):
    out = q.two_sample_z(_quintile_wide(spark, d), "1", "5", "Price")
    return rounded(out, {"test_stat_mean": 6}).select("nation", "test_stat_mean", "gt_critval_mean")


@case(
    "gap_ratio",
    f"""WITH {QUINTILES_SQL}
    SELECT nation, round(mean_5 - mean_1, 4) AS gap_mean, round(med_5 - med_1, 4) AS gap_median,
      round(med_5 / rate_1, 6) AS ratio, round(med_5 / med_1, 8) AS ratio_fixed FROM wide""",
)
def gap_ratio(spark, d):
    out = q.two_sample_z(_quintile_wide(spark, d), "5", "1", "Price")
    return out.select(
        "nation",
        F.round("Price_5_1_diff_mean", 4).alias("gap_mean"),
        F.round("Price_5_1_diff_med", 4).alias("gap_median"),
        F.round("ratio", 6).alias("ratio"),
        F.round("ratio_fixed", 8).alias("ratio_fixed"),
    )


@case(
    "margin_of_error",
    f"""WITH {PRICES}, s AS (SELECT nation, count(*) AS n, avg(price) AS m, stddev_samp(price) AS sd FROM prices GROUP BY 1)
    SELECT nation, round(1.6448536269514722 * sd / sqrt(n), 4) AS moe, round(m - 1.6448536269514722 * sd / sqrt(n), 4) AS lower,
      round(m + 1.6448536269514722 * sd / sqrt(n), 4) AS upper FROM s""",
)
def margin_of_error(spark, d):
    stats = (
        prices(spark, d)
        .groupBy("nation")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.avg("price").alias("price_mean"),
            F.stddev_samp("price").alias("price_std"),
        )
    )
    out = q.margin_of_error(stats, "price")
    return out.select(
        "nation",
        F.round("price_moe", 4).alias("moe"),
        F.round("price_lower", 4).alias("lower"),
        F.round("price_upper", 4).alias("upper"),
    )


@case(
    "effective_rate",
    f"""WITH {ROLL}, sold AS (SELECT o_custkey AS pid, CAST(year(o_orderdate) AS INTEGER) AS y,
        CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100.0::DOUBLE AS price FROM orders GROUP BY 1, 2)
    SELECT "PropertyID" AS property_id, y AS sale_year, round("TaxAmt" / nullif(price, 0), 10) AS rate
    FROM roll JOIN sold ON pid = "PropertyID" AND y = "TaxYear" """,
)
def effective_rate(spark, d):
    sold = (
        table(spark, d, "orders")
        .groupBy(F.col("o_custkey").alias("pid"), F.year("o_orderdate").alias("sale_year"))
        .agg((F.sum(F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long")) / 100.0).alias("price"))
    )
    joined = equi_join(roll(spark, d), sold, {"PropertyID": "pid", "TaxYear": "sale_year"})
    return joined.select(
        F.col("PropertyID").alias("property_id"),
        F.col("TaxYear").alias("sale_year"),
        F.round(F.try_divide("TaxAmt", "price"), 10).alias("rate"),
    )


GROUP_SQL = """lines AS (SELECT l_orderkey AS id, l_suppkey % 10 AS area, l_returnflag AS kind, l_extendedprice AS price,
  CASE WHEN l_quantity > 5 THEN l_quantity END AS qty, CAST(l_discount AS DOUBLE) AS disc FROM lineitem),
g AS (SELECT area, kind, count(*) AS "count", count(DISTINCT id) AS id_nunique, count(price) AS price_notnull,
  count(qty) AS qty_notnull, round(sum(price) + 0.00137, 2) AS price_sum, round(avg(price) + 1.37e-05, 4) AS price_mean,
  round(median(price) + 1.37e-05, 4) AS price_median, round(stddev_samp(price) + 1.37e-05, 4) AS price_std,
  round(avg(qty) + 1.37e-07, 6) AS qty_mean, round(median(qty) + 1.37e-05, 4) AS qty_median, round(stddev_samp(qty) + 1.37e-07, 6) AS qty_std,
  round(median(disc) + 1.37e-07, 6) AS disc_median FROM lines GROUP BY 1, 2)"""


def _group_summary(spark, d, **options):
    lines = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        (F.col("l_suppkey") % 10).alias("area"),
        F.col("l_returnflag").alias("kind"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_quantity") > 5, F.col("l_quantity")).alias("qty"),
        F.col("l_discount").alias("disc"),
    )
    measures = {
        "price": ("sum", "mean", "median", "std"),
        "qty": ("mean", "median", "std"),
        "disc": ("median",),
    }
    out = summarise(lines, ["area", "kind"], "id", measures, ("price", "qty"), **options)
    return rounded(
        out,
        {
            "price_sum": 2,
            "price_mean": 4,
            "price_median": 4,
            "price_std": 4,
            "qty_mean": 6,
            "qty_median": 4,
            "qty_std": 6,
            "disc_median": 6,
        },
    )


@case("group_summary", f"WITH {GROUP_SQL} SELECT * FROM g")
def group_summary(spark, d):
    return _group_summary(spark, d)


@case("group_summary_heavy", f"WITH {GROUP_SQL} SELECT * FROM g")
def group_summary_heavy(spark, d):
    """The same summary with the larger groups on the heavy-group path."""
    return _group_summary(spark, d, hot_rows=2000)


@case(
    "ratio_of_sums",
    f"""WITH {ROLL}, {CITIES}, s AS (
      SELECT city_geoid, "TaxYear" AS tax_year, sum("TaxAmt") AS tax, sum("AssdTotalValue") AS assd,
        sum("MarketTotalValue") AS market, count(*) AS n
      FROM roll JOIN cities ON lpad(CAST(n_nationkey AS VARCHAR), 5, '0') = "FIPS" GROUP BY 1, 2)
    SELECT city_geoid, tax_year, round(tax / market, 8) AS tax_rate, round(assd / market, 8) AS value_ratio,
      round(sum(market) OVER () + {shift(1)}, 1) AS market_total, round(sum(market) OVER (PARTITION BY city_geoid) + {shift(1)}, 1) AS city_total,
      CAST(sum(n) OVER () AS BIGINT) AS count_total FROM s""",
)
def ratio_of_sums(spark, d):
    keyed = cities(spark, d).select(
        "city_geoid", F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("county")
    )
    sums = (
        equi_join(roll(spark, d), keyed, {"FIPS": "county"})
        .withColumn("query", F.lit("roll"))
        .groupBy("query", "city_geoid", F.col("TaxYear").alias("tax_year"))
        .agg(
            F.sum("TaxAmt").alias("TaxAmt_sum"),
            F.sum("AssdTotalValue").alias("AssdTotalValue_HPI2021_Imputed_sum"),
            F.sum("MarketTotalValue").alias("SaleAmt_sum"),
            F.count(F.lit(1)).alias("count"),
        )
    )
    out = with_totals(with_ratios(sums), ["query"], ["city_geoid"])
    return out.select(
        "city_geoid",
        "tax_year",
        F.round("TaxRate", 8).alias("tax_rate"),
        F.round("AssdValue_SaleAmt_Ratio", 8).alias("value_ratio"),
        steady("SaleAmt_Total", 1).alias("market_total"),
        steady("SaleAmt_GeoTotal", 1).alias("city_total"),
        F.col("count_Total").alias("count_total"),
    )


@case(
    "distinct_rates",
    f"WITH {RATES} SELECT DISTINCT place_id, round(tax_rate_median_value, 8) AS rate FROM rates",
)
def distinct_rates(spark, d):
    from millgauge.plans.analysis import distinct_rates as distinct

    out = distinct(rates(spark, d))
    return out.select("place_id", F.round("tax_rate_median_value", 8).alias("rate"))
