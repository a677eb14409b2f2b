"""Recency ranks, percentiles, tiles, modal periods, shares and fills."""

from pyspark.sql import functions as F

from millgauge.functions import bins
from millgauge.operators import ranks
from millgauge.operators.heavy import Running, running_totals
from millgauge.operators.joins import equi_join
from millgauge.operators.quality import dedupe
from millgauge.operators.quantiles import interquartile_range
from millgauge.operators.recency import recency_ranks
from millgauge.operators.reshape import complete
from millgauge.plans import etl
from verification.registry import case
from verification.relations import SPARSE, sparse
from verification.standins import DEEDS, MIN_YEAR, RANKED, RATES, deeds, rates, table

RANK_SQL = f"""WITH {DEEDS}
SELECT "FATransactionID" AS sale_id,
  row_number() OVER (PARTITION BY "RecordingYear", "PropertyID"
    ORDER BY "RecordingDate" DESC, "FATransactionID") AS recent_in_year,
  row_number() OVER (PARTITION BY "PropertyID"
    ORDER BY "RecordingDate" DESC, "FATransactionID") AS most_recent
FROM deeds"""


def _recency(spark, d, **options):
    ranked = recency_ranks(
        deeds(spark, d),
        "PropertyID",
        "RecordingYear",
        "RecordingDate",
        "FATransactionID",
        "recent_in_year",
        "most_recent",
        **options,
    )
    return ranked.select(F.col("FATransactionID").alias("sale_id"), "recent_in_year", "most_recent")


@case("recency_rank", RANK_SQL)
def recency_rank(spark, d):
    return _recency(spark, d)


@case("recency_rank_heavy", RANK_SQL)
def recency_rank_heavy(spark, d):
    """The same ranks with every property of more than ten deeds treated as heavy."""
    return _recency(spark, d, hot_rows=10)


STAMPED_SQL = """WITH stamped AS (SELECT *, CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS BIGINT)) AS seen,
  o_orderkey % 3 AS batch FROM orders)
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, batch ORDER BY seen DESC, o_orderkey) AS in_batch,
  row_number() OVER (PARTITION BY o_custkey ORDER BY seen DESC, o_orderkey) AS over_all FROM stamped"""


def _stamped(spark, d, **options):
    seen = F.to_timestamp("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    orders = table(spark, d, "orders").withColumns({"seen": seen, "batch": F.col("o_orderkey") % 3})
    ranked = recency_ranks(orders, "o_custkey", "batch", "seen", "o_orderkey", "in_batch", "over_all", **options)
    return ranked.select("o_orderkey", "in_batch", "over_all")


@case("recency_rank_timestamp", STAMPED_SQL)
def recency_rank_timestamp(spark, d):
    """Ranks by time of day, inside periods that do not follow from the time."""
    return _stamped(spark, d)


@case("recency_rank_timestamp_heavy", STAMPED_SQL)
def recency_rank_timestamp_heavy(spark, d):
    return _stamped(spark, d, hot_rows=5)


@case(
    "recency_rank_undated",
    """SELECT o_orderkey, CASE WHEN day IS NOT NULL THEN row_number() OVER (PARTITION BY o_custkey
      ORDER BY day DESC NULLS LAST, o_orderkey) END AS most_recent
    FROM (SELECT *, CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders)""",
)
def recency_rank_undated(spark, d):
    orders = table(spark, d, "orders").withColumn(
        "day", F.when(F.col("o_orderkey") % 6 != 0, F.to_date("o_orderdate"))
    )
    ranked = ranks.recency_rank(orders, ["o_custkey"], "day", "o_orderkey", "most_recent")
    return ranked.select("o_orderkey", "most_recent")


@case(
    "latest_qualifying_sale",
    f"""WITH {DEEDS}, {RANKED}
    SELECT "PropertyID" AS property_id, "SaleRecordingYear" AS sale_year, "FATransactionID" AS sale_id,
      "SaleAmt" AS price FROM ranked""",
)
def latest_qualifying_sale(spark, d):
    """Only the newest deed per property and year, dropped when it does not qualify."""
    recent = etl.flag_sales(deeds(spark, d)).where(F.col("RecordingYear") >= MIN_YEAR)
    top = ranks.latest(
        recent,
        ["PropertyID", "RecordingYear"],
        "RecordingDate",
        "FATransactionID",
        F.col("SaleFlag") == 1,
    )
    return top.select(
        F.col("PropertyID").alias("property_id"),
        F.col("SaleRecordingYear").cast("int").alias("sale_year"),
        F.col("FATransactionID").alias("sale_id"),
        F.col("SaleAmt").alias("price"),
    )


PERCENTILE_SQL = """SELECT o_orderkey, CAST(ceil(CAST(row_number() OVER (PARTITION BY year(o_orderdate), o_orderpriority
    ORDER BY o_totalprice DESC, o_orderkey) AS DOUBLE)
    / count(*) OVER (PARTITION BY year(o_orderdate), o_orderpriority) * 100) AS INTEGER) AS pct FROM orders"""


def _percentile(spark, d, **options):
    orders = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    return ranks.percentile_rank(
        orders, "o_totalprice", ["y", "o_orderpriority"], "o_orderkey", "pct", **options
    )


@case("percentile_rank", PERCENTILE_SQL)
def percentile_rank(spark, d):
    return _percentile(spark, d).select("o_orderkey", "pct")


@case("percentile_rank_heavy", PERCENTILE_SQL)
def percentile_rank_heavy(spark, d):
    """The same percentiles with every group of more than 100 rows sliced."""
    return _percentile(spark, d, hot_rows=100).select("o_orderkey", "pct")


@case(
    "outlier_trim",
    f"""SELECT o_orderkey, pct, CASE WHEN pct <= 2 OR pct >= 99 THEN 'Tails' ELSE 'Middle 96%' END AS band
    FROM ({PERCENTILE_SQL}) WHERE pct > 2 AND pct < 99""",
)
def outlier_trim(spark, d):
    labelled = _percentile(spark, d).withColumn("band", bins.tail_band(F.col("pct")))
    return labelled.where(F.col("band") == "Middle 96%").select("o_orderkey", "pct", "band")


@case(
    "decile_quintile",
    f"""SELECT o_orderkey, CAST(ceil(pct / 10.0) AS INTEGER) AS decile, CAST(ceil(pct / 20.0) AS INTEGER) AS quintile
    FROM ({PERCENTILE_SQL})""",
)
def decile_quintile(spark, d):
    return _percentile(spark, d).select(
        "o_orderkey",
        bins.quantile_of_percentile(F.col("pct"), 10).alias("decile"),
        bins.quantile_of_percentile(F.col("pct"), 5).alias("quintile"),
    )


def _with_nation(spark, d):
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return equi_join(table(spark, d, "orders"), customer, {"o_custkey": "c_custkey"})


@case(
    "rank_quartile",
    """WITH spread AS (SELECT c_nationkey, round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 4) AS iqr
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
    placed AS (SELECT *, dense_rank() OVER (ORDER BY iqr) AS iqr_rank FROM spread)
    SELECT *, CASE WHEN iqr_rank <= 6 THEN 1 WHEN iqr_rank <= 12 THEN 2 WHEN iqr_rank <= 18 THEN 3 ELSE 4 END AS iqr_quartile
    FROM placed""",
)
def rank_quartile(spark, d):
    spread = interquartile_range(_with_nation(spark, d), ["c_nationkey"], "o_totalprice", "iqr")
    placed = ranks.dense_rank_values(spread.withColumn("iqr", F.round("iqr", 4)), "iqr", "iqr_rank")
    return placed.withColumn("iqr_quartile", bins.rank_quartile(F.col("iqr_rank"), (6, 12, 18)))


@case(
    "group_total_share",
    """WITH per AS (SELECT c_nationkey, c_mktsegment, count(*) AS customers FROM customer GROUP BY 1, 2)
    SELECT c_custkey, CAST(sum(1) OVER (PARTITION BY c_nationkey) AS BIGINT) AS nation_total,
      CAST(count(*) OVER () AS BIGINT) AS grand_total,
      round(CAST(count(*) OVER (PARTITION BY c_nationkey) AS DOUBLE) / count(*) OVER (), 8) AS share
    FROM customer""",
)
def group_total_share(spark, d):
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    totals = ranks.group_total(customer, ["c_nationkey"], F.count(F.lit(1)), "nation_total")
    grand = customer.agg(F.count(F.lit(1))).scalar()
    return totals.withColumn("grand_total", grand).select(
        "c_custkey",
        "nation_total",
        "grand_total",
        F.round(F.col("nation_total") / F.col("grand_total"), 8).alias("share"),
    )


MODAL = """per AS (SELECT c_nationkey AS nation, CAST(year(o_orderdate) AS INTEGER) AS sale_year, count(*) // 40 AS sales
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def _per_year(spark, d):
    return (
        _with_nation(spark, d)
        .groupBy(F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("sale_year"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("sales", F.expr("n div 40"))
    )


@case(
    "modal_year_dense",
    f"""WITH {MODAL}
    SELECT nation, sale_year, sales AS period_total FROM
      (SELECT *, dense_rank() OVER (PARTITION BY nation ORDER BY sales DESC) AS r FROM per) WHERE r = 1 AND sales > 1""",
)
def modal_year_dense(spark, d):
    per = _per_year(spark, d)
    return ranks.modal_period(per, ["nation"], "sale_year", "dense", F.col("sales"), 1)


@case(
    "modal_year_rownum",
    f"""WITH {MODAL}
    SELECT nation, sale_year, sales AS period_total FROM
      (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY sales DESC, sale_year) AS r FROM per) WHERE r = 1 AND sales > 0""",
)
def modal_year_rownum(spark, d):
    per = _per_year(spark, d)
    return ranks.modal_period(per, ["nation"], "sale_year", "first", F.col("sales"))


@case(
    "modal_year_rows",
    """WITH o AS (SELECT *, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders JOIN customer ON o_custkey = c_custkey),
      r AS (SELECT c_nationkey, y, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC) AS place
        FROM o GROUP BY 1, 2)
    SELECT o_orderkey, y FROM o JOIN r USING (c_nationkey, y) WHERE place = 1""",
)
def modal_year_rows(spark, d):
    rows = _with_nation(spark, d).withColumn("y", F.year("o_orderdate"))
    return ranks.keep_modal_period(rows, ["c_nationkey"], "y").select("o_orderkey", "y")


@case(
    "dedupe_first",
    f"""WITH {RATES}
    SELECT place_id, table_group, tax_rate_150k FROM
      (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY table_order) AS r FROM rates) WHERE r = 1""",
)
def dedupe_first(spark, d):
    first = dedupe(rates(spark, d), ["place_id"], [F.col("table_order").asc()])
    return first.select("place_id", "table_group", "tax_rate_150k")


CITY_RANK_SQL = """SELECT c_custkey, CASE WHEN balance IS NOT NULL THEN
    row_number() OVER (ORDER BY balance DESC NULLS LAST, c_custkey) END AS place
  FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal END AS balance FROM customer)"""


def _city_rank(spark, d, **options):
    customer = table(spark, d, "customer").withColumn(
        "balance", F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal"))
    )
    ranked = ranks.global_rank(customer, "balance", "c_custkey", "place", **options)
    return ranked.select("c_custkey", "place")


@case("city_rank", CITY_RANK_SQL)
def city_rank(spark, d):
    return _city_rank(spark, d)


@case("city_rank_heavy", CITY_RANK_SQL)
def city_rank_heavy(spark, d):
    """The same table-wide rank from slices of about 200 rows."""
    return _city_rank(spark, d, hot_rows=200)


NTILE_SQL = """SELECT o_orderkey, CASE WHEN price IS NOT NULL THEN CAST(tile AS INTEGER) END AS tile FROM
  (SELECT o_orderkey, price, ntile(5) OVER (PARTITION BY price IS NULL, c_nationkey ORDER BY price, o_orderkey) AS tile
   FROM (SELECT *, CASE WHEN o_orderkey % 50 <> 0 THEN o_totalprice END AS price
     FROM orders JOIN customer ON o_custkey = c_custkey))"""


def _ntile(spark, d, **options):
    rows = _with_nation(spark, d).withColumn(
        "price", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_totalprice"))
    )
    tiled = ranks.ntile(rows, "price", 5, ["c_nationkey"], "o_orderkey", "tile", **options)
    return tiled.select("o_orderkey", "tile")


@case("ntile_price", NTILE_SQL)
def ntile_price(spark, d):
    return _ntile(spark, d)


@case("ntile_price_heavy", NTILE_SQL)
def ntile_price_heavy(spark, d):
    return _ntile(spark, d, hot_rows=150)


@case(
    "fill_downup",
    f"""WITH {SPARSE}, grid AS (
      SELECT nation, sale_year, sales, total FROM (SELECT DISTINCT nation FROM sparse)
      CROSS JOIN (SELECT DISTINCT sale_year FROM sparse) LEFT JOIN sparse USING (nation, sale_year))
    SELECT nation, sale_year, coalesce(
        last_value(sales IGNORE NULLS) OVER (PARTITION BY nation ORDER BY sale_year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(sales IGNORE NULLS) OVER (PARTITION BY nation ORDER BY sale_year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS sales_fill,
      coalesce(
        last_value(total IGNORE NULLS) OVER (PARTITION BY nation ORDER BY sale_year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(total IGNORE NULLS) OVER (PARTITION BY nation ORDER BY sale_year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS total_fill
    FROM grid""",
)
def fill_downup(spark, d):
    grid = complete(sparse(spark, d), ["nation"], "sale_year")
    filled = ranks.fill_down_up(
        grid, ["nation"], "sale_year", {"sales": "sales_fill", "total": "total_fill"}
    )
    return filled.select("nation", "sale_year", "sales_fill", "total_fill")


WEIGHTS_SQL = """weights AS (SELECT c_custkey // 3 AS tract, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
  GROUP BY 1),
  run AS (SELECT tract, n, sum(n) OVER (ORDER BY tract ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER () AS total FROM weights)"""


def _tracts(spark, d):
    return (
        table(spark, d, "orders")
        .groupBy(F.expr("o_custkey div 3").alias("tract"), "o_custkey")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@case(
    "weighted_qcut",
    f"""WITH {WEIGHTS_SQL}
    SELECT tract, n, (SELECT CAST(max(k) AS INTEGER) FROM range(0, 7) e(k) WHERE k * (1.0::DOUBLE / 7) < CAST(upto AS DOUBLE) / total) AS partition_index FROM run""",
)
def weighted_qcut(spark, d):
    return bins.weighted_qcut(_tracts(spark, d), "tract", "n", 7)


@case(
    "weighted_qcut_heavy",
    f"""WITH {WEIGHTS_SQL}
    SELECT tract, n, (SELECT CAST(max(k) AS INTEGER) FROM range(0, 7) e(k) WHERE k * (1.0::DOUBLE / 7) < CAST(upto AS DOUBLE) / total) AS partition_index FROM run""",
)
def weighted_qcut_heavy(spark, d):
    return bins.weighted_qcut(_tracts(spark, d), "tract", "n", 7, hot_rows=60)


@case(
    "weighted_cut_breaks",
    f"""WITH {WEIGHTS_SQL}, s AS (SELECT *, CAST(upto AS DOUBLE) / total AS share FROM run)
    SELECT tract, n, CASE WHEN share > 0.1 AND share <= 0.5 THEN 0 WHEN share > 0.5 AND share <= 0.9 THEN 1 END AS partition_index
    FROM s""",
)
def weighted_cut_breaks(spark, d):
    return bins.weighted_qcut(_tracts(spark, d), "tract", "n", [0.1, 0.5, 0.9])


@case(
    "chunk_plan",
    f"""WITH {WEIGHTS_SQL}, p AS (
      SELECT tract, n, (SELECT CAST(max(k) AS INTEGER) FROM range(0, 100000) e(k) WHERE k < ceil(total / 500.0) AND k * (1.0::DOUBLE / ceil(total / 500.0)) < CAST(upto AS DOUBLE) / total) AS partition_index FROM run)
    SELECT partition_index, count(*) AS tracts, min(tract) AS first_tract, max(tract) AS last_tract FROM p GROUP BY 1""",
)
def chunk_plan(spark, d):
    """Chunks of at most about 500 rows each, with their list of keys."""
    plan = bins.weighted_qcut(_tracts(spark, d), "tract", "n", per_group=500)
    return bins.chunk_keys(plan, "tract").select(
        "partition_index",
        F.size("keys").cast("long").alias("tracts"),
        F.element_at("keys", 1).alias("first_tract"),
        F.element_at("keys", -1).alias("last_tract"),
    )


@case(
    "running_total",
    """SELECT o_orderkey, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_orderstatus
        ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto,
      CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS total FROM orders""",
)
def running_total(spark, d):
    orders = table(spark, d, "orders")
    spec = Running(
        "upto",
        [F.unix_date(F.to_date("o_orderdate")), F.col("o_orderkey")],
        F.floor("o_totalprice").cast("long"),
        "total",
    )
    return running_totals(orders, ["o_orderstatus"], [spec], hot_rows=1000).select(
        "o_orderkey", "upto", "total"
    )
