"""Scans, filters, cleaning expressions, recodes and bands."""

from pyspark.sql import functions as F, types as T

from millgauge.functions import bins, clean
from millgauge.operators.reshape import with_category_order
from millgauge.sources.delimited import read_delimited
from millgauge.sources.staged import scratch
from verification.registry import case
from verification.standins import ELEVEN_SQL, NARROW_SQL, WIDE_SQL, spread, table


@case(
    "scan_project_filter",
    """SELECT o_orderkey AS sale_id, o_custkey AS property_id, o_totalprice AS price,
      CASE WHEN o_totalprice BETWEEN 10000 AND 300000 THEN o_totalprice END AS price_in_range,
      'order' AS kind
    FROM orders
    WHERE (year(o_orderdate) >= 1999 OR o_orderpriority = '1-URGENT')
      AND o_totalprice > 2000 AND o_totalprice <= 450000 AND o_custkey IS NOT NULL""",
)
def scan_project_filter(spark, d):
    orders = table(spark, d, "orders")
    return (
        orders.where(
            (F.year("o_orderdate") >= 1999) | (F.col("o_orderpriority") == "1-URGENT")
        )
        .where(
            (F.col("o_totalprice") > 2000)
            & (F.col("o_totalprice") <= 450000)
            & F.col("o_custkey").isNotNull()
        )
        .drop("o_orderstatus", "o_orderpriority", "o_orderdate")
        .withColumnsRenamed(
            {"o_orderkey": "sale_id", "o_custkey": "property_id", "o_totalprice": "price"}
        )
        .withColumns(
            {
                "price_in_range": clean.in_range(F.col("price"), 10000, 300000),
                "kind": F.lit("order"),
            }
        )
    )


RAW = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("nation", T.IntegerType()),
        T.StructField("balance", T.StringType()),
    ]
)


@case(
    "raw_delimited_ingest",
    """SELECT s_suppkey AS id, s_name AS name,
      CASE WHEN s_suppkey % 7 IN (0, 2) THEN NULL ELSE nullif(s_nationkey, 0) END AS nation,
      CASE WHEN s_suppkey % 7 IN (0, 4) THEN NULL
        WHEN s_suppkey % 7 = 3 THEN CAST(1234000 + s_suppkey AS DOUBLE)
        ELSE CAST(CAST(floor(s_acctbal) AS BIGINT) AS DOUBLE) END AS balance,
      s_suppkey % 7 <= 2 AS ragged
    FROM supplier""",
)
def raw_delimited_ingest(spark, d):
    """Short rows, long rows, bad cells, missing markers and grouped digits survive the read."""
    k = F.col("s_suppkey")
    money = (
        F.when(k % 7 == 4, "-")
        .when(k % 7 == 3, F.format_number((F.lit(1234000) + k).cast("double"), 0))
        .otherwise(F.floor("s_acctbal").cast("string"))
    )
    nation = F.when(k % 7 == 2, "n/a").otherwise(F.col("s_nationkey").cast("string"))
    line = F.when(k % 7 == 0, F.concat_ws("|", k.cast("string"), "s_name")).otherwise(
        F.concat_ws("|", k.cast("string"), F.col("s_name"), nation, money)
    )
    line = F.when(k % 7 == 1, F.concat(line, F.lit("|extra|fields"))).otherwise(line)
    path = scratch(spark, "ragged")
    table(spark, d, "supplier").select(line.alias("value")).write.text(path)
    rows = read_delimited(spark, path, RAW, header=False, report_bad=True)
    return rows.select(
        "id",
        "name",
        clean.sentinel_null(F.col("nation"), 0).alias("nation"),
        clean.grouped_number(F.col("balance")).alias("balance"),
        F.col("_corrupt_record").isNotNull().alias("ragged"),
    )


@case(
    "clean_codes_flags",
    """WITH raw AS (
      SELECT *, CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE CAST(l_suppkey AS VARCHAR) END AS code,
        strftime(l_shipdate, '%Y%m%d') AS day
      FROM lineitem)
    SELECT l_orderkey, l_linenumber,
      CASE WHEN l_returnflag IN ('R') THEN true END AS returned,
      CASE WHEN l_linestatus = 'O' THEN true WHEN l_linestatus = 'F' THEN false END AS open,
      CASE WHEN l_linenumber IN (1, 2, 3, 4) THEN CAST(l_linenumber AS VARCHAR) END AS line_code,
      CASE WHEN l_returnflag IN ('A', 'R') AND l_linestatus IN ('F') THEN 1 ELSE 0 END AS qualifies,
      CASE WHEN length(code) < 2 THEN lpad(code, 2, '0') ELSE code END AS padded,
      substr(day, 1, 4) AS year_slice,
      coalesce(CAST(l_orderkey AS VARCHAR) || '_' || code, CAST(l_orderkey AS VARCHAR)) AS joined,
      strftime(CASE WHEN l_partkey % 5 <> 1 THEN CAST(l_shipdate AS DATE) END, '%Y-%m-%d') AS ship_day,
      CAST(CASE WHEN l_partkey % 5 <> 1 THEN year(l_shipdate) END AS INTEGER) AS ship_year,
      l_quantity / 100 AS quantity_hundreds,
      CASE WHEN l_partkey % 3 <> 0 THEN CAST(l_linenumber AS INTEGER) END AS line_number
    FROM raw""",
)
def clean_codes_flags(spark, d):
    lines = table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_returnflag",
        "l_linestatus",
        "l_quantity",
        "l_suppkey",
        "l_partkey",
        "l_shipdate",
    )
    raw = spread(lines)
    day = F.date_format("l_shipdate", "yyyyMMdd")
    part = F.col("l_partkey") % 5
    raw = raw.select(
        "l_orderkey",
        "l_linenumber",
        "l_returnflag",
        "l_linestatus",
        "l_quantity",
        F.when(F.col("l_suppkey") % 9 != 0, F.col("l_suppkey").cast("string")).alias("code"),
        day.alias("day"),
        F.when(part == 0, F.concat(F.lit("x"), day, F.lit("y")))
        .when(part == 1, F.concat(F.substring(day, 1, 6), F.lit("00")))
        .otherwise(day)
        .alias("raw_day"),
        F.when(F.col("l_partkey") % 3 == 0, F.lit("n/a"))
        .otherwise(F.col("l_linenumber").cast("string"))
        .alias("raw_number"),
    )
    c = F.col
    out = raw.withColumns(
        {
            "returned": clean.flag(c("l_returnflag"), ["R"]),
            "open": clean.tri_flag(c("l_linestatus"), "O", "F"),
            "line_code": clean.domain(c("l_linenumber"), ["1", "2", "3", "4"]),
            "qualifies": F.when(
                c("l_returnflag").isin("A", "R") & c("l_linestatus").isin("F"), 1
            ).otherwise(0),
            "padded": clean.pad_left(c("code"), 2),
            "year_slice": F.substring("day", 1, 4),
            "joined": clean.concat_or_first(c("l_orderkey"), c("code")),
            "_day": clean.parse_yyyymmdd(c("raw_day")),
            "quantity_hundreds": c("l_quantity") / 100,
            "line_number": c("raw_number").try_cast("int"),
        }
    )
    return out.select(
        "l_orderkey",
        "l_linenumber",
        "returned",
        "open",
        "line_code",
        "qualifies",
        "padded",
        "year_slice",
        "joined",
        F.date_format("_day", "yyyy-MM-dd").alias("ship_day"),
        F.year("_day").alias("ship_year"),
        "quantity_hundreds",
        "line_number",
    )


@case(
    "coalesce_impute",
    """WITH raw AS (
      SELECT o_orderkey, o_totalprice,
        CASE WHEN o_custkey % 5 = 0 THEN 0.0::DOUBLE WHEN o_custkey % 7 <> 0 THEN o_totalprice * 0.75::DOUBLE END AS assd,
        CASE WHEN o_custkey % 3 <> 0 THEN o_totalprice * 1.5::DOUBLE END AS market
      FROM orders)
    SELECT o_orderkey, coalesce(market, 0.0::DOUBLE) AS market_or_zero,
      coalesce(assd, market, o_totalprice) AS first_value,
      CASE WHEN (assd = 0 OR assd IS NULL) AND market > 0 THEN market ELSE assd END AS imputed,
      CASE WHEN assd > market THEN 1 WHEN assd <= market THEN 0 END AS above_market,
      assd IS NULL AS assd_missing,
      round(o_totalprice / nullif(CASE WHEN (assd = 0 OR assd IS NULL) AND market > 0 THEN market ELSE assd END, 0), 6)
        AS price_to_value
    FROM raw""",
)
def coalesce_impute(spark, d):
    key, price = F.col("o_custkey"), F.col("o_totalprice")
    raw = table(spark, d, "orders").select(
        "o_orderkey",
        "o_totalprice",
        F.when(key % 5 == 0, 0.0).when(key % 7 != 0, price * 0.75).alias("assd"),
        F.when(key % 3 != 0, price * 1.5).alias("market"),
    )
    imputed = clean.substitute(F.col("assd"), F.col("market"), F.col("assd"), F.col("market"))
    return raw.select(
        "o_orderkey",
        F.coalesce("market", F.lit(0.0)).alias("market_or_zero"),
        F.coalesce("assd", "market", "o_totalprice").alias("first_value"),
        imputed.alias("imputed"),
        clean.two_way(F.col("assd") > F.col("market")).alias("above_market"),
        F.col("assd").isNull().alias("assd_missing"),
        F.round(F.try_divide(price, imputed), 6).alias("price_to_value"),
    )


@case(
    "literal_membership",
    """SELECT o_orderkey, o_orderpriority FROM orders
    WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus NOT IN ('P')""",
)
def literal_membership(spark, d):
    orders = table(spark, d, "orders")
    return orders.where(
        F.col("o_orderpriority").isin("1-URGENT", "5-LOW") & ~F.col("o_orderstatus").isin("P")
    ).select("o_orderkey", "o_orderpriority")


def _bands(spark, d, spec):
    orders = table(spark, d, "orders")
    label = bins.price_band(F.col("o_totalprice"), spec)
    return (
        orders.withColumn("band", label)
        .groupBy("band")
        .agg(
            F.count(F.lit(1)).alias("sales"),
            F.min("o_totalprice").alias("lowest"),
            F.max("o_totalprice").alias("highest"),
        )
        .withColumn("band_order", bins.band_order(F.col("band"), spec))
        .orderBy("band_order")
    )


def _bands_sql(expression):
    return f"""SELECT band, count(*) AS sales, min(o_totalprice) AS lowest, max(o_totalprice) AS highest,
      CAST(split_part(band, ' ', 1) AS INTEGER) AS band_order
    FROM (SELECT o_totalprice, {expression.format(c="o_totalprice")} AS band FROM orders) GROUP BY band"""


@case("price_bands_wide", _bands_sql(WIDE_SQL))
def price_bands_wide(spark, d):
    return _bands(spark, d, bins.WIDE)


@case("price_bands_narrow", _bands_sql(NARROW_SQL))
def price_bands_narrow(spark, d):
    return _bands(spark, d, bins.NARROW)


@case(
    "price_bands_eleven",
    _bands_sql(ELEVEN_SQL).replace("o_totalprice", "price").replace(
        "FROM orders", "FROM (SELECT o_totalprice * 2.5::DOUBLE AS price FROM orders)"
    ),
)
def price_bands_eleven(spark, d):
    orders = table(spark, d, "orders").select((F.col("o_totalprice") * 2.5).alias("price"))
    return (
        orders.withColumn("band", bins.price_band(F.col("price"), bins.ELEVEN))
        .groupBy("band")
        .agg(
            F.count(F.lit(1)).alias("sales"),
            F.min("price").alias("lowest"),
            F.max("price").alias("highest"),
        )
        .withColumn("band_order", bins.band_order(F.col("band"), bins.ELEVEN))
        .orderBy("band_order")
    )


@case(
    "recode_labels",
    """SELECT o_orderkey,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'fast' WHEN '2-HIGH' THEN 'fast'
        WHEN '5-LOW' THEN 'slow' ELSE o_orderpriority END AS speed,
      CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS state,
      CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 WHEN 'F' THEN 3 END AS state_order
    FROM orders""",
)
def recode_labels(spark, d):
    orders = table(spark, d, "orders")
    speed = clean.recode(
        F.col("o_orderpriority"),
        {"1-URGENT": "fast", "2-HIGH": "fast", "5-LOW": "slow"},
        F.col("o_orderpriority"),
    )
    state = clean.recode(F.col("o_orderstatus"), {"F": "done", "O": "open"})
    ordered = with_category_order(orders, "o_orderstatus", ["O", "P", "F"], "state_order")
    return ordered.select(
        "o_orderkey", speed.alias("speed"), state.alias("state"), "state_order"
    )


@case(
    "period_band",
    """SELECT CASE WHEN year(o_orderdate) < 1998 THEN 'Pre-1998' ELSE 'Post-1998' END AS period,
      CAST(year(o_orderdate) AS INTEGER) AS sale_year, count(*) AS sales FROM orders GROUP BY ALL""",
)
def period_band(spark, d):
    orders = table(spark, d, "orders").withColumn("sale_year", F.year("o_orderdate"))
    return (
        orders.withColumn("period", bins.period_band(F.col("sale_year"), 1998))
        .groupBy("period", "sale_year")
        .agg(F.count(F.lit(1)).alias("sales"))
    )


@case(
    "split_first",
    r"""SELECT p_partkey, regexp_split_to_array(p_name, '(\[|-|\]|/|[(]| )')[1] AS short_name,
      regexp_split_to_array(p_brand, '#')[1] AS brand_kind FROM part""",
)
def split_first(spark, d):
    part = table(spark, d, "part")
    return part.select(
        "p_partkey",
        clean.split_first(F.col("p_name"), r"(\[|-|]|/|[(]| )").alias("short_name"),
        clean.split_first(F.col("p_brand"), "#").alias("brand_kind"),
    )


@case(
    "rename_sanitise",
    """SELECT p_partkey AS part_key, lower(p_type) AS type_name__upper_,
      regexp_replace(p_brand, '[#]', '_', 'g') AS brand_code, CAST(p_size AS DOUBLE) AS size_in_ FROM part""",
)
def rename_sanitise(spark, d):
    part = table(spark, d, "part").select(
        F.col("p_partkey").alias("Part.Key"),
        F.lower("p_type").alias("Type Name (Upper)"),
        F.regexp_replace("p_brand", "[#]", "_").alias("Brand/Code"),
        F.col("p_size").alias("Size\tin%"),
    )
    return clean.cast_columns(clean.sanitise_columns(part), {"size_in_": "double"})
