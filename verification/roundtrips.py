"""Sources and sinks as round trips through the shared folder: what is read back must be the table."""

from pyspark.sql import functions as F, types as T

from millgauge.operators.reshape import union_all
from millgauge.schemas import BENCHMARK_MONEY, BENCHMARK_RATES
from millgauge.sources import delimited, export, polygons, staged
from verification.registry import case
from verification.standins import table

ORDERS = ("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders"


def _orders(spark, d):
    return table(spark, d, "orders").select(*ORDERS)


@case("inferred_round_trip", ORDERS_SQL)
def inferred_round_trip(spark, d):
    """Types found in all rows."""
    path = staged.scratch(spark, "text")
    _orders(spark, d).write.option("sep", "|").option("header", True).csv(path)
    return delimited.read_inferred(spark, path, "|").select(*ORDERS)


@case(
    "inferred_misfits",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 1000 = 1 THEN 'n/a' ELSE o_custkey::VARCHAR END AS customer,
      CASE WHEN o_orderkey % 1000 = 2 THEN 0.5::DOUBLE ELSE (o_custkey % 7)::DOUBLE END AS share,
      CASE WHEN o_orderkey % 1000 = 3 THEN NULL ELSE o_orderdate::DATE::VARCHAR END AS day,
      CASE WHEN o_orderkey % 1000 = 4 THEN 'unknown' ELSE o_orderdate::DATE::VARCHAR END AS day_or_word,
      '123456789012345678901' AS code FROM orders""",
)
def inferred_misfits(spark, d):
    """One cell in a thousand does not fit what the others look like: the column takes a wider type, no cell is lost."""
    path, k = staged.scratch(spark, "text"), F.col("o_orderkey")
    day = F.to_date("o_orderdate").cast("string")
    rows = table(spark, d, "orders").select(
        "o_orderkey",
        F.when(k % 1000 == 1, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("customer"),
        F.when(k % 1000 == 2, "0.5").otherwise((F.col("o_custkey") % 7).cast("string")).alias("share"),
        F.when(k % 1000 != 3, day).alias("day"),
        F.when(k % 1000 == 4, "unknown").otherwise(day).alias("day_or_word"),
        F.lit("123456789012345678901").alias("code"),
    )
    rows.write.option("header", True).csv(path)
    return delimited.read_inferred(spark, path).withColumn("day", F.col("day").cast("string"))


@case("header_round_trip", ORDERS_SQL)
def header_round_trip(spark, d):
    """Columns matched by name in files with other columns and another order."""
    path = staged.scratch(spark, "text")
    rows = _orders(spark, d).select("o_orderpriority", F.lit("x").alias("surplus"), *ORDERS[:3])
    rows.write.option("sep", "|").option("header", True).csv(path)
    schema = T.StructType.fromDDL("o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string")
    return delimited.read_delimited(spark, path, schema)


@case(
    "benchmark_rates_round_trip",
    """SELECT c_custkey AS place_id, CASE WHEN c_custkey % 7 <> 0 THEN floor(c_acctbal) * 1000 END AS home_value FROM customer""",
)
def benchmark_rates_round_trip(spark, d):
    """Money with grouped digits and marks for missing values, in quoted cells."""
    path = staged.scratch(spark, "rates")
    money = F.when(F.col("c_custkey") % 7 != 0, F.format_number(F.floor("c_acctbal") * 1000, 0)).otherwise("-")
    cells = {n.name: F.lit("1") for n in BENCHMARK_RATES.fields} | {BENCHMARK_MONEY[0]: money}
    cells["place_id"] = F.col("c_custkey").cast("string")
    rows = table(spark, d, "customer").select(*[cells[f.name].alias(f.name) for f in BENCHMARK_RATES.fields])
    rows.write.option("header", True).csv(path)
    found = delimited.read_benchmark_rates(spark, path)
    return found.select(F.col("place_id").cast("long").alias("place_id"), F.col(BENCHMARK_MONEY[0]).cast("double").alias("home_value"))


@case(
    "keyed_read",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)",
)
def keyed_read(spark, d):
    """Two columns of the rows whose key is in another table."""
    path = staged.scratch(spark, "orders")
    export.write_table(_orders(spark, d), path)
    keys = table(spark, d, "customer").where("c_nationkey < 12").select("c_custkey")
    return staged.read_keys(spark, path, ["o_orderkey", "o_totalprice"], "o_custkey", keys)


@case("append_compact", ORDERS_SQL)
def append_compact(spark, d):
    """Parts appended one after the other, then rewritten as few files."""
    parts, whole = staged.scratch(spark, "parts"), staged.scratch(spark, "whole")
    for k in range(3):
        staged.append(_orders(spark, d).where(F.col("o_orderkey") % 3 == k), parts)
    return staged.compact(spark, parts, whole)


#: Customers as boxes two high and one wide: key, name, west, south.
BOXES_SQL = """SELECT c_custkey, c_name, (c_custkey % 340 - 170 + 0.5)::DOUBLE AS lon, (c_custkey % 80 * 2 - 80 + 1)::DOUBLE AS lat FROM customer"""


def _boxes(spark, d):
    k = F.col("c_custkey")
    x, y = (k % 340 - 170).cast("double"), (k % 80 * 2 - 80).cast("double")
    corners = ((0, 0), (1, 0), (1, 2), (0, 2), (0, 0))
    ring = F.array(*[F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in corners])
    return table(spark, d, "customer").select("c_custkey", "c_name", F.array(ring).alias("rings"))


def _centres(layer):
    found = polygons.centroids(layer, ["c_custkey", "c_name"])
    return found.withColumns({c: F.round(c, 7) for c in ("lon", "lat")})


BOX_TYPES = {"c_custkey": T.LongType(), "c_name": T.StringType()}


@case("geojson_round_trip", BOXES_SQL)
def geojson_round_trip(spark, d):
    """Polygons written one feature per line and read again, with the centres of what was read."""
    path = staged.scratch(spark, "layer")
    polygons.write_geojson(_boxes(spark, d), path)
    return _centres(polygons.read_geojson(spark, path, BOX_TYPES, lines=True))


@case("feature_collection_round_trip", BOXES_SQL)
def feature_collection_round_trip(spark, d):
    """Feature collections of five hundred features on one line, cut and parsed feature by feature."""
    path = staged.scratch(spark, "layer")
    boxes = _boxes(spark, d)
    text = boxes.select("c_custkey", polygons.feature_text(boxes).alias("f"))
    listed = text.groupBy(F.expr("c_custkey div 500")).agg(F.concat_ws(", ", F.collect_list("f")).alias("f"))
    whole = F.concat(F.lit('{"type": "FeatureCollection", "name": "boxes", "features": ['), "f", F.lit("]}"))
    listed.select(whole.alias("value")).write.option("lineSep", "\n").text(path)
    return _centres(polygons.read_geojson(spark, path, BOX_TYPES))


@case(
    "report_set_round_trip",
    """SELECT 'customers' AS kind, c_custkey AS id, c_name AS label FROM customer
    UNION ALL SELECT 'orders', o_orderkey, o_orderpriority FROM orders""",
)
def report_set_round_trip(spark, d):
    """Several named tables written as CSV with a header."""
    named = {
        "customers": table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label")),
        "orders": table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label")),
    }
    paths = export.export_tables(named, staged.scratch(spark, "report"))
    schema = T.StructType.fromDDL("id long, label string")
    back = [delimited.read_delimited(spark, p, schema, ",").withColumn("kind", F.lit(k)) for k, p in zip(named, paths)]
    return union_all(back).select("kind", "id", "label")


@case(
    "partitioned_round_trip",
    "SELECT o_orderpriority AS mode, year(o_orderdate)::INTEGER AS bin_family, count(*) AS orders FROM orders GROUP BY 1, 2",
)
def partitioned_round_trip(spark, d):
    """A summary as one dataset with a directory per table."""
    path = staged.scratch(spark, "cube")
    counted = (
        table(spark, d, "orders")
        .groupBy(F.col("o_orderpriority").alias("mode"), F.year("o_orderdate").alias("bin_family"))
        .agg(F.count("*").alias("orders"))
    )
    export.export_cube(counted, path)
    return spark.read.parquet(path).select("mode", F.col("bin_family").cast("int").alias("bin_family"), "orders")
