"""One key holds a third of the rows and few distinct values: work stays spread out and exact."""

import pytest
from pyspark.sql import functions as F

from millgauge.operators.heavy import attach, heavy_groups, slice_heavy
from millgauge.operators.quantiles import exact_quantiles, exact_quantiles_sorted, median_ci
from millgauge.operators.ranks import global_rank, percentile_rank
from millgauge.operators.recency import recency_ranks

SF = "/root/testdata/sf0.01"
HOT = 500


@pytest.fixture(scope="module")
def skewed(spark):
    """15,000 sales; key 0 has a third of them, half of those at one price."""
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{SF}/orders.parquet").select(
        k.alias("id"),
        F.when(k % 3 == 0, F.lit(0)).otherwise(F.col("o_custkey") % 400 + 1).alias("key"),
        F.when(k % 6 == 0, F.lit(100000.0)).otherwise(F.col("o_totalprice")).alias("price"),
    )


def test_only_the_hot_key_is_heavy_and_its_slices_are_even(skewed):
    assert [r.key for r in heavy_groups(skewed, ["key"], HOT).collect()] == [0]
    sliced = slice_heavy(skewed, ["key"], ["price", "id"], HOT)
    sizes = {
        (r.key, r._slice): r["count"] for r in sliced.groupBy("key", "_slice").count().collect()
    }
    hot = [n for (key, _), n in sizes.items() if key == 0]
    assert sum(hot) == 5000 and len(hot) >= 8
    # ties at one price are split by the unique id, so no slice is far above the aim
    assert max(hot) <= 3 * HOT
    assert all(s == 0 for key, s in sizes if key != 0)


def test_slices_are_consecutive_in_order(skewed):
    sliced = slice_heavy(skewed, ["key"], ["price", "id"], HOT).where("key = 0")
    ends = (
        sliced.groupBy("_slice")
        .agg(F.min(F.struct("price", "id")).alias("low"), F.max(F.struct("price", "id")).alias("high"))
        .orderBy("_slice")
        .collect()
    )
    assert all(tuple(a.high) < tuple(b.low) for a, b in zip(ends, ends[1:]))


def test_slices_do_not_depend_on_partitioning(skewed):
    one = slice_heavy(skewed.coalesce(1), ["key"], ["price", "id"], HOT)
    many = slice_heavy(skewed.repartition(13), ["key"], ["price", "id"], HOT)
    assert one.select("id", "_slice").exceptAll(many.select("id", "_slice")).isEmpty()


def test_results_equal_the_plain_ones(skewed):
    plain = percentile_rank(skewed, "price", ["key"], "id", "p")
    sliced = percentile_rank(skewed, "price", ["key"], "id", "p", HOT)
    assert plain.exceptAll(sliced).isEmpty() and plain.count() == sliced.count()
    plain = global_rank(skewed, "price", "id", "r")
    assert plain.exceptAll(global_rank(skewed, "price", "id", "r", HOT)).isEmpty()
    probs = {"price": [0.1, 0.5, 0.9]}
    plain = {r.key: r.price for r in exact_quantiles(skewed, ["key"], probs).collect()}
    heavy = {r.key: r.price for r in exact_quantiles(skewed, ["key"], probs, HOT).collect()}
    assert plain.keys() == heavy.keys()
    assert plain == heavy


def test_groups_without_values_have_a_row_at_every_size(frame):
    rows = [(k, g, float(k) if g != "b" else None) for k in range(60) for g in "abc"]
    df = frame(rows, "id int, g string, v double")
    for hot in (1000, 10):
        found = {r.g: r.v for r in exact_quantiles(df, ["g"], {"v": [0.5]}, hot).collect()}
        assert found.keys() == set("abc") and found["a"] == [29.5] and not found["b"] or found["b"] == [None]
        assert exact_quantiles_sorted(df, ["g"], "v", [0.5], hot).count() == 3
        assert median_ci(df, ["g"], "v", hot_rows=hot).count() == 3


def test_recency_at_full_precision_and_in_any_period(frame):
    rows = [(1, k, f"2020-01-01 0{k % 7}:00:00", k % 2) for k in range(20)]
    df = frame(rows, "e int, id int, t string, p int").withColumn("t", F.to_timestamp("t"))
    plain = sorted(recency_ranks(df, "e", "p", "t", "id").collect())
    assert plain == sorted(recency_ranks(df, "e", "p", "t", "id", hot_rows=3).select(*df.columns, "RecentSaleByYear", "MostRecentSale").collect())
    newest = max(rows, key=lambda r: (r[2], -r[1]))
    assert next(r.id for r in plain if r.MostRecentSale == 1) == newest[1]


def test_heavy_plan_never_groups_rows_by_the_hot_key_alone(skewed):
    """Row-level windows are partitioned by (key, slice); only aggregates use the key alone."""
    out = percentile_rank(skewed, "price", ["key"], "id", "p", HOT)
    plan = out._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [row_number()" in line]
    assert windows and all("_slice0" in line for line in windows)
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_attach_matches_null_keys(frame):
    df = frame([(1, "a"), (None, "b"), (2, "c")], "k int, v string")
    small = frame([(None, 9), (1, 8)], "k int, w int")
    assert {r.v: r.w for r in attach(df, small, ["k"]).collect()} == {"a": 8, "b": 9, "c": None}
