import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from millgauge.operators import ranks
from millgauge.operators.heavy import Running, has_heavy, running_totals, split_heavy
from millgauge.operators.recency import newest_per_period, recency_ranks
from millgauge.plans import etl

DEED = "PropertyID long, FATransactionID string, RecordingDate date, TransactionType string, SaleAmt double"


def deeds(frame, rows):
    df = frame(rows, DEED)
    return df.withColumns(
        {
            "FATransactionID_1": F.substring("FATransactionID", 1, 1),
            "RecordingYear": F.year("RecordingDate"),
            "SaleYear": F.year("RecordingDate"),
        }
    )


def test_a_newer_non_qualifying_deed_hides_an_older_sale(frame):
    d = dt.date
    rows = [
        (1, "1a", d(2019, 3, 1), "2", 10.0),  # hidden by the next one
        (1, "1b", d(2019, 5, 1), "4", 20.0),  # newest of 2019, no sale
        (1, "1c", d(2020, 1, 1), "3", 30.0),  # newest of 2020, sale
        (2, "1d", d(2019, 1, 1), "2", 40.0),  # same date: the smaller id wins
        (2, "1e", d(2019, 1, 1), "2", 50.0),
        (3, "2f", d(2019, 1, 1), "2", 60.0),  # id prefix does not qualify
        (4, "1g", d(2018, 1, 1), "2", 70.0),  # too early
        (5, "1h", None, "2", 80.0),  # no date
    ]
    out = etl.rank_sales(deeds(frame, rows))
    got = {r.FATransactionID: (r.RecentSaleByYear, r.MostRecentSale) for r in out.collect()}
    assert got == {"1c": (1, 1), "1d": (1, 1)}


def test_pruned_ranks_are_those_of_the_full_sort(spark):
    """Ties within a day, days without a date, null entities, and one entity with most rows."""
    e = F.when(F.col("id") % 3 != 0, F.lit(1)).when(F.col("id") % 11 != 0, F.col("id") % 17)
    day = F.when(F.col("id") % 7 != 0, F.date_add(F.lit("2019-01-01"), (F.col("id") * 131 % 1500).cast("int")))
    df = spark.range(3000).select(e.alias("e"), day.alias("t"), F.year(day).alias("p"), "id")
    pruned = newest_per_period(df, "e", "p", "t", "id")
    full = recency_ranks(df, "e", "p", "t", "id").where("RecentSaleByYear = 1")
    assert pruned.dtypes == full.dtypes
    assert sorted(pruned.collect(), key=str) == sorted(full.collect(), key=str)
    assert "WindowGroupLimit" in pruned._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hot_rows", [1000, 2])
def test_undated_rows_have_no_rank_and_use_none_up(frame, hot_rows):
    d = dt.date
    rows = [
        (1, "a", d(2019, 1, 1), "2", 1.0),
        (1, "b", None, "2", 1.0),
        (1, "c", d(2020, 1, 1), "2", 1.0),
        (1, "d", d(2020, 2, 1), "2", 1.0),
    ]
    out = recency_ranks(
        deeds(frame, rows), "PropertyID", "RecordingYear", "RecordingDate", "FATransactionID",
        hot_rows=hot_rows,
    )
    got = {r.FATransactionID: (r.RecentSaleByYear, r.MostRecentSale) for r in out.collect()}
    assert got == {"a": (1, 3), "b": (None, None), "c": (2, 2), "d": (1, 1)}


def test_latest_is_pruned_before_the_shuffle(frame):
    df = deeds(frame, [(1, "a", dt.date(2019, 1, 1), "2", 1.0)])
    top = ranks.latest(df, ["PropertyID"], "RecordingDate", "FATransactionID")
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("hot_rows", [1000, 10])
def test_percentile_keeps_the_published_arithmetic(spark, hot_rows):
    df = spark.range(1, 101).select(F.col("id"), F.lit("g").alias("g"), (-F.col("id")).alias("v"))
    out = ranks.percentile_rank(df, "v", ["g"], "id", "p", hot_rows=hot_rows)
    got = {r.id: r.p for r in out.collect()}
    expected = {i: int(np.ceil(i / 100 * 100)) for i in range(1, 101)}
    assert got == expected and got[7] == 8 and got[1] == 1 and got[100] == 100


def test_percentile_of_one_row_ties_and_nulls(frame):
    df = frame([("a", 1, 5.0), ("b", 1, 5.0), ("b", 2, 5.0), ("b", 3, None)], "g string, i int, v double")
    out = ranks.percentile_rank(df, "v", ["g"], "i", "p")
    got = {(r.g, r.i): r.p for r in out.collect()}
    assert got == {("a", 1): 100, ("b", 1): 34, ("b", 2): 67, ("b", 3): None}


rows = st.lists(
    st.tuples(
        st.sampled_from(["a", "a", "a", "b", None]),
        st.one_of(st.none(), st.integers(-3, 3)),
    ),
    min_size=1,
    max_size=60,
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows)
def test_sliced_running_totals_equal_plain_ones(spark, data):
    """Whatever the skew and the ties, slicing gives the plain window's answer."""
    df = spark.createDataFrame(
        [(g, v, i) for i, (g, v) in enumerate(data)], "g string, v int, i int"
    )
    specs = [
        Running("r", [F.col("v"), F.col("i")], total="n"),
        Running("s", [-F.col("i")], F.col("i").cast("long"), "t"),
    ]
    plain = running_totals(df, ["g"], specs, hot_rows=1000).toPandas()
    sliced = running_totals(df, ["g"], specs, hot_rows=3).toPandas()
    order = lambda p: p.sort_values("i").reset_index(drop=True)
    pd.testing.assert_frame_equal(order(plain), order(sliced))


def test_heavy_split_keeps_every_row_once(frame):
    df = frame([(None, i) for i in range(5)] + [("a", 9), ("b", 7), ("b", 8)], "g string, i int")
    assert has_heavy(df, ["g"], 4) and not has_heavy(df, ["g"], 5) and not has_heavy(df, ["g"], None)
    light, heavy = split_heavy(df, ["g"], 4)
    assert sorted(r.i for r in heavy.collect()) == [0, 1, 2, 3, 4]
    assert sorted(r.i for r in light.collect()) == [7, 8, 9]


@pytest.mark.parametrize("hot_rows", [1000, 2])
def test_ntile_sizes(frame, hot_rows):
    df = frame([("g", float(i)) for i in range(7)] + [("g", None)], "g string, v double")
    out = ranks.ntile(df, "v", 5, ["g"], "v", "t", hot_rows)
    got = [r.t for r in out.orderBy(F.col("v").asc_nulls_last()).collect()]
    assert got == [1, 1, 2, 2, 3, 4, 5, None]


@pytest.mark.parametrize("hot_rows", [1000, 2])
def test_global_and_dense_ranks(frame, hot_rows):
    df = frame([("a", 5), ("b", 5), ("c", 9), ("d", None)], "k string, v int")
    out = ranks.global_rank(df, "v", "k", "r", hot_rows)
    assert {r.k: r.r for r in out.collect()} == {"c": 1, "a": 2, "b": 3, "d": None}
    out = ranks.dense_rank_values(df, "v", "r", hot_rows)
    assert {r.k: r.r for r in out.collect()} == {"a": 1, "b": 1, "c": 2, "d": None}


def test_modal_period_ties(frame):
    df = frame(
        [("a", 2019)] * 2 + [("a", 2020)] * 2 + [("b", 2020)] + [(None, 2021)] * 3,
        "g string, y int",
    )
    dense = ranks.modal_period(df, ["g"], "y", "dense", min_total=1)
    assert {(r.g, r.y) for r in dense.collect()} == {("a", 2019), ("a", 2020), (None, 2021)}
    first = ranks.modal_period(df, ["g"], "y", "first")
    assert {(r.g, r.y) for r in first.collect()} == {("a", 2019), ("b", 2020), (None, 2021)}
    kept = ranks.keep_modal_period(df, ["g"], "y", min_total=1)
    assert kept.count() == 7


def test_group_total_keeps_null_groups(frame):
    df = frame([("a", 1), ("a", 2), (None, 5)], "g string, v int")
    out = ranks.group_total(df, ["g"], F.sum("v"), "t")
    assert {(r.g, r.v): r.t for r in out.collect()} == {("a", 1): 3, ("a", 2): 3, (None, 5): 5}


def test_fill_goes_down_then_up(frame):
    df = frame(
        [("a", 1, None), ("a", 2, 5.0), ("a", 3, None), ("a", 4, 7.0), ("b", 1, None)],
        "g string, y int, v double",
    )
    out = ranks.fill_down_up(df, ["g"], "y", {"v": "f"}).orderBy("g", "y")
    assert [r.f for r in out.collect()] == [5.0, 5.0, 5.0, 7.0, None]
