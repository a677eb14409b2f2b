import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millgauge.functions import bins

EDGES = [
    99999.99, 100000.0, 120000.0, 180000.0, 180000.01, 200000.0, 200000.01, 249999.99, 250000.0,
    270000.0, 330000.0, 330000.01, 350000.0, 350000.01, 999999.99, 1000000.0, None,
]


def labels(frame, spec):
    df = frame([(v,) for v in EDGES], "v double")
    return [r[0] for r in df.select(bins.price_band(F.col("v"), spec)).collect()]


def test_band_edges_keep_their_mixed_closedness(frame):
    wide = dict(zip(EDGES, labels(frame, bins.WIDE)))
    assert wide[100000.0] == wide[200000.0] == "2 - $100K-$200K"
    assert wide[200000.01] == wide[249999.99] == "3 - $200K-$250K"
    assert wide[250000.0] == wide[350000.0] == "4 - $250K-$350K"
    assert wide[350000.01] == "5 - >$350K" and wide[None] is None
    narrow = dict(zip(EDGES, labels(frame, bins.NARROW)))
    assert narrow[120000.0] == narrow[180000.0] == "2 - $120K-$180K"
    assert narrow[180000.01] == "3 - $180K-$270K"
    assert narrow[270000.0] == narrow[330000.0] == "4 - $270K-$330K"
    assert narrow[330000.01] == "5 - >$330K"
    eleven = dict(zip(EDGES, labels(frame, bins.ELEVEN)))
    assert eleven[100000.0] == "2 - $100K-$200K" and eleven[200000.0] == "3 - $200K-$300K"
    assert eleven[999999.99] == "10 - $900K-$1M" and eleven[1000000.0] == "11 - >$1M"


def test_band_order_sorts_numerically(frame):
    df = frame([("10 - $900K-$1M",), ("2 - $100K-$200K",)], "b string")
    ordered = df.orderBy(bins.band_order(F.col("b"), bins.ELEVEN))
    assert [r.b for r in ordered.collect()] == ["2 - $100K-$200K", "10 - $900K-$1M"]


def test_tail_and_period_bands_with_null(frame):
    df = frame([(1,), (2,), (3,), (98,), (99,), (None,)], "p int")
    got = [r[0] for r in df.select(bins.tail_band(F.col("p"))).collect()]
    assert got == ["Tails", "Tails", "Middle 96%", "Middle 96%", "Tails", "Middle 96%"]
    df = frame([(2018,), (2019,), (None,)], "y int")
    assert [r[0] for r in df.select(bins.period_band(F.col("y"))).collect()] == [
        "Pre-2019",
        "Post-2019",
        "Post-2019",
    ]


def test_rank_quartile_and_quantile_groups(frame):
    df = frame([(18,), (19,), (36,), (54,), (55,), (None,)], "r int")
    assert [r[0] for r in df.select(bins.rank_quartile(F.col("r"))).collect()] == [1, 2, 2, 3, 4, None]
    df = frame([(1,), (20,), (21,), (100,)], "p int")
    got = df.select(
        bins.quantile_of_percentile(F.col("p"), 10).alias("d"),
        bins.quantile_of_percentile(F.col("p"), 5).alias("q"),
    ).collect()
    assert [tuple(r) for r in got] == [(1, 1), (2, 1), (3, 2), (10, 5)]


@pytest.mark.parametrize("hot_rows", [1000, 9])
def test_weighted_qcut_matches_pandas_cut(spark, hot_rows):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": [f"t{i:04d}" for i in range(200)], "n": rng.integers(1, 50, 200)})
    share = pdf.n.cumsum() / pdf.n.sum()
    expected = pd.cut(share, np.linspace(0, 1, 8), labels=False)
    got = bins.weighted_qcut(spark.createDataFrame(pdf), "k", "n", 7, hot_rows=hot_rows)
    got = got.toPandas().sort_values("k").partition_index.tolist()
    assert got == expected.tolist()


def test_weighted_qcut_chunks(frame):
    df = frame([("a", 300), ("b", 300), ("c", 300), ("d", 300)], "k string, n long")
    plan = bins.weighted_qcut(df, "k", "n", per_group=500)
    chunks = bins.chunk_keys(plan, "k").orderBy("partition_index").collect()
    assert [r["keys"] for r in chunks] == [["a"], ["b"], ["c", "d"]]
    with pytest.raises(ValueError):
        bins.weighted_qcut(df, "k", "n")


@pytest.mark.parametrize("q", [6, 7, 9, 49])
def test_equal_weights_fall_between_the_true_edges(spark, q):
    n = 490
    pdf = pd.DataFrame({"k": range(n + 1), "n": [0] + [1] * n})
    share = pdf["n"].cumsum() / n
    expected = pd.cut(share, np.linspace(0, 1, q + 1), labels=False)
    got = bins.weighted_qcut(spark.createDataFrame(pdf), "k", "n", q).orderBy("k").collect()
    assert [r.partition_index for r in got] == [None if pd.isna(x) else int(x) for x in expected]


@pytest.mark.parametrize("k", [3, 7, 8, 100])
def test_percentiles_make_as_many_groups_as_asked(spark, k):
    rows = spark.range(1, 101).select(bins.quantile_of_percentile(F.col("id"), k).alias("g"))
    assert sorted(r.g for r in rows.distinct().collect()) == list(range(1, k + 1))
