import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from millgauge.operators import quantiles as q
from millgauge.operators.selection import first_digit
from millgauge.sources.staged import cut_lineage

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def sample(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame(
        {
            "g": ["big"] * 400 + ["tied"] * 300 + ["one"] + ["two"] * 2,
            "v": np.concatenate([rng.normal(size=400), rng.integers(0, 3, 300), [4.0], [1.0, 2.0]]),
        }
    )
    df = spark.createDataFrame(pdf).union(
        spark.createDataFrame([("none", None), ("big", None)], "g string, v double")
    )
    return pdf, df


@pytest.mark.parametrize("hot_rows", [10_000, 50])
def test_exact_quantiles_match_numpy(spark, hot_rows):
    pdf, df = sample(spark)
    got = {r.g: r.v for r in q.exact_quantiles(df, ["g"], {"v": PROBS}, hot_rows).collect()}
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(np.quantile(part.v, PROBS), rel=1e-12)
    assert got["none"] is None


@pytest.mark.parametrize("hot_rows", [10_000, 50])
def test_sorted_quantiles_match_numpy(spark, hot_rows):
    pdf, df = sample(spark)
    got = {r.g: r.v for r in q.exact_quantiles_sorted(df, ["g"], "v", PROBS, hot_rows).collect()}
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(np.quantile(part.v, PROBS), rel=1e-12)
    # a group without values has a row here as in exact_quantiles
    assert len(got) == 5 and got["none"] is None


def extremes():
    rng = np.random.default_rng(1)
    far = rng.normal(size=900) * 10.0 ** rng.integers(-300, 300, 900)
    ends = [np.inf, -np.inf, 0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308]
    return np.concatenate([far, rng.integers(-3, 3, 300), ends, np.full(500, 7.25), 7.25 + rng.normal(size=500) * 1e-9])


@pytest.mark.parametrize("fetch", [None, 40, 2])
def test_digits_part_values_of_any_size(spark, fetch):
    """Both signs, infinities, subnormal numbers, ties and near ties, split down to bins of two rows."""
    values = extremes()
    pdf = pd.DataFrame({"g": np.arange(len(values)) % 3, "v": values, "w": values[::-1]})
    found = q.exact_quantiles(spark.createDataFrame(pdf), ["g"], {"v": PROBS, "w": [0.3]}, fetch).collect()
    for g, part in pdf.groupby("g"):
        row = next(r for r in found if r.g == g)
        for column, probs, got in (("v", PROBS, row.v), ("w", [0.3], row.w)):
            ordered = np.sort(part[column].to_numpy())
            for p, x in zip(probs, got):
                spot = p * (len(ordered) - 1)
                low, high = ordered[int(np.floor(spot))], ordered[int(np.ceil(spot))]
                share = spot - np.floor(spot)
                assert x == (low if low == high or not share else pytest.approx((1 - share) * low + share * high, rel=1e-9))


def test_first_digits_never_decrease(spark):
    values = np.unique(np.concatenate([extremes(), np.nextafter(extremes()[:200], np.inf), 2.0 ** np.arange(-1074, 1024)]))
    df = spark.createDataFrame(pd.DataFrame({"v": values})).select("v", first_digit(F.col("v")).alias("d"))
    digits = [r.d for r in sorted(df.collect(), key=lambda r: r.v)]
    assert digits == sorted(digits)


def test_no_task_holds_the_values_of_a_group(spark):
    df = spark.createDataFrame(sample(spark)[0])
    for fetch in (None, 20):
        plan = q.exact_quantiles(df, ["g"], {"v": [0.5]}, fetch)._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile" not in plan and "median" not in plan


def test_whole_table_quantiles(spark):
    pdf, df = sample(spark)
    for hot_rows in (10_000, 50):
        got = q.exact_quantiles(df, [], {"v": [0.5]}, hot_rows).collect()
        assert len(got) == 1 and got[0].v[0] == pytest.approx(pdf.v.median())


@pytest.mark.parametrize(
    "n, k", [(0, 0), (1, 0), (4, 0), (5, 1), (10, 2), (101, 42), (10_000, 4918)]
)
def test_median_interval_rank(n, k):
    assert q.median_interval_rank(n, 0.90) == k


def test_median_interval_rank_scales():
    n = 10**10
    assert q.median_interval_rank(n, 0.90) == pytest.approx(n / 2 - 1.6448536 * n**0.5 / 2, abs=2)


@pytest.mark.parametrize("hot_rows", [1000, 7])
def test_median_ci_small_groups(spark, hot_rows):
    rows = [(n, float(i)) for n in (1, 4, 5, 10, 101) for i in range(n)]
    df = spark.createDataFrame(rows, "n int, TaxRate double")
    got = {r.n: tuple(r)[1:] for r in q.median_ci(df, ["n"], "TaxRate", hot_rows=hot_rows).collect()}
    assert got == {
        1: (0.0, None, None),
        4: (1.5, None, None),
        5: (2.0, 0.0, 4.0),
        10: (4.5, 1.0, 8.0),
        101: (50.0, 41.0, 59.0),
    }


def test_statutory_comparison_defaults_to_within(frame):
    df = frame(
        [(0.02, 0.01, 0.03, 0.05), (0.02, 0.01, 0.03, 0.02), (0.02, 0.01, 0.03, None), (0.02, None, None, 0.5)],
        "TaxRate_median_est double, TaxRate_median_lo_ci double, TaxRate_median_hi_ci double, s double",
    )
    got = [r.outside_ci for r in q.compare_with_statutory(df, "s").collect()]
    assert got == ["Outside CI", "Within CI", "Within CI", "Within CI"]


def test_distribution_of_single_value(frame):
    df = frame([("a", 0.0), ("b", 1.0), ("b", 3.0)], "g string, TaxRate double")
    got = {r.g: r for r in q.distribution(df, ["g"], "TaxRate").collect()}
    assert got["a"].tax_rate_sd is None and got["a"].coeff_of_var is None
    assert got["b"].tax_rate_median == 2.0 and got["b"].iqr_diff75_25 == 1.0


def test_boxplot_whiskers_and_axis_limits(frame):
    df = frame([("a", float(v)) for v in (1, 2, 3, 4, 5, 100)], "g string, v double")
    box = q.boxplot(df, ["g"], "v").first()
    assert (box.whisker_low, box.whisker_high) == (1.0, 5.0) and box.median == 3.5
    cut = q.boxplot(df, ["g"], "v", limits=(0.0, 10.0)).first()
    assert cut.median == 3.0 and cut.order_iqr == box.order_iqr


def test_two_sample_z_is_antisymmetric_and_null_aware(frame):
    schema = ", ".join(f"{c}_{b} double" for c in ("count", "TaxRate", "TaxRate_mean", "TaxRate_median", "TaxRate_std") for b in (1, 5))
    row = (10.0, 12.0, 0.01, 0.02, 0.011, 0.022, 0.01, 0.021, 0.002, 0.003)
    gone = (10.0, 12.0, 0.01, 0.02, 0.011, 0.022, 0.01, 0.021, None, 0.003)
    df = frame([row, gone], schema)
    up, missing = q.two_sample_z(df, "5", "1").collect()
    down = q.two_sample_z(df, "1", "5").first()
    assert up.test_stat_mean == pytest.approx(-down.test_stat_mean)
    assert (up.gt_critval_mean, down.gt_critval_mean) == (1, 0)
    assert up.ratio == pytest.approx(0.021 / 0.01) and up.ratio_fixed == pytest.approx(2.1)
    assert missing.test_stat_mean is None and missing.gt_critval_mean is None


def test_margin_of_error(frame):
    df = frame([(4, 0.5, 0.2)], "count long, TaxRate_mean double, TaxRate_std double")
    row = q.margin_of_error(df).first()
    assert row.TaxRate_moe == pytest.approx(1.6448536 * 0.1)
    assert row.TaxRate_upper - row.TaxRate_lower == pytest.approx(2 * row.TaxRate_moe)


def test_quantile_scan_reads_only_needed_columns(spark, monkeypatch):
    """Also where rows are staged: everything later reads the stage."""
    needed = "ReadSchema: struct<o_orderstatus:string,o_totalprice:double>"
    plans = []

    def recorded(df, name="cut"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut_lineage(df, name)

    monkeypatch.setattr(q, "cut_lineage", recorded)
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    small = q.exact_quantiles(df, ["o_orderstatus"], {"o_totalprice": [0.5]})
    assert needed in small._jdf.queryExecution().executedPlan().toString() and not plans
    large = q.exact_quantiles(df, ["o_orderstatus"], {"o_totalprice": [0.5]}, 10)
    assert needed in plans[0] and "orders.parquet" not in large._jdf.queryExecution().executedPlan().toString()
    assert small.orderBy("o_orderstatus").collect() == large.orderBy("o_orderstatus").collect()
