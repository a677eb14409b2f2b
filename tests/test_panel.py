import numpy as np
import pytest
from pyspark.sql import functions as F

from millgauge.operators import panel, quality, reshape
from millgauge.operators.joins import Level, coverage, equi_join, fallback_lookup


def fits(spark, series, span=0.75):
    rows = [(g, x, None if y is None else float(y)) for g, ys in series.items() for x, y in enumerate(ys, start=2000)]
    df = spark.createDataFrame(rows, "g string, year int, y double")
    out = panel.loess(df, ["g"], "year", {"y": "f"}, span).orderBy("g", "year").collect()
    return {g: [r.f for r in out if r.g == g] for g in series}


def local_fit(x, y, span):
    """Independent check: weighted least squares by numpy at every point."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    near = int(np.floor(len(x) * span + 1e-5))
    out = []
    for at in x:
        d = np.abs(x - at)
        h = np.sort(d)[near - 1]
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0.0)
        a = np.vander((x - at) / h, 3, increasing=True) * np.sqrt(w)[:, None]
        out.append(np.linalg.lstsq(a, y * np.sqrt(w), rcond=None)[0][0])
    return out


def test_loess_reproduces_a_quadratic_and_a_constant(spark):
    x = np.arange(24.0)
    series = {"quadratic": list(3 + 2 * x - 0.1 * x * x), "constant": [7.0] * 24, "short": [1.0, 5.0, 2.0]}
    got = fits(spark, series)
    for g in series:
        assert got[g] == pytest.approx(series[g], abs=1e-9)


def test_loess_matches_weighted_least_squares(spark):
    rng = np.random.default_rng(2)
    series = {f"s{n}": list(rng.normal(100, 20, n)) for n in (8, 15, 24)}
    got = fits(spark, series)
    for g, y in series.items():
        assert got[g] == pytest.approx(local_fit(range(len(y)), y, 0.75), rel=1e-8)


def test_loess_skips_missing_values(spark):
    got = fits(spark, {"a": [1.0, None, 3.0, 4.0, 5.0, 6.0]})["a"]
    assert got[1] is None and got[0] == pytest.approx(1.0)


def test_complete_and_balance(frame):
    df = frame([("a", 2000, 1.0), ("a", 2002, 3.0), ("b", 2001, 2.0), (None, 2001, 9.0)], "k string, y int, v double")
    grid = reshape.complete(df, ["k"], "y")
    assert grid.count() == 9 and grid.where("v is not null").count() == 4
    keyed = grid.fillna({"k": "none"})
    assert quality.balanced(keyed, "k", "y").first().balanced
    assert not quality.balanced(df, "k", "y").first().balanced
    filled = reshape.complete(df, ["k"], "y", fill={"v": 0.0})
    assert filled.where("v = 0").count() == 5


def test_rebase_without_base_year(frame):
    df = frame([("a", 2020, 50.0), ("a", 2021, 100.0), ("b", 2020, 10.0)], "k string, y int, v double")
    out = {(r.k, r.y): r.hpi_index_2021 for r in panel.rebase(df, "k", "y", "v", [2021]).collect()}
    assert out == {("a", 2020): 2.0, ("a", 2021): 1.0, ("b", 2020): None}


def test_annualise_ignores_nulls(frame):
    df = frame([("a", 1, 2.0), ("a", 1, None), ("b", 1, None)], "k string, y int, v double")
    assert {r.k: r.v for r in panel.annualise(df, ["k"], "y", "v").collect()} == {"a": 2.0, "b": None}


def test_fallback_per_coordinate(frame):
    points = frame([(1, "x", 5.0, None), (2, "x", None, None), (3, "z", None, None)], "id int, k string, lon double, lat double")
    fine = frame([("x", None, 1.0)], "fk string, a double, b double")
    coarse = frame([("x", 7.0, 8.0)], "ck string, a double, b double")
    names = {"lon": "a", "lat": "b"}
    out = fallback_lookup(points, [Level(fine, "k", "fk", names), Level(coarse, "k", "ck", names)])
    assert {r.id: (r.lon, r.lat) for r in out.collect()} == {1: (5.0, 1.0), 2: (7.0, 1.0), 3: (None, None)}


def test_joins_drop_right_keys_and_match_nulls_on_request(frame):
    left = frame([(1,), (None,)], "k int")
    right = frame([(1, "a"), (None, "b")], "k int, v string")
    plain = equi_join(left, right, ["k"], "left")
    assert plain.columns == ["k", "v"]
    assert {r.k: r.v for r in plain.collect()} == {1: "a", None: None}
    safe = equi_join(left, right, ["k"], "left", null_safe=True)
    assert {r.k: r.v for r in safe.collect()} == {1: "a", None: "b"}
    assert [r.k for r in coverage(left, right.where("k = 1"), "k").collect()] == [None]


def test_pivots(frame):
    df = frame([("a", "x", 1, 2.0), ("a", "x", 3, 1.0), ("b", "y", 5, None)], "k string, c string, n int, v double")
    out = reshape.pivot_multi(df, ["k"], "c", ["n", "v"], ["x", "y"])
    got = {r.k: r.asDict() for r in out.collect()}
    assert got["a"] == {"k": "a", "n_x": 3, "v_x": 2.0, "n_y": None, "v_y": None}
    assert got["b"]["n_y"] == 5 and got["b"]["v_y"] is None
    one = reshape.pivot_single(df, ["k"], "c", "n", ["x"], "{category}_{value}")
    assert one.columns == ["k", "x_n"]


def test_reconcile_counts(spark):
    row = quality.reconcile(spark.range(5), spark.range(3)).first()
    assert tuple(row) == (5, 3, 2, False)
    empty = quality.reconcile(spark.range(0), spark.range(0)).first()
    assert tuple(empty) == (0, 0, 0, True)


def test_category_order(frame):
    df = frame([("b",), ("a",), ("q",)], "c string")
    out = reshape.with_category_order(df, "c", ["b", "a"], "o").orderBy(F.col("o").asc_nulls_last())
    assert [(r.c, r.o) for r in out.collect()] == [("b", 1), ("a", 2), ("q", None)]
