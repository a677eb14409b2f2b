import statistics

import pytest
from pyspark.sql import functions as F

from millgauge.operators.summary import MEASURES, POOLED, SNAPSHOT, summarise, summary, summary_cube
from millgauge.plans import etl
from millgauge.sources.staged import cut_lineage

COLUMNS = (
    "PropertyID long, FATransactionID string, SaleRecordingYear int, FIPS string, city_geoid string, SaleAmt double, TaxAmt double,"
    "AssdTotalValue double, MarketTotalValue double, hpi_index_2021_sale double, hpi_index_2021_assd double,"
    "hpi_index_2021_market double, RecentSaleByYear int, MostRecentSale int"
)


def staging(frame, n=120):
    rows = []
    for i in range(n):
        city = None if i % 6 == 0 else f"c{i % 3}"
        assd = None if i % 5 == 0 else 0.0 if i % 5 == 1 else 50_000.0 + i
        market = None if i % 7 == 0 else 60_000.0 + i
        rows.append(
            (i, f"1{i}", 2019 + i % 2, "01001", city, 90_000.0 + 3_000 * i, 1_000.0 + i, assd, market,
             1.1, None if i % 4 == 0 else 1.2, 1.3, 1, 1 if i % 2 else 2)
        )
    return frame(rows, COLUMNS)


def test_zero_denominators_become_null_and_do_not_poison_means(frame):
    rated = etl.add_rates(staging(frame))
    rows = rated.collect()
    for r in rows:
        unusable = r.AssdTotalValue in (0.0, None)
        if unusable and r.MarketTotalValue:
            expected = r.MarketTotalValue * 1.3
        elif r.AssdTotalValue is None or r.hpi_index_2021_assd is None:
            expected = None
        else:
            expected = r.AssdTotalValue * r.hpi_index_2021_assd
        assert r.AssdTotalValue_HPI2021_Imputed == (pytest.approx(expected) if expected is not None else None)
        if expected == 0:
            assert r.TaxAmt_to_AssdValue_SaleAmt_Ratio is None
        assert r.TaxRate == pytest.approx(r.TaxRate_HPI2021)
    mean = rated.agg(F.avg("TaxAmt_to_AssdValue_SaleAmt_Ratio")).first()[0]
    assert 0 < mean < 1e6


@pytest.mark.parametrize("hot_rows", [1000, 10])
def test_cube_counts_add_up(frame, hot_rows):
    tiles = cut_lineage(etl.tile_sales(staging(frame), hot_rows=hot_rows))
    cube = summary_cube(tiles, ["city_geoid"], ["Total", "SaleBins"], {"SaleAmt_Quintile": 5}, hot_rows=hot_rows)
    rows = cube.collect()
    kept = tiles.where("TaxRate_Outliers = 'Middle 96%'").collect()
    for mode, column in (("Snapshot", "RecentSaleByYear"), ("Pooled", "MostRecentSale")):
        size = sum(1 for r in kept if r[column] == 1)
        for family in ("Total", "SaleBins", "SaleAmt_Quintile"):
            part = [r for r in rows if r["mode"] == mode and r.bin_family == family]
            assert sum(r["count"] for r in part) == size
            assert {r.count_Total for r in part} == {size}
            # sales outside any city stay a group (all of them are older sales here)
            assert (None in {r.city_geoid for r in part}) == (mode == "Snapshot")
            per_city = {r.city_geoid: r.count_GeoTotal for r in part}
            assert sum(per_city.values()) == size
    quintiles = {r.bin for r in rows if r.bin_family == "SaleAmt_Quintile"}
    assert quintiles == {"1", "2", "3", "4", "5"}


def test_quintile_one_holds_the_highest_prices(frame):
    tiles = etl.tile_sales(staging(frame))
    cube = summary_cube(tiles, ["city_geoid"], [], {"SaleAmt_Quintile": 5}, [SNAPSHOT])
    for city in ("c1", "c2"):
        means = {r.bin: r.SaleAmt_mean for r in cube.where((F.col("city_geoid") == city) & (F.col("period") == "2019")).collect()}
        assert means["1"] > means["3"] > means["5"]


@pytest.mark.parametrize("hot_rows", [1000, 10])
def test_summary_values_against_python(frame, hot_rows):
    tiles = etl.tile_sales(staging(frame))
    got = {
        (r.city_geoid, r.SaleRecordingYear): r
        for r in summary(tiles, ["city_geoid"], "Total", hot_rows=hot_rows).collect()
    }
    groups = {}
    for r in tiles.where("TaxRate_Outliers = 'Middle 96%' and RecentSaleByYear = 1").collect():
        groups.setdefault((r.city_geoid, r.SaleRecordingYear), []).append(r)
    assert got.keys() == groups.keys()
    for key, rows in groups.items():
        row = got[key]
        rate = [r.TaxRate for r in rows]
        ratio = [r.TaxAmt_to_AssdValue_SaleAmt_Ratio for r in rows if r.TaxAmt_to_AssdValue_SaleAmt_Ratio is not None]
        assert row["count"] == len(rows) == row.PropertyID_nunique
        assert row.TaxRate_median == pytest.approx(statistics.median(rate))
        assert row.TaxRate_std == pytest.approx(statistics.stdev(rate))
        assert row.TaxAmt_to_AssdValue_SaleAmt_Ratio_std == pytest.approx(statistics.stdev(ratio))
        assert row.TaxRate == pytest.approx(sum(r.TaxAmt for r in rows) / sum(r.SaleAmt for r in rows))


def test_pooled_mode_uses_adjusted_money(frame):
    tiles = etl.tile_sales(staging(frame))
    row = summary(tiles, ["city_geoid"], "Total", POOLED).where("city_geoid = 'c1'").first()
    kept = tiles.where("city_geoid = 'c1' and MostRecentSale = 1 and TaxRate_Outliers = 'Middle 96%'")
    assert row.SaleAmt_sum == pytest.approx(kept.agg(F.sum("SaleAmt_HPI2021")).first()[0])
    assert "SaleRecordingYear_Bins" in row.asDict()


def test_notnull_counts_real_values(frame):
    df = frame([("a", 1, 5.0), ("a", 2, None), ("a", 2, 7.0)], "g string, id int, v double")
    row = summarise(df, ["g"], "id", {"v": ("sum", "median", "std")}, ("v",)).first()
    assert (row["count"], row.id_nunique, row.v_notnull, row.v_sum, row.v_median) == (3, 2, 2, 12.0, 6.0)


def test_measure_count_of_the_published_tables():
    assert 4 + sum(len(s) for s in MEASURES.values()) == 25
