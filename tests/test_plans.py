"""End-to-end runs on small raw files, dimension building and the combined report."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import types as T

from millgauge import schemas
from millgauge.operators.spatial import Layer
from millgauge.operators.summary import SNAPSHOT, one_table
from millgauge.plans import analysis, dimensions, etl, report
from millgauge.sources import export


def write_raw(path, schema, rows):
    names = [f.name for f in schema.fields]
    lines = ["|".join(names)] + ["|".join(str(r.get(n, "")) for n in names) for r in rows]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def raw_rows(n=300):
    rng = random.Random(4)
    annual, deeds = [], []
    for i in range(n):
        missing = i % 10 == 0
        annual.append(
            {
                "PropertyID": i,
                "PropertyClassID": "C" if i % 25 == 24 else "R",
                "APN": f"apn{i}",
                "FIPS": "1001" if i % 2 else "01003",
                "SitusCensusTract": "100",
                "SitusCensusBlock": "1001",
                "SitusLatitude": 0 if missing else 1 + (i % 7),
                "SitusLongitude": 0 if missing else 1 + (i % 5),
                "TaxYear": 2020 + i % 2,
                "AssdYear": 2019,
                "MarketYear": 2020,
                "AssdTotalValue": 0 if i % 9 == 0 else 80_000 + i,
                "MarketTotalValue": 90_000 + i,
                "TaxAmt": 100 * (1_000 + i),
            }
        )
        for j in range(rng.randint(1, 3)):
            deeds.append(
                {
                    "PropertyID": i,
                    "FATransactionID": f"{rng.choice('126')}{i:04d}{j}",
                    "RecordingDate": f"20{rng.choice([18, 20, 20, 21, 21])}0{rng.randint(1, 9)}15",
                    "SaleAmt": 100_000 + 1_000 * i + j,
                    "TransactionType": rng.choice("2334"),
                }
            )
    return annual, deeds


def box(x0, y0, x1, y1):
    return [[{"x": x, "y": y} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]]


@pytest.fixture(scope="module")
def dims(spark):
    counties = spark.createDataFrame(
        [("AL", "01", "Alabama", c, f"County {c}", f"01{c}", "33860", "Metro", "MSA", "Central", 1.0) for c in ("001", "003")],
        schemas.COUNTY_CBSA,
    )
    hpi = spark.createDataFrame(
        [(f"01{c}", y, 1.0, 1.0 + (2021 - y) / 10) for c in ("001", "003") for y in range(2019, 2024)],
        schemas.COUNTY_HPI,
    )
    centroid = "lon double, lat double"
    cities = T.StructType(
        [
            T.StructField("city_geoid", T.StringType()),
            T.StructField("city_name", T.StringType()),
            T.StructField("city_state_code", T.StringType()),
            T.StructField("city_population2020", T.LongType()),
            T.StructField("city_population2022", T.LongType()),
            T.StructField("city_rank", T.IntegerType()),
            T.StructField("rings", schemas.RINGS),
        ]
    )
    layer = spark.createDataFrame(
        [
            ("0100001", "West", "AL", 10, 20, 2, box(0.0, 0.0, 2.5, 9.0)),
            ("0100002", "East", "AL", 30, 40, 1, box(2.5, 0.0, 4.5, 9.0)),
            ("0100003", "Over", "AL", 1, 2, 3, box(3.5, 0.0, 4.5, 2.5)),
        ],
        cities,
    )
    return {
        "block_groups": spark.createDataFrame([("010010001001", None, 2.0)], "block_group_fips string, " + centroid),
        "tracts_2020": spark.createDataFrame([("01001000100", 1.0, 7.0)], "tract_fips string, " + centroid),
        "tracts_2010": spark.createDataFrame([("01003000100", 3.0, 3.0)], "tract_fips_2010 string, lon_10 double, lat_10 double"),
        "counties": counties,
        "hpi": hpi,
        "layers": [Layer(layer, "city_places", 1.0)],
    }


@pytest.fixture(scope="module")
def outcome(spark, tmp_path_factory, dims):
    base = tmp_path_factory.mktemp("etl")
    annual, deeds = raw_rows()
    inputs = etl.Inputs(
        annual=write_raw(base / "annual.txt", schemas.ANNUAL, annual),
        deeds=write_raw(base / "deeds.txt", schemas.DEEDS, deeds),
        history=write_raw(base / "history.txt", schemas.HISTORY, [{"PropertyID": 1, "AssdYear": 2018}, {"FIPS": "x"}]),
        work=str(base / "work"),
        **dims,
    )
    return inputs, etl.run(spark, inputs), annual, deeds


def test_counts_reconcile(outcome):
    _, out, annual, deeds = outcome
    assert out["annual_count"].first().matches and out["deeds_count"].first().matches
    assert out["annual"].count() == sum(r["PropertyClassID"] == "R" for r in annual)
    assert out["history_count"].first().raw_rows == 1


def test_crosswalk_fallback_and_duplicates(outcome):
    _, out, _, _ = outcome
    rows = {}
    for r in out["crosswalk"].collect():
        rows.setdefault(r.PropertyID, []).append(r)
    # odd ids: longitude from the tract (the block group has none), latitude from the block group
    # even ids in the other county: both from the 2010 tract; all missing ones are even here
    assert (rows[10][0].SitusLongitude, rows[10][0].SitusLatitude) == (3.0, 3.0)
    assert all(r[0].valid_geometry == 1 and len(r[0].geohash) == 18 for r in rows.values())
    inside_two = [k for k, v in rows.items() if len(v) > 1]
    assert inside_two and {r.city_geoid for r in rows[inside_two[0]]} == {"0100002", "0100003"}
    assert {r.PropertyID for r in out["crosswalk_duplicates"].collect()} == set(inside_two)
    assert out["crosswalk_missing"].first().missing_keys == 0
    assert any(v[0].city_geoid is None for v in rows.values())


def test_sales_follow_the_rules(outcome):
    _, out, annual, deeds = outcome
    newest = {}
    for d in deeds:
        year = int(d["RecordingDate"][:4])
        if year >= 2019:
            key = (d["PropertyID"], year)
            best = newest.get(key)
            if best is None or (d["RecordingDate"], ) > (best["RecordingDate"], ) or (
                d["RecordingDate"] == best["RecordingDate"] and d["FATransactionID"] < best["FATransactionID"]
            ):
                newest[key] = d
    expected = {
        k for k, d in newest.items() if d["FATransactionID"][0] in "16" and d["TransactionType"] in "23"
    }
    got = {(r.PropertyID, r.SaleRecordingYear) for r in out["ranked_sales"].collect()}
    assert got == expected
    roll = {r["PropertyID"]: r for r in annual if r["PropertyClassID"] == "R"}
    staged = {(r.PropertyID, r.SaleRecordingYear) for r in out["sales_staging"].collect()}
    assert staged == {(p, y) for p, y in expected if p in roll and roll[p]["TaxYear"] == y}


def test_second_run_reuses_every_stage(spark, outcome):
    inputs, out, _, _ = outcome
    moved = replace(inputs, annual=inputs.annual + ".gone", history=None)
    again = etl.run(spark, moved)
    assert "annual_count" not in again and again["deeds_count"].first().matches
    with pytest.raises(FileNotFoundError):
        etl.run(spark, replace(moved, work=inputs.work + "-new"))
    assert again["summary"].count() == out["summary"].count()
    tables = export.export_queries(again["summary"], [SNAPSHOT], ["Total", "SaleAmt_Quintile"], "city_geoid", inputs.work + "/queries")
    assert len(tables) == 2


def test_tiles_do_not_depend_on_partitioning(spark, outcome):
    _, out, _, _ = outcome
    before = spark.conf.get("spark.sql.shuffle.partitions")
    keys = ("PropertyID", "SaleAmt_County_Percentile", "TaxRate_County_Percentile", "city_geoid")
    results = []
    try:
        for n, hot in (("1", 10_000), ("7", 10_000), ("3", 10)):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            shuffled = out["sales_staging"].repartition(int(n))
            tiles = etl.tile_sales(shuffled, tiebreak=["FATransactionID", "city_geoid"], hot_rows=hot)
            results.append(sorted(tuple(str(r[k]) for k in keys) for r in tiles.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]


def test_reports_and_combination(spark, outcome):
    inputs, out, _, _ = outcome
    cube = out["summary"]
    tables = {f: one_table(cube, "city_geoid", f, SNAPSHOT) for f in ("Total", "SaleBinsNarrow", "SaleBinsWide", "SaleBins")}
    total = report.total_report(tables["Total"])
    narrow = report.bin_report(tables["SaleBinsNarrow"], "SaleBinsNarrow", report.NARROW_LABELS)
    wide = report.bin_report(tables["SaleBinsWide"], "SaleBinsWide", report.WIDE_LABELS)
    eleven = report.bin_report(tables["SaleBins"], "SaleBins", report.ELEVEN_LABELS)
    populations = [r.city_population2022 for r in total.collect() if r.city_population2022 is not None]
    assert populations == sorted(populations, reverse=True)
    rows = [(2021, "t", "West", 100001, "West", "AL", "Alabama", 5, 0.01, 0.01, 0.01, 0.01)]
    types = "year int, table_state string, table_city string, place_id int, city_name string, state_code string, state_name string, population_2020 long, tax_rate_median_value double, tax_rate_median_value_assessment_limits double, tax_rate_150k double, tax_rate_300k double"
    benchmark = spark.createDataFrame(rows * 2, types)
    combined = report.combined_report(benchmark, total, narrow, wide, eleven)
    # a city whose bins peak in different years has one report row per year, so it repeats here too
    years = [narrow, wide, eleven]
    copies = [max(1, t.where("city_geoid = 100001").count()) for t in years]
    assert combined.count() == copies[0] * copies[1] * copies[2]
    row = combined.first().asDict()
    one = total.where("city_geoid = 100001").first()
    assert row["count"] == one["count"] and row["TaxRate_median"] == one.TaxRate_median
    assert {"count_120K_180K", "TaxRate_median_250K_350K", "bins_TaxRate_median_over1M"} <= row.keys()
    only = report.total_report(tables["Total"], cities=["0100001"])
    assert [r.city_geoid for r in only.collect()] == [100001]


def test_city_analysis_on_pipeline_output(spark, outcome):
    _, out, _, _ = outcome
    benchmark = spark.createDataFrame(
        [(100001, 1, "a", 0.01, 0.02, 0.03), (100001, 2, "b", 0.01, 0.05, 0.06), (100002, 3, "a", 0.02, 0.02, 0.02)],
        "place_id int, table_order int, table_group string, tax_rate_median_value double, tax_rate_150k double, tax_rate_300k double",
    )
    sales = analysis.busiest_year_sales(out["sales_staging_tiles"], benchmark)
    assert {r.city_geoid for r in sales.select("city_geoid").distinct().collect()} <= {"0100001", "0100002"}
    first = {r.place_id: r.statutory_tax_rate_150k for r in analysis.benchmark_rates(benchmark).collect()}
    assert first == {100001: 0.02, 100002: 0.02}
    assert analysis.boxplot_table(sales).count() == analysis.distribution_table(sales).count()
    spread = analysis.with_city_spread(sales)
    assert spread.count() == sales.count() and spread.where("sale_quintile between 1 and 5").count() == sales.count()


def test_county_crosswalk(frame):
    states = frame(
        [("AL", "01", "Alabama", "001", "Autauga"), ("AL", "01", "Alabama", "003", "Baldwin"), ("AL", "01", "Alabama", "005", "Barbour")],
        "state_codes string, state_fips string, state_name string, county_code string, county_name string",
    )
    cbsa = frame(
        [(33860, "Montgomery", "Metropolitan Statistical Area", "Central", "1", "1"), (19300, "Daphne", "Micropolitan Statistical Area", None, "1", "3")],
        "`CBSA Code` int, `CBSA Title` string, `Metropolitan/Micropolitan Statistical Area` string, `Central/Outlying County` string, `FIPS State Code` string, `FIPS County Code` string",
    )
    people = frame([("01001", 58805)], "GEOID string, estimate long")
    got = {r.county_fips: r for r in dimensions.county_crosswalk(states, cbsa, people).collect()}
    assert (got["01001"].area_type, got["01001"].cbsa_fips, got["01001"].county_pop20) == ("MSA", "33860", 58805.0)
    assert (got["01003"].area_type, got["01003"].central_outlying_county) == ("muSA", "Residual")
    assert (got["01005"].cbsa_fips, got["01005"].cbsa_title, got["01005"].area_type, got["01005"].county_pop20) == (
        "state_01",
        "Non-CBSA Alabama",
        "Non-CBSA",
        0.0,
    )


def test_places(spark, frame):
    estimates = frame(
        [("162", "1", "124", "Abbeville city", "Alabama", 1, 2, 30), ("162", "1", "460", "Adamsville city", "Alabama", 1, 2, 50), ("050", "1", "0", "x", "y", 1, 2, 99)],
        "SUMLEV string, STATE string, PLACE string, NAME string, STNAME string, POPESTIMATE2020 int, POPESTIMATE2021 int, POPESTIMATE2022 int",
    )
    population = dimensions.place_population(estimates)
    assert {r.placeid: r.city_rank for r in population.collect()} == {"0100460": 1, "0100124": 2}
    schema = T.StructType(
        [T.StructField(n, T.StringType()) for n in ("GEOID", "NAME", "STUSPS")] + [T.StructField("rings", schemas.RINGS)]
    )
    shapes = spark.createDataFrame(
        [("0100124", "Abbeville-Henry (part)", "AL", box(0.0, 0.0, 1.0, 1.0)), ("7200001", "Other", "PR", box(0.0, 0.0, 1.0, 1.0))], schema
    )
    (row,) = dimensions.city_places(shapes, population, ["AL"]).collect()
    assert (row.city_geoid, row.city_name, row.city_population2022, row.city_rank) == ("0100124", "Abbeville", 30, 2)
    layer = dimensions.polygon_layer(shapes, {"geoid": "school_geoid", "name": "school_name"})
    assert layer.columns == ["school_geoid", "school_name", "rings"]


def test_county_index_is_balanced(frame):
    counties = frame(
        [("AL", "01", "01001", "100"), ("AL", "01", "01003", "state_01"), ("PR", "72", "72001", "200")],
        "state_codes string, state_fips string, county_fips string, cbsa_fips string",
    )
    years = range(2000, 2023)
    county = frame([("01001", y, "." if y in (2000, 2010) else str(100 + y - 2000)) for y in years], "county_fips string, year int, hpi string")
    metro = frame([("100", y, q, "-" if q == 4 else str(200.0 + y - 2000)) for y in years for q in range(1, 5)], "fips string, year int, quarter int, index string")
    nonmetro = frame([("AL", y, 1, 300.0 + y - 2000) for y in years], "state string, year int, quarter int, index double")
    state = frame([("AL", y, 1, 400.0 + y - 2000) for y in years], "state_code string, year int, quarter int, index double")
    levels = dimensions.index_levels(counties, county, metro, nonmetro, state)
    rows = {(r.county_fips, r.year): r for r in levels.collect()}
    assert len(rows) == 2 * 24 and rows[("01001", 2010)].hpi_county is None
    assert rows[("01001", 2005)].hpi_metro == 205.0 and rows[("01003", 2005)].hpi_nonmetro == 305.0
    final = {(r.county_fips, r.year): r for r in dimensions.county_index(levels).collect()}
    assert len(final) == 48
    # a straight line is smoothed to itself, so the gap in 2010 is filled with (nearly) the line
    assert final[("01001", 2010)].hpi_index_2021 == pytest.approx(121 / 110, rel=1e-2)
    assert final[("01001", 2021)].hpi_index_2021 == 1.0 and final[("01003", 2021)].hpi_index_2021 == 1.0
    assert final[("01003", 2005)].hpi_index_2021 == pytest.approx(321 / 305)
    # a last year that the county file already holds is not added again
    inside = dimensions.index_levels(counties, county, metro, nonmetro, state, last_year=2022)
    assert inside.count() == 2 * 23 == inside.select("county_fips", "year").distinct().count()


def reasons(out):
    return {r.stage: r.reason for r in out["stages"].collect()}


def test_stages_are_rebuilt_when_what_they_are_built_from_changes(spark, outcome, tmp_path):
    inputs, out, annual, deeds = outcome
    assert set(reasons(out).values()) == {"missing", "grown"}
    own = replace(
        inputs,
        annual=write_raw(tmp_path / "annual.txt", schemas.ANNUAL, annual),
        deeds=write_raw(tmp_path / "deeds.txt", schemas.DEEDS, deeds),
        work=str(tmp_path / "work"),
        history=None,
    )
    first = etl.run(spark, own)
    assert set(reasons(etl.run(spark, own)).values()) == {None}
    later = etl.run(spark, replace(own, min_year=2020))
    assert {k for k, v in reasons(later).items() if v == "stale"} == {"ranked_sales", "sales_staging", "sales_staging_tiles", "summary"}
    assert later["ranked_sales"].where("SaleRecordingYear < 2020").isEmpty()
    with open(own.deeds, "a") as file:  # a row without an amount: the file changes, its rows do not
        file.write("\n")
    back = etl.run(spark, own)
    assert reasons(back)["deeds"] == "stale" and reasons(back)["annual"] is None
    assert back["summary"].count() == first["summary"].count() and back["deeds_count"].first().matches


def test_new_parcels_alone_are_geocoded(spark, outcome, tmp_path):
    inputs, out, annual, _ = outcome
    half = write_raw(tmp_path / "half.txt", schemas.ANNUAL, annual[::2])
    whole = write_raw(tmp_path / "whole.txt", schemas.ANNUAL, annual)
    grown = []
    for path in (half, whole, whole):
        roll = etl.clean_annual(etl.read_delimited(spark, path, schemas.ANNUAL))
        grown.append(etl.refresh_crosswalk(spark, roll, inputs, str(tmp_path / "crosswalk")))
    assert [g.segments for g in grown] == [1, 2, 2] and grown[2].new_keys == 0 and grown[1].new_keys < len(annual)
    columns = sorted(c for c in out["crosswalk"].columns)
    same = [sorted(tuple(map(str, r)) for r in df.select(*columns).collect()) for df in (out["crosswalk"], grown[2].rows)]
    assert same[0] == same[1]
    other = replace(inputs, layers=[replace(inputs.layers[0], cell=0.5)])
    anew = etl.refresh_crosswalk(spark, roll, other, str(tmp_path / "crosswalk"))
    assert anew.segments == 1 and anew.rows.count() == grown[2].rows.count()
