import datetime as dt

from pyspark.sql import functions as F, types as T

from millgauge.functions import clean
from millgauge.plans import etl
from millgauge import schemas


def values(df, column):
    return [r[column] for r in df.collect()]


def test_pad_left_keeps_longer_codes(frame):
    df = frame([("1001",), ("01001",), ("123456",), (None,)], "c string")
    assert values(df.select(clean.pad_left(F.col("c"), 5).alias("p")), "p") == [
        "01001",
        "01001",
        "123456",
        None,
    ]


def test_parse_yyyymmdd_is_lenient(frame):
    df = frame(
        [("20190501",), ("20190500",), ("20190230",), ("x20200229y",), ("",), (None,)], "c string"
    )
    assert values(df.select(clean.parse_yyyymmdd(F.col("c")).alias("d")), "d") == [
        dt.date(2019, 5, 1),
        None,
        None,
        dt.date(2020, 2, 29),
        None,
        None,
    ]


def test_flags(frame):
    df = frame([("Y",), ("N",), ("",), (None,)], "c string")
    assert values(df.select(clean.flag(F.col("c"), ["Y"]).alias("f")), "f") == [True, None, None, None]
    df = frame([("T",), ("F",), ("U",), (None,)], "c string")
    assert values(df.select(clean.tri_flag(F.col("c"), "T", "F").alias("f")), "f") == [
        True,
        False,
        None,
        None,
    ]


def test_domain_compares_as_text(frame):
    df = frame([(3,), (30,), (None,)], "c int")
    assert values(df.select(clean.domain(F.col("c"), ["3"]).alias("v")), "v") == ["3", None, None]


def test_grouped_numbers(frame):
    df = frame([("104,125",), (".",), ("-",), ("",), ("junk",), ("-5.5",)], "c string")
    assert values(df.select(clean.grouped_number(F.col("c")).alias("n")), "n") == [
        104125.0,
        None,
        None,
        None,
        None,
        -5.5,
    ]


def test_concat_or_first(frame):
    df = frame([("a", "b"), ("a", None), (None, "b")], "x string, y string")
    got = values(df.select(clean.concat_or_first(F.col("x"), F.col("y")).alias("v")), "v")
    assert got == ["a_b", "a", None]


def test_substitute_covers_every_case(frame):
    rows = [(0.0, 5.0), (None, 5.0), (3.0, 5.0), (0.0, None), (None, None), (0.0, -1.0)]
    df = frame(rows, "a double, b double")
    a, b = F.col("a"), F.col("b")
    got = values(df.select(clean.substitute(a, b, a, b).alias("v")), "v")
    assert got == [5.0, 5.0, 3.0, 0.0, None, 0.0]


def test_recode_and_two_way(frame):
    df = frame([("x",), ("z",), (None,)], "c string")
    assert values(df.select(clean.recode(F.col("c"), {"x": "y"}, F.col("c")).alias("v")), "v") == [
        "y",
        "z",
        None,
    ]
    assert values(df.select(clean.two_way(F.col("c") == "x").alias("v")), "v") == [1, 0, None]


def test_sanitise_and_cast(frame):
    df = frame([("1", "x")], "`A b.c` string, `D/E (%)` string")
    out = clean.sanitise_columns(df)
    assert out.columns == ["a_b_c", "d_e____"]
    assert clean.cast_columns(out, {"a_b_c": "int", "d_e____": "int"}).first() == (1, None)


def raw(spark, schema, **cells):
    row = tuple(cells.get(f.name) for f in schema.fields)
    return spark.createDataFrame([row], schema)


def test_clean_annual_reads_input_columns_only(spark):
    """The joined code uses the unpadded parts although both are padded in the same step."""
    df = raw(
        spark,
        schemas.ANNUAL,
        PropertyID="17",
        PropertyClassID="R",
        FIPS="1001",
        SitusCensusTract="201",
        SitusCensusBlock="1",
        SitusLatitude=0.0,
        SitusLongitude=-86.5,
        LandUseCode=9310,
        OwnerOccupied="O",
        CurrentSaleRecordingDate="20200131",
        TaxAmt=123456.0,
        TaxYear=2020,
    )
    got = etl.clean_annual(df).first()
    assert got.PropertyID == 17 and got.FIPS == "01001" and got.SitusCensusTract == "000201"
    assert got.FIPS_SitusCensusTract == "1001_201"
    assert got.SitusLatitude is None and got.SitusLongitude == -86.5
    assert got.LandUseCode is None and got.OwnerOccupied is True
    assert got.TaxAmt == 1234.56 and got.CurrentSaleRecordingYear == 2020


def test_clean_annual_drops_other_classes_and_missing_ids(spark):
    df = raw(spark, schemas.ANNUAL, PropertyID="1", PropertyClassID="C").union(
        raw(spark, schemas.ANNUAL, PropertyClassID="R")
    )
    assert etl.clean_annual(df).count() == 0


def test_clean_deeds(spark):
    df = raw(
        spark,
        schemas.DEEDS,
        PropertyID="5",
        SaleAmt=1000.0,
        FATransactionID="1xy",
        RecordingDate="20190501",
        SaleDate="bad",
        MatchedFlag="Y",
        ArmsLengthFlag="F",
        TransactionType="9",
        DocumentType="DT",
        SalesPriceCode="44",
    )
    full = etl.clean_deed_fields(df).first()
    assert full.MatchedFlag is True and full.ArmsLengthFlag is False and full.ResaleFlag is None
    assert full.DocumentType == "DT" and full.TransactionType is None and full.SalesPriceCode == "44"
    got = etl.clean_deeds(df)
    assert tuple(got.columns) == etl.DEED_COLUMNS
    row = got.first()
    assert row.FATransactionID_1 == "1" and row.RecordingYear == 2019 and row.SaleYear is None
    assert etl.clean_deeds(raw(spark, schemas.DEEDS, PropertyID="5", SaleAmt=0.0)).count() == 0


def test_clean_history(spark):
    df = raw(spark, schemas.HISTORY, PropertyID="8", FIPS="1001", AssdYear=2018)
    row = etl.clean_history(df).first()
    assert row.PropertyID == 8 and row.FIPS == "01001" and row.AssdYear == 2018
    assert etl.clean_history(df).schema["AssdYear"].dataType == T.ShortType()
