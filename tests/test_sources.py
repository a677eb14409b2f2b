import json

import pytest
from pyspark.sql import functions as F, types as T

from millgauge.functions.geo import polygon_area
from millgauge.operators.summary import SNAPSHOT
from millgauge.schemas import BENCHMARK_RATES, RINGS
from millgauge.sources import delimited, export, polygons, staged

SCHEMA = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("price", T.DoubleType()),
    ]
)


def test_ragged_text_with_header(spark, tmp_path):
    path = tmp_path / "raw.txt"
    path.write_text("id|name|price|unused\n1|a|1.5|x\n2|b\n\nz|c|2.5|x\n4|d|bad|x\n5|e|3.5|x|extra\n")
    rows = delimited.read_delimited(spark, str(path), SCHEMA, report_bad=True)
    got = [tuple(r) for r in rows.orderBy("name").collect()]
    assert [g[:3] for g in got] == [
        (1, "a", 1.5),
        (2, "b", None),
        (None, "c", 2.5),
        (4, "d", None),
        (5, "e", 3.5),
    ]
    assert [g[3] is not None for g in got] == [False, True, True, True, True]


def test_columns_are_matched_by_name(spark, tmp_path):
    path = tmp_path / "raw.txt"
    path.write_text("price|id\n1.5|7\n")
    row = delimited.read_delimited(spark, str(path), SCHEMA).first()
    assert tuple(row) == (7, None, 1.5)


def test_files_with_another_header_are_refused(spark, tmp_path):
    (tmp_path / "a.txt").write_text("id|name|price\n1|a|1.5\n")
    (tmp_path / "b.txt").write_text("name|id|price\na|1|1.5\n")
    with pytest.raises(Exception, match="CSV header|does not conform"):
        delimited.read_delimited(spark, str(tmp_path), SCHEMA).collect()


def test_headerless_and_inferred(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("1,a,1.5\n")
    assert tuple(delimited.read_delimited(spark, str(path), SCHEMA, ",", header=False).first()) == (1, "a", 1.5)
    path = tmp_path / "typed.csv"
    path.write_text("n,day\n" + "1,2020-01-05\n" * 30)
    sniffed = delimited.read_inferred(spark, str(path))
    assert dict(sniffed.dtypes) == {"n": "bigint", "day": "date"}


def test_benchmark_rates_money(spark, tmp_path):
    names = [f.name for f in BENCHMARK_RATES.fields]
    cells = {n: "1" for n in names} | {"median_home_value": '"104,125"', "tax_bill_150k": "-"}
    path = tmp_path / "rates.csv"
    path.write_text(",".join(names) + "\n" + ",".join(cells[n] for n in names) + "\n")
    row = delimited.read_benchmark_rates(spark, str(path)).first()
    assert row.median_home_value == 104125.0 and row.tax_bill_150k is None and row.place_id == 1


def test_materialize_reuses_complete_and_rebuilds_broken(spark, tmp_path):
    path, calls = str(tmp_path / "stage"), []

    def build():
        calls.append(1)
        return spark.range(3)

    assert staged.materialize(spark, build, path).count() == 3
    assert staged.materialize(spark, build, path).count() == 3
    assert len(calls) == 1
    (tmp_path / "stage" / "_SUCCESS").unlink()
    assert staged.materialize(spark, build, path).count() == 3
    assert len(calls) == 2


def test_ingest_prefers_staged_then_raw_then_stops(spark, tmp_path):
    raw, stage = tmp_path / "raw.txt", str(tmp_path / "raw.parquet")
    read = lambda p: delimited.read_delimited(spark, p, SCHEMA)
    with pytest.raises(FileNotFoundError):
        staged.ingest(spark, stage, str(raw), read)
    raw.write_text("id|name|price\n1|a|1.5\n")
    assert staged.ingest(spark, stage, str(raw), read).count() == 1
    spark.range(5).write.parquet(stage)
    assert staged.ingest(spark, stage, str(raw), read).count() == 5


def test_read_keys_pushes_lists_and_joins_tables(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(50).select("id", (F.col("id") * 2).alias("v"), F.lit("x").alias("w")).write.parquet(path)
    listed = staged.read_keys(spark, path, ["v"], "id", [1, 3])
    assert sorted(r.v for r in listed.collect()) == [2, 6]
    assert "PushedFilters: [In(id, [1,3])]" in listed._jdf.queryExecution().executedPlan().toString()
    joined = staged.read_keys(spark, path, ["v"], "id", spark.createDataFrame([(1,), (3,), (3,)], "k long"))
    assert sorted(r.v for r in joined.collect()) == [2, 6]
    monkeypatch.setattr(staged, "LITERAL_LIST_LIMIT", 1)
    assert staged.read_keys(spark, path, ["v"], "id", [1, 3]).count() == 2


def test_append_and_compact(spark, tmp_path):
    source, target = str(tmp_path / "parts"), str(tmp_path / "one")
    for i in range(3):
        staged.append(spark.range(i * 10, i * 10 + 10).repartition(2), source)
    assert spark.read.parquet(source).count() == 30
    assert staged.compact(spark, source, target).count() == 30
    assert len(list((tmp_path / "one").glob("*.parquet"))) == 1


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b,c", 2)], "k string, v int")
    paths = export.export_tables({"first": df, "second": df.where("v = 1")}, str(tmp_path / "out"))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["first", "second"]
    back = spark.read.option("header", True).csv(paths[0])
    assert sorted(r.k for r in back.collect()) == ["a", "b,c"]
    with pytest.raises(ValueError):
        export.write_table(df, str(tmp_path / "x"), "xlsx")


def test_cube_export_writes_both_formats(spark, tmp_path):
    cube = spark.createDataFrame(
        [("Snapshot", "Total", "g", "Total", "2020", 1), ("Pooled", "Total", "g", "Total", "Post-2019", 2)],
        "mode string, bin_family string, city_geoid string, bin string, period string, count long",
    )
    export.export_cube(cube, str(tmp_path / "cube"))
    stage = spark.read.parquet(str(tmp_path / "cube"))
    (base,) = export.export_queries(stage, [SNAPSHOT], ["Total"], "city_geoid", str(tmp_path / "q"))
    assert base.endswith("Snapshot_city_geoid_Total_query")
    row = spark.read.parquet(base + ".parquet").first().asDict()
    assert row == {"city_geoid": "g", "Total": "Total", "SaleRecordingYear": 2020, "count": 1}
    assert spark.read.option("header", True).csv(base + ".csv").count() == 1


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def test_geojson_round_trip(spark, tmp_path):
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("rings", RINGS)])
    shell, hole = [(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (1, 3), (3, 3), (3, 1)]
    second = [(10, 0), (11, 0), (11, 1)]
    df = spark.createDataFrame(
        [("two", [ring(shell), ring(hole), ring(second)]), ("plain", [ring(second)])], schema
    )
    path = str(tmp_path / "layer")
    polygons.write_geojson(df, path)
    back = polygons.read_geojson(spark, path, {"name": T.StringType()}, lines=True)
    got = {r.name: r for r in back.withColumn("a", polygon_area(F.col("rings"))).collect()}
    assert got["two"].a == 12.5 and len(got["two"].rings) == 3 and got["plain"].a == 0.5


def test_feature_collection_with_unusual_winding(spark, tmp_path):
    path = tmp_path / "layer.geojson"
    path.write_text(
        '{"type":"FeatureCollection","features":['
        '{"type":"Feature","properties":{"geoid":"1","n":2},"geometry":{"type":"Polygon","coordinates":'
        "[[[0,0],[0,4],[4,4],[4,0],[0,0]],[[1,1],[3,1],[3,3],[1,3],[1,1]]]}},\n"
        '{"type":"Feature","properties":{"geoid":"2"},"geometry":{"type":"MultiPolygon","coordinates":'
        "[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}},"
        '{"type":"Feature","properties":{"geoid":"3"},"geometry":{"type":"Point","coordinates":[1,2]}}]}'
    )
    layer = polygons.read_geojson(spark, str(path), {"geoid": T.StringType(), "n": T.IntegerType()})
    got = {r.geoid: r.a for r in layer.withColumn("a", polygon_area(F.col("rings"))).collect()}
    assert got == {"1": 12.0, "2": 1.0, "3": None}


def test_types_are_found_in_all_rows(spark, tmp_path):
    """One cell among thousands decides, wherever it stands; nulls decide nothing."""
    columns = {
        "whole": ("7", "-12", "bigint"), "mixed": ("7", "1.5e3", "double"), "late": ("7", "n/a", "string"),
        "long": ("7", "9223372036854775808", "string"), "exact": ("0.5", "9007199254740993", "string"), "nan": ("1.5", "NaN", "string"),
        "day": ("2020-02-29", "2021-01-01", "date"), "no_day": ("2020-02-28", "2021-02-29", "string"),
        "time": ("2020-02-29", "2020-02-29 10:00:01.5", "timestamp"), "none": ("", "", "string"),
    }
    lines = [",".join(columns)] + [",".join(c[0] for c in columns.values())] * 3_000
    lines.insert(2_500, ",".join(c[1] for c in columns.values()))
    lines.insert(1_000, "," * (len(columns) - 1))
    (tmp_path / "cells.csv").write_text("\n".join(lines) + "\n")
    found = delimited.read_inferred(spark, str(tmp_path / "cells.csv"))
    assert dict(found.dtypes) == {n: c[2] for n, c in columns.items()}
    lost = [n for n in columns if n != "none" and found.where(F.col(n).isNull()).count() != 1]
    assert not lost and found.where("late = 'n/a'").count() == 1


def feature(k, kind="Polygon"):
    square = [[[k, 0], [k + 1, 0], [k + 1, 1], [k, 1], [k, 0]]]
    geometry = {"type": kind, "coordinates": square if kind == "Polygon" else [square]}
    return {"type": "Feature", "properties": {"id": k, "name": f'a "b", {{"type": {k}'}, "geometry": geometry}


def test_feature_collections_are_cut_between_features(spark, tmp_path):
    kinds = {"id": T.LongType(), "name": T.StringType()}
    layers = {"indented": json.dumps({"type": "FeatureCollection", "features": [feature(k) for k in range(300)]}, indent=1)}
    layers["dense"] = json.dumps({"type": "FeatureCollection", "features": [feature(k, "MultiPolygon") for k in range(300, 600)]}, separators=(",", ":"))
    layers["empty"] = json.dumps({"type": "FeatureCollection", "features": []})
    for name, text in layers.items():
        (tmp_path / f"{name}.json").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
        layer = polygons.read_geojson(spark, str(tmp_path), kinds)
        assert layer.rdd.getNumPartitions() > 3  # more tasks than files
        rows = {r.id: r for r in layer.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(rows) == list(range(600)) and rows[7].name == 'a "b", {"type": 7'
    assert all(len(r.rings) == 1 and r.rings[0][0].x == k for k, r in rows.items())


def test_features_in_another_order_are_refused(spark, tmp_path):
    turned = dict(reversed(feature(1).items()))
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": [turned]}))
    with pytest.raises(Exception, match="does not begin with its type"):
        polygons.read_geojson(spark, str(tmp_path), {"id": T.LongType()}).collect()
