"""Polygon layers: GeoJSON and ring-array parquet."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from millgauge.functions.geo import RING_TYPE, centroid, orient, ring_area

_RING = "array<array<double>>"


def _typed(ring_set: Column) -> Column:
    return F.transform(
        ring_set,
        lambda ring: F.transform(
            ring, lambda v: F.struct(v[0].cast("double").alias("x"), v[1].cast("double").alias("y"))
        ),
    )


def rings_of(geometry: Column) -> Column:
    """Oriented ring arrays of a GeoJSON geometry held as JSON text; other shapes give null."""
    kind = F.get_json_object(geometry, "$.type")
    text = F.get_json_object(geometry, "$.coordinates")
    single = F.from_json(text, f"array<{_RING}>")
    multi = F.from_json(text, f"array<array<{_RING}>>")
    return (
        F.when(kind == "Polygon", orient(_typed(single)))
        .when(kind == "MultiPolygon", F.flatten(F.transform(multi, lambda p: orient(_typed(p)))))
        .cast(RING_TYPE)
    )


def read_geojson(
    spark: SparkSession, path: str, properties: Mapping[str, T.DataType], lines: bool = False
) -> DataFrame:
    """Attributes and ``rings`` of a GeoJSON layer, from files of any size in many tasks.

    ``lines=True`` reads one feature per text line. Else the files hold feature collections whose features
    begin with ``"type": "Feature"``, as they are commonly written: the text is cut at that mark instead of
    at line ends, which Spark splits over tasks like lines, and each cut is parsed up to the end of its feature.
    A file whose features are written in another order of members is refused.
    """
    fields = T.StructType([T.StructField(n, t) for n, t in properties.items()])
    feature = T.StructType(
        [T.StructField("properties", fields), T.StructField("geometry", T.StringType())]
    )
    if lines:
        features = spark.read.schema(feature).json(path)
    else:
        cuts = spark.read.option("lineSep", '"Feature"').text(path)
        head = F.rlike("value", F.lit(r'^\s*\{(?s:.*)"FeatureCollection"'))
        follows = F.rlike("value", F.lit(r"^\s*,"))
        sound = F.when(~follows, F.raise_error(F.lit("a feature does not begin with its type")))
        whole = F.concat(F.lit('{"type":"Feature"'), "value")
        features = cuts.where(~head).select(F.coalesce(sound.cast("string"), whole).alias("value"))
        features = features.select(F.from_json("value", feature).alias("f")).select("f.*")
    return features.select("properties.*", rings_of(F.col("geometry")).alias("rings"))


def feature_text(df: DataFrame, rings: str = "rings") -> Column:
    """Each row as the JSON text of a feature.

    Counter-clockwise rings start a new polygon part and clockwise rings are its holes, the
    winding :func:`read_geojson` produces. A hole belongs to the shell before it.
    """
    closed = F.transform(
        rings,
        lambda r: F.when(r[0] == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1))),
    )
    pairs = F.transform(closed, lambda r: F.transform(r, lambda v: F.array(v["x"], v["y"])))
    empty = F.array().cast(f"array<array<{_RING}>>")
    parts = F.aggregate(
        F.arrays_zip(pairs.alias("ring"), F.transform(rings, ring_area).alias("area")),
        empty,
        lambda acc, item: F.when(
            (item["area"] >= 0) | (F.size(acc) == 0), F.concat(acc, F.array(F.array(item["ring"])))
        ).otherwise(
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.concat(F.element_at(acc, -1), F.array(item["ring"]))),
            )
        ),
    )
    attributes = [c for c in df.columns if c != rings]
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(*attributes).alias("properties"),
            F.struct(F.lit("MultiPolygon").alias("type"), parts.alias("coordinates")).alias(
                "geometry"
            ),
        )
    )


def write_geojson(df: DataFrame, path: str, rings: str = "rings") -> None:
    """Write a layer as GeoJSON text, one feature per line."""
    df.select(feature_text(df, rings).alias("value")).write.mode("overwrite").text(path)


def with_centroid(df: DataFrame, lon: str = "lon", lat: str = "lat", rings: str = "rings") -> DataFrame:
    """Attach the centroid of each polygon."""
    x, y = centroid(F.col(rings))
    return df.withColumns({lon: x, lat: y})


def centroids(
    df: DataFrame, keys: Sequence[str], lon: str = "lon", lat: str = "lat", rings: str = "rings"
) -> DataFrame:
    """Key columns and centroid only, without the geometry."""
    return with_centroid(df, lon, lat, rings).select(*keys, lon, lat)
