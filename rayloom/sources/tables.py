"""Trajectories, vector layers, image lists and progress reports as tables; reports as files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rayloom.functions.names import basename, frame_of, literal_list, with_suffix

TRAJECTORY = "file_name string, datetimeoriginal string, x_m_ double, y_m_ double, z_m_ double, gpsimgdirection double, gpspitch double, gpsroll double, gps_sec_s_ double"
VENDOR = "items array<struct<dataSourceId:string,gpsWeekSeconds:double,imagePath:array<string>,x:double,y:double,z:double,rx:double,ry:double,rz:double>>"


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """Poses of a spherical camera: ``file_name, time, x, y, z, yaw, pitch, roll``, file names with their suffix."""
    raw = spark.read.csv(path, header=True, schema=TRAJECTORY, enforceSchema=False)
    return raw.select(
        with_suffix(F.col("file_name")).alias("file_name"),
        F.col("gps_sec_s_").alias("time"),
        *[F.col(f"{c}_m_").alias(c) for c in "xyz"],
        F.col("gpsimgdirection").alias("yaw"),
        F.col("gpspitch").alias("pitch"),
        F.col("gpsroll").alias("roll"),
    )


def read_vendor_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """Cube-map frames of a vendor's JSON files; malformed files and other sources than ``lb*`` are skipped.

    The frame's id comes from its first image's name.
    """
    items = spark.read.schema(VENDOR).json(path, multiLine=True, mode="DROPMALFORMED").select(F.inline("items"))
    kept = items.filter(F.col("dataSourceId").startswith("lb"))
    told = frame_of(basename(F.get("imagePath", F.lit(0))))
    return kept.withColumn("size", F.when(F.col("dataSourceId").startswith("lb4"), 2048).otherwise(4016)).withColumn("frame_id", told["frame_id"]).withColumn("camera_model", told["camera_model"])


def read_delimited(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    return spark.read.csv(path, header=True, sep=separator, inferSchema=True)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of a GeoJSON layer: ``kind``, ``properties`` (strings by name), ``x, y`` of points, outer ``rings`` of polygons."""
    schema = "features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.inline("features"))
    kind, said = F.col("geometry.type"), F.col("geometry.coordinates")
    point = F.from_json(said, "array<double>")
    one = F.transform(F.slice(F.from_json(said, "array<array<array<double>>>"), 1, 1), lambda r: r)
    many = F.transform(F.from_json(said, "array<array<array<array<double>>>>"), lambda p: F.get(p, F.lit(0)))
    rings = F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many)
    return rows.select(
        kind.alias("kind"),
        "properties",
        F.when(kind == "Point", F.get(point, F.lit(0))).alias("x"),
        F.when(kind == "Point", F.get(point, F.lit(1))).alias("y"),
        F.transform(rings, lambda r: F.flatten(F.transform(r, lambda p: F.slice(p, 1, 2)))).alias("rings"),
    )


def geojson_lines(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """``value``: a GeoJSON feature per row, point and all other columns as properties, one a line."""
    rest = [c for c in df.columns if c not in (x, y)]
    point = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*rest).alias("properties"))).alias("value"))


def image_info(images: DataFrame, bridge: DataFrame) -> DataFrame:
    """Images (``aoi, id, file_name``) with the id that each has in the merged set (``aoi, image_id, original_id``)."""
    named = images.withColumn("file_name", basename(F.col("file_name"))).withColumnRenamed("id", "original_id")
    return named.join(bridge.select("aoi", "image_id", "original_id"), ["aoi", "original_id"], "left").drop("original_id")


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """Training progress of many runs: ``run`` is the name of the file's folder."""
    rows = spark.read.csv(path, header=True, inferSchema=True).withColumn("run", F.element_at(F.split(F.input_file_name(), "/"), -2))
    return rows.withColumnsRenamed({"metrics/precision(M)": "precision", "metrics/recall(M)": "recall", "metrics/mAP50(M)": "map50"})


def with_paths(df: DataFrame, column: str = "imagePath") -> DataFrame:
    """Lists written as Python literals read as arrays."""
    return df.withColumn(column, literal_list(F.col(column)))


def bounds_by_file(points: DataFrame) -> DataFrame:
    """``filename, num_pts, minx, miny, maxx, maxy`` of point clouds that are tables (``filename, x, y``)."""
    return points.groupBy("filename").agg(F.count("x").alias("num_pts"), F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"))


def write_reports(reports: Mapping[str, DataFrame], folder: str, kind: str = "csv") -> None:
    """Each table as a folder of ``csv`` (with header), ``json`` or ``text`` files."""
    for name, df in reports.items():
        writer = df.write.mode("overwrite")
        writer.csv(f"{folder}/{name}", header=True) if kind == "csv" else getattr(writer, kind)(f"{folder}/{name}")
