"""Boxes, images, points, poses and rays derived from the test tables, the same in Spark and in SQL.

Coordinates come from integer arithmetic on unique keys, so areas and counts
are exact in either engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rayloom.functions.camera import vector
from rayloom.functions.geometry import box


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        k.alias("label_id"),
        (k % 50).alias("image_id"),
        box((k * 37) % 480, (k * 53) % 480, (20 + s % 12).cast("long"), (20 + s % 9).cast("long")).alias("box"),
        (1 + s % 3).cast("int").alias("label_class"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several a label, near it; those of a seventh of the labels lie beside the image, so that labels are missed."""
    o = F.col("o_orderkey")
    rows = table(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    told = labels(spark, sf_dir).select(F.col("label_id").alias("of"), "image_id", F.col("box").alias("b"), "label_class")
    moved = table(spark, sf_dir, "orders").select("o_orderkey").crossJoin(F.broadcast(rows)).withColumn("of", o % F.col("n")).join(told, "of")  # one row
    return moved.select(
        o.alias("det_id"),
        "image_id",
        box(F.col("b.x") + o % 23 - 11 + F.when(F.col("of") % 7 == 3, 600).otherwise(0), F.col("b.y") + o % 19 - 9, F.col("b.w"), F.col("b.h")).alias("box"),
        (((o * 31 + F.floor(o / 7)) % 100) / 100).alias("score"),
        F.when(o % 10 == 0, F.lit(0)).otherwise(F.col("label_class") - 1).cast("int").alias("det_class"),
    )


LABELS_SQL = """labels AS MATERIALIZED (SELECT p_partkey AS label_id, p_partkey % 50 AS image_id, (p_partkey * 37) % 480 AS x, (p_partkey * 53) % 480 AS y,
  (20 + p_size % 12)::BIGINT AS w, (20 + p_size % 9)::BIGINT AS h, (1 + p_size % 3)::INT AS label_class FROM part)"""
DETECTIONS_SQL = """dets AS MATERIALIZED (SELECT o_orderkey AS det_id, l.image_id, l.x + o_orderkey % 23 - 11 + CASE WHEN l.label_id % 7 = 3 THEN 600 ELSE 0 END AS x, l.y + o_orderkey % 19 - 9 AS y, l.w, l.h,
  ((o_orderkey * 31 + o_orderkey // 7) % 100) / 100.0::DOUBLE AS score, (CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE l.label_class - 1 END)::INT AS det_class
  FROM (SELECT o_orderkey, o_orderkey % n AS of FROM orders CROSS JOIN (SELECT count(*) AS n FROM part)) o JOIN labels l ON l.label_id = o.of)"""
OVERLAP = "greatest(least(d.x + d.w, l.x + l.w) - greatest(d.x, l.x), 0) * greatest(least(d.y + d.h, l.y + l.h) - greatest(d.y, l.y), 0)"
BEST_SQL = f"""pairs AS (SELECT d.det_id, d.image_id, d.score, d.det_class, l.label_id, l.label_class,
  ({OVERLAP})::DOUBLE / nullif(d.w * d.h + l.w * l.h - {OVERLAP}, 0) AS iou
  FROM dets d JOIN labels l ON d.image_id = l.image_id AND d.x <= l.x + l.w AND l.x <= d.x + d.w AND d.y <= l.y + l.h AND l.y <= d.y + d.h),
best AS MATERIALIZED (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY det_id ORDER BY iou DESC, label_id) = 1)"""
HITS_SQL = "hits AS MATERIALIZED (SELECT * FROM best WHERE iou >= 0.25 QUALIFY row_number() OVER (PARTITION BY label_id ORDER BY iou DESC, det_id) = 1)"
TAGS_SQL = """tags AS (
  SELECT CASE WHEN h.det_id IS NULL THEN 'FP' ELSE 'TP' END AS tag, h.label_id, h.label_class, d.det_id, d.score, d.det_class, round(h.iou, 3) AS iou, d.image_id
  FROM dets d LEFT JOIN hits h ON h.det_id = d.det_id
  UNION ALL SELECT 'FN', l.label_id, l.label_class, NULL, NULL, NULL, NULL, l.image_id FROM labels l LEFT JOIN hits h ON h.label_id = l.label_id WHERE h.label_id IS NULL)"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panoramas of three kinds: size, overlap and padding of each."""
    k = F.col("n_nationkey").cast("long")
    pick = lambda *v: F.when(k % 3 == 0, v[0]).when(k % 3 == 1, v[1]).otherwise(v[2])
    return table(spark, sf_dir, "nation").select(
        k.alias("image_id"),
        F.concat(F.lit("raw/pano_"), k.cast("string"), F.lit(".jpg")).alias("file_name"),
        pick(8000, 2048, 4016).alias("width"),
        pick(4000, 2048, 4016).alias("height"),
        pick(44, 0, 74).alias("overlap_x"),
        pick(8, 0, 74).alias("overlap_y"),
        pick(736, 0, 0).alias("padding_y"),
    )


IMAGES_SQL = """images AS (SELECT n_nationkey::BIGINT AS image_id, 'raw/pano_' || n_nationkey || '.jpg' AS file_name, k, [8000, 2048, 4016][k] AS width, [4000, 2048, 4016][k] AS height,
  [44, 0, 74][k] AS overlap_x, [8, 0, 74][k] AS overlap_y, [736, 0, 0][k] AS padding_y FROM (SELECT *, n_nationkey % 3 + 1 AS k FROM nation))"""


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes on the panoramas, some beyond their edges, with the box as ring."""
    k = F.col("p_partkey")
    x, y = (k * 97) % 8300 - 150, (k * 61) % 4300 - 150
    w, h = (30 + F.col("p_size") % 40).cast("long"), (30 + F.col("p_size") % 30).cast("long")
    rows = table(spark, sf_dir, "part").select(k.alias("ann_id"), (k % 25).alias("image_id"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    x, y, w, h = (F.col(c).cast("double") for c in "xywh")
    ring = F.array(x, y, x + w, y, x + w, y + h, x, y + h)
    return rows.select("ann_id", "image_id", F.array(x, y, w, h).alias("bbox"), F.array(ring).alias("segmentation"))


ANNOTATIONS_SQL = """anns AS (SELECT p_partkey AS ann_id, p_partkey % 25 AS image_id, ((p_partkey * 97) % 8300 - 150)::DOUBLE AS x, ((p_partkey * 61) % 4300 - 150)::DOUBLE AS y,
  (30 + p_size % 40)::DOUBLE AS w, (30 + p_size % 30)::DOUBLE AS h FROM part)"""


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on a square of 10 by 10 kilometres."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), ((k * 7919) % 10007).cast("double").alias("x"), ((k * 104729) % 10009).cast("double").alias("y"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("sid"), ((k * 6101) % 10007).cast("double").alias("sx"), ((k * 7001) % 10009).cast("double").alias("sy"))


CUSTOMERS_SQL = "points AS (SELECT c_custkey AS id, ((c_custkey * 7919) % 10007)::DOUBLE AS x, ((c_custkey * 104729) % 10009)::DOUBLE AS y FROM customer)"
SUPPLIERS_SQL = "sites AS (SELECT s_suppkey AS sid, ((s_suppkey * 6101) % 10007)::DOUBLE AS sx, ((s_suppkey * 7001) % 10009)::DOUBLE AS sy FROM supplier)"


def rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays of the frames of trajectories, each to one of a row of targets below the camera."""
    e = F.col("event_id")
    frame = F.floor(e / 3)
    step = F.pmod(frame, F.lit(50))
    ox, oy, oz = (step * 4).cast("double"), F.lit(0.0), F.lit(3.0)
    target = (F.floor(step / 2) * 8 + (e % 3) * 8 - 4).cast("double")
    tx, ty, tz = target, (6 + e % 3).cast("double"), F.lit(0.0)
    dx, dy, dz = tx - ox, ty - oy, tz - oz
    n = F.sqrt(dx * dx + dy * dy + dz * dz)
    return table(spark, sf_dir, "events").select(F.floor(e / 150).alias("trajectory"), e.alias("ray_id"), frame.alias("frame"), vector(ox, oy, oz).alias("origin"), vector(dx / n, dy / n, dz / n).alias("direction"))


RAYS_SQL = """raw AS (SELECT event_id // 150 AS trajectory, event_id AS ray_id, event_id // 3 AS frame, (((event_id // 3) % 50) * 4)::DOUBLE AS ox, 0.0::DOUBLE AS oy, 3.0::DOUBLE AS oz,
  ((((event_id // 3) % 50) // 2) * 8 + (event_id % 3) * 8 - 4)::DOUBLE AS tx, (6 + event_id % 3)::DOUBLE AS ty FROM events),
sized AS (SELECT *, sqrt((tx - ox) * (tx - ox) + (ty - oy) * (ty - oy) + (0 - oz) * (0 - oz)) AS n FROM raw),
rays AS (SELECT trajectory, ray_id, frame, ox, oy, oz, (tx - ox) / n AS dx, (ty - oy) / n AS dy, (0 - oz) / n AS dz FROM sized)"""
