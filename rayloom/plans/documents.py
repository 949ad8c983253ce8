"""Registered queries that write documents and read them again, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rayloom.lineage import scratch
from rayloom.plans import relations as R
from rayloom.plans.queries import query, rounded
from rayloom.sources import coco, geopackage


def _written(spark: SparkSession, sf_dir: str) -> str:
    """A COCO document of ``part``: an image a brand, an annotation a part, of which some name an image that isn't there."""
    k = F.col("p_partkey")
    part = R.table(spark, sf_dir, "part")
    brand = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("bigint")
    images = part.groupBy(brand.alias("id")).agg(F.min("p_brand").alias("brand")).filter("id % 10 < 5")
    images = images.select("id", F.concat(F.lit('img/{"'), "brand", F.lit('"}.jpg')).alias("file_name"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    x, y, w, h = ((k * 37) % 480).cast("double"), ((k * 53) % 480).cast("double"), (F.col("p_size") % 12 + 20).cast("double"), (F.col("p_size") % 9 + 20).cast("double")
    anns = part.select(k.alias("id"), brand.alias("image_id"), (F.col("p_size") % 3 + 1).alias("category_id"), F.array(x, y, w, h).alias("bbox"), (w * h).alias("area"), F.array(F.array(x, y, x + w, y, x + w, y + h, x, y + h)).alias("segmentation"))
    cats = part.groupBy((F.col("p_size") % 3 + 1).alias("id")).agg(F.lit("cover").alias("supercategory")).select("id", F.concat(F.lit("class \\ "), F.col("id").cast("string")).alias("name"), "supercategory")
    path = scratch(spark, "coco") + ".json"
    coco.write_document(images, anns, cats, path)
    return path


DOCUMENT_SQL = """WITH a AS (SELECT p_partkey AS id, regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT AS image_id, p_brand, (p_size % 3 + 1)::INT AS category_id, ((p_partkey * 37) % 480)::DOUBLE AS x, ((p_partkey * 53) % 480)::DOUBLE AS y,
  (p_size % 12 + 20)::DOUBLE AS w, (p_size % 9 + 20)::DOUBLE AS h FROM part)"""


@query(DOCUMENT_SQL + """ SELECT id AS label_id, category_id AS label_class, image_id, '{"' || p_brand || '"}.jpg' AS file_name, x, y, w, h, w * h AS area FROM a WHERE image_id % 10 < 5""")
def document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with images out of a document, read in ranges of 64 KB."""
    plan = coco.make_plan(spark, _written(spark, sf_dir), 64 << 10)
    told = coco.labels(coco.read_images(spark, plan), coco.read_annotations(spark, plan))
    return told.select("label_id", "label_class", "image_id", "file_name", F.col("box.x").alias("x"), F.col("box.y").alias("y"), F.col("box.w").alias("w"), F.col("box.h").alias("h"), "area")


@query(DOCUMENT_SQL + " SELECT image_id, category_id, 'class \\ ' || category_id AS name, count(*) AS n, sum(area) AS area, sum(id)::BIGINT AS ids FROM (SELECT *, w * h AS area FROM a) WHERE image_id % 10 >= 5 GROUP BY ALL")
def document_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of a document whose image it lacks, by category."""
    plan = coco.make_plan(spark, _written(spark, sf_dir), 64 << 10)
    lost = coco.orphans(coco.read_images(spark, plan), coco.read_annotations(spark, plan))
    named = coco.read_categories(spark, plan).select(F.col("id").alias("category_id"), "name")
    return lost.join(F.broadcast(named), "category_id").groupBy("image_id", "category_id", "name").agg(F.count("*").alias("n"), F.sum("area").alias("area"), F.sum("id").alias("ids"))


@query(DOCUMENT_SQL + """, d AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'val' ELSE 'trn' END AS dataset, CASE WHEN id % 3 = 0 THEN category_id - 1 ELSE 7 END AS det_class, round(((id * 31) % 100) / 100.0, 2)::DOUBLE AS score, p_brand FROM a)
SELECT dataset, det_class, count(*) AS n, round(sum(score), 6) AS score, sum(id)::BIGINT AS ids, min('p "' || p_brand || '"[].jpg') AS file_name FROM d WHERE score >= 0.3 GROUP BY ALL""")
def document_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confident detections of two files, one an array of records without ids of their own, one a document."""
    k = F.col("p_partkey")
    score = F.round(((k * 31) % 100) / 100, 2).alias("score")
    name = F.concat(F.lit('dets/p "'), "p_brand", F.lit('"[].jpg')).alias("file_name")
    part = R.table(spark, sf_dir, "part")
    box = F.array(*[F.lit(float(v)) for v in (4, 4, 2, 2)]).alias("bbox")
    records = part.filter(k % 3 == 0).select(k.alias("id"), name, (F.col("p_size") % 3 + 1).alias("category_id"), score, box)
    tagged = part.filter(k % 3 != 0).select(k.alias("id"), k.alias("det_id"), name, F.lit(1).alias("category_id"), F.lit(7).alias("det_class"), score, box)
    first, second = scratch(spark, "records") + ".json", scratch(spark, "detections") + ".json"
    coco.write_records(records, first)
    coco.write_document(part.select(k.alias("id")).limit(0), tagged, part.select(k.alias("id")).limit(0), second)
    told = coco.confident(coco.read_detections(spark, {"val": first, "trn": second}), 0.3)
    return rounded(told.groupBy("dataset", "det_class").agg(F.count("*").alias("n"), F.sum("score").alias("score"), F.sum("det_id").alias("ids"), F.min("file_name").alias("file_name")), "score")


@query(f"WITH {R.CUSTOMERS_SQL} SELECT id, x, y FROM points WHERE x BETWEEN 2000 AND 4000 AND y BETWEEN 1000 AND 2500")
def layer_in_a_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a layer that lie in a box, through its index."""
    folder = scratch(spark, "layer")
    geopackage.write_geopackage(R.customers(spark, sf_dir).repartition(4), folder, "places")
    told = geopackage.read_geopackage(spark, folder, "places", box=(2000.0, 1000.0, 4000.0, 2500.0), columns=["id"])
    return told.select(F.element_at("properties", "id").cast("bigint").alias("id"), "x", "y")
