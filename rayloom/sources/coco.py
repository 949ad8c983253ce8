"""COCO documents as tables, and tables as COCO documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rayloom.functions.geometry import segmentation_box
from rayloom.functions.names import basename
from rayloom.sources.split_json import Plan, make_plan, read_elements, write_arrays

IMAGE = "id bigint, file_name string, width int, height int, AOI string, original_id bigint"
ANNOTATION = "id bigint, object_id bigint, image_id bigint, category_id int, iscrowd int, bbox array<double>, area double, segmentation array<array<double>>"
CATEGORY = "id int, name string, supercategory string"
DETECTION = "det_id bigint, image_id bigint, file_name string, bbox array<double>, area double, score double, det_class int, segmentation array<array<double>>, id bigint, category_id int, dataset string"


def open_documents(spark: SparkSession, path: str | Sequence[str] | Plan) -> Plan:
    """Where the arrays of one or many documents lie; work it out once to read several of them."""
    return path if isinstance(path, Plan) else make_plan(spark, path if isinstance(path, str) else list(path))


def _rows(spark: SparkSession, path: str | Sequence[str] | Plan, names: Sequence[str], schema: str) -> DataFrame:
    return read_elements(spark, open_documents(spark, path), names).select(F.from_json("value", schema).alias("r")).select("r.*")


def read_images(spark: SparkSession, path: str | Sequence[str] | Plan) -> DataFrame:
    """``image_id, file_name, ...`` of one or many documents, each read in byte ranges."""
    return _rows(spark, path, ["images"], IMAGE).withColumnRenamed("id", "image_id")


def read_annotations(spark: SparkSession, path: str | Sequence[str] | Plan) -> DataFrame:
    return _rows(spark, path, ["annotations"], ANNOTATION)


def read_categories(spark: SparkSession, path: str | Sequence[str] | Plan) -> DataFrame:
    return _rows(spark, path, ["categories"], CATEGORY)


def nested(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Images with their annotations as an array, empty where there is none."""
    row = F.struct(*annotations.columns)
    of = annotations.groupBy("image_id").agg(F.sort_array(F.collect_list(row)).alias("annotations"))
    return images.join(of, "image_id", "left").withColumn("annotations", F.coalesce("annotations", F.array().cast(of.schema["annotations"].dataType)))


def orphans(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations whose image isn't there."""
    return annotations.join(images.select("image_id"), "image_id", "left_anti")


def labels(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Ground truth: ``label_id, label_class, image_id, file_name, box, segmentation, area``, file names without folders."""
    named = images.select("image_id", basename(F.col("file_name")).alias("file_name"))
    told = annotations.select(F.col("id").alias("label_id"), F.col("category_id").alias("label_class"), "image_id", "segmentation", "area")
    return told.join(named, "image_id").withColumn("box", segmentation_box(F.col("segmentation")))


def read_detections(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Detections of several files, tagged with their dataset; a file holds an array of records or a COCO document.

    A missing ``det_id`` is the record's ``id``, a missing ``det_class`` its
    category less one.
    """
    found: DataFrame | None = None
    for dataset, path in paths.items():
        rows = _rows(spark, path, ["records", "annotations"], DETECTION).withColumn("dataset", F.lit(dataset))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return spark.createDataFrame([], DETECTION)
    return found.withColumn("det_id", F.coalesce("det_id", "id")).withColumn("det_class", F.coalesce("det_class", F.col("category_id") - 1)).withColumn("file_name", basename(F.col("file_name")))


def confident(dets: DataFrame, least: float) -> DataFrame:
    """Detections of at least a score; of a segmentation the first ring counts."""
    return dets.filter(F.col("score") >= least).withColumn("ring", F.get("segmentation", F.lit(0)))


def in_images(dets: DataFrame, images: DataFrame) -> DataFrame:
    """Detections joined with their images: by ``image_id`` where they have it, else by file name."""
    have = dets.filter("image_id IS NOT NULL").join(images.select("image_id"), "image_id", "left_semi")
    named = images.select(F.col("image_id").alias("_id"), basename(F.col("file_name")).alias("file_name"))
    lack = dets.filter("image_id IS NULL").join(named, "file_name").withColumn("image_id", F.col("_id")).drop("_id")
    return have.unionByName(lack.select(*have.columns))


def document(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """One row with the JSON of a COCO document.

    The format is one object, so the result has to fit a task; for more, write
    it with :func:`write_document`, or one per dataset with :func:`documents`.
    """
    gather = lambda df, name: df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))
    row = gather(images, "images").crossJoin(gather(annotations, "annotations")).crossJoin(gather(categories, "categories"))
    return row.select(F.to_json(F.struct("images", "annotations", "categories")).alias("value"))


def write_document(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str) -> None:
    """A COCO document of any size at ``path``, elements by id; no task holds more than its share of it."""
    write_arrays({"images": images, "annotations": annotations, "categories": categories}, path)


def write_records(records: DataFrame, path: str, order: str = "id") -> None:
    """An array of records of any size at ``path``."""
    write_arrays({"records": records}, path, order)


def documents(images: DataFrame, annotations: DataFrame, categories: DataFrame, by: str = "dataset") -> DataFrame:
    """``<by>, value``: a COCO document for each group of images."""
    whose = images.select(F.col("id").alias("image_id"), by)
    gather = lambda df, name, drop: df.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c != drop]))).alias(name))
    of_images, of_annotations = gather(images, "images", by), gather(annotations.join(whose, "image_id"), "annotations", by)
    named = categories.agg(F.sort_array(F.collect_list(F.struct(*categories.columns))).alias("categories"))
    empty = F.array().cast(of_annotations.schema["annotations"].dataType)
    met = of_images.join(of_annotations, by, "left").crossJoin(F.broadcast(named)).withColumn("annotations", F.coalesce("annotations", empty))
    return met.select(by, F.to_json(F.struct("images", "annotations", "categories")).alias("value"))


def yolo_lines(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """``file_name, line``: class from 0 and the first ring as shares of width and height."""
    size = images.select("image_id", "file_name", "width", "height")
    share = F.transform(F.get("segmentation", F.lit(0)), lambda v, i: F.round(v / F.when(i % 2 == 0, F.col("width")).otherwise(F.col("height")), 6))
    line = F.concat_ws(" ", (F.col("category_id") - 1).cast("string"), F.array_join(F.transform(share, lambda v: v.cast("string")), " "))
    return annotations.select("image_id", "category_id", "segmentation").join(size, "image_id").select("file_name", line.alias("line"))


def from_centre(bbox: str = "bbox"):
    """``[cx, cy, w, h]``, as detectors give it, as COCO's corner form."""
    c = F.col(bbox)
    return F.array(c[0] - c[2] / 2, c[1] - c[3] / 2, c[2], c[3])


def number_of_classes(spark: SparkSession, path: str | Sequence[str]) -> int:
    """How many categories a document names; an error for none."""
    n = read_categories(spark, path).count()
    if not n:
        raise ValueError(f"no categories in {path}")
    return n


def read_clipped_labels(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Labels of several documents, each tagged with its dataset: ``dataset`` and the columns of :func:`labels`."""
    found: DataFrame | None = None
    for dataset, path in paths.items():
        some = labels(read_images(spark, path), read_annotations(spark, path)).withColumn("dataset", F.lit(dataset))
        found = some if found is None else found.unionByName(some)
    if found is None:
        raise ValueError("no documents")
    return found
