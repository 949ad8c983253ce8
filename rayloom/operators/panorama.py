"""From tiles back to panoramas: moved annotations, fragments grouped and merged."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rayloom.functions.geometry import segmentation_box, shifted
from rayloom.functions.outlines import closed, meet_within, united, united_area
from rayloom.functions.names import basename, tile_of, trimmed_jpg
from rayloom.operators.graph import connected_components
from rayloom.lineage import dealt_out, stored
from rayloom.operators.spatial import covered, overlap_pairs
from rayloom.operators.tiling import numbered_within

KEYS = ["dataset", "image_id"]


def to_panorama(dets: DataFrame, images: DataFrame) -> DataFrame:
    """Annotations of tiles in their panorama's pixels.

    ``dets``: ``id, file_name, dataset, segmentation`` and more, the name being
    a tile's; ``images``: ``image_id, file_name``.  An image is found by its
    stem.  Adds ``image_id, box``; names that fit no image are left out, see
    :func:`without_panorama`.
    """
    told = dets.withColumn("_tile", tile_of(basename(F.col("file_name")))).drop("image_id")
    named = images.select("image_id", trimmed_jpg(basename(F.col("file_name"))).alias("_stem"))
    met = told.withColumn("_stem", F.col("_tile.stem")).join(named, "_stem")
    moved = met.withColumn("segmentation", F.transform("segmentation", lambda r: shifted(r, F.col("_tile.x"), F.col("_tile.y"))))
    return moved.withColumn("box", segmentation_box(F.col("segmentation"))).drop("_tile", "_stem")


def without_panorama(dets: DataFrame, images: DataFrame) -> DataFrame:
    """Tile names, and how many images they fit, where that isn't one."""
    stems = dets.select("file_name", tile_of(basename(F.col("file_name")))["stem"].alias("_stem")).distinct()
    named = images.groupBy(trimmed_jpg(basename(F.col("file_name"))).alias("_stem")).agg(F.count("*").alias("n_images"))
    return stems.join(named, "_stem", "left").fillna(0, ["n_images"]).filter("n_images != 1").select("file_name", "n_images")


def fragment_pairs(dets: DataFrame, buffer: float = 1.0, cell: float = 128.0, touch: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Pairs of fragments (``<keys>, a, b``, a <= b) of one image and dataset whose boxes, grown by ``buffer``, meet.

    Each fragment also pairs with itself.  ``touch`` may look closer at two
    segmentations.
    """
    b = F.col("box")
    grown = F.struct((b["x"] - buffer).alias("x"), (b["y"] - buffer).alias("y"), (b["w"] + 2 * buffer).alias("w"), (b["h"] + 2 * buffer).alias("h"))
    some = dets.withColumn("box", grown)
    left = some.select(*KEYS, F.col("id").alias("a"), "box", F.col("segmentation").alias("seg_a"))
    right = some.select(*KEYS, F.col("id").alias("b"), "box", F.col("segmentation").alias("seg_b"))
    pairs = overlap_pairs(left, right, keys=KEYS, cell=cell).filter("a <= b")
    if touch is not None:
        pairs = pairs.filter((F.col("a") == F.col("b")) | touch(F.col("seg_a"), F.col("seg_b")))
    return pairs.select(*KEYS, "a", "b")


def fragment_links(dets: DataFrame, buffer: float = 1.0, cell: float = 1024.0) -> DataFrame:
    """``<keys>, a, b``: what joins the same fragments as all pairs of :func:`fragment_pairs` by boxes, a row for each cell that a fragment covers.

    ``b`` is the least fragment among those that are joined with ``a`` within
    the cell, ``a`` itself if there is no other.  So a dense spot gives as many
    links as it has fragments, not as many as it has pairs.
    """
    b = F.col("box")
    grown = F.struct((b["x"] - buffer).alias("x"), (b["y"] - buffer).alias("y"), (b["w"] + 2 * buffer).alias("w"), (b["h"] + 2 * buffer).alias("h"))
    on = [*KEYS, "cell_x", "cell_y"]
    ends = [F.col("box.x").alias("x0"), (F.col("box.x") + F.col("box.w")).alias("x1"), F.col("box.y").alias("y0"), (F.col("box.y") + F.col("box.h")).alias("y1")]
    rows = covered(dets.select(*KEYS, "id", grown.alias("box")).dropna(subset=KEYS), "box", cell).select(*on, "id", *ends)

    def linked(some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values("id", ignore_index=True)
        x0, x1, y0, y1 = (some[c].to_numpy(float) for c in ("x0", "x1", "y0", "y1"))
        of, rest = np.arange(len(some)), np.arange(len(some))
        while len(rest):
            head, rest = rest[0], rest[1:]
            todo = [head]
            while todo and len(rest):
                k = todo.pop()
                near = (x0[rest] <= x1[k]) & (x1[rest] >= x0[k]) & (y0[rest] <= y1[k]) & (y1[rest] >= y0[k])
                of[rest[near]] = head
                todo += rest[near].tolist()
                rest = rest[~near]
        return some[[*KEYS, "id"]].rename(columns={"id": "a"}).assign(b=some["id"].to_numpy()[of])

    types = dict(rows.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in KEYS], f"a {types['id']}", f"b {types['id']}"])
    return dealt_out(rows, *on).groupBy(*on).applyInPandas(linked, schema)


def grouped(pairs: DataFrame) -> DataFrame:
    """``<keys>, id, group_id``: fragments joined by pairs; a group has the id of its least fragment.

    A node is a fragment of one image and dataset, so equal shapes on two
    images stay apart.
    """
    node = lambda c: F.struct(*KEYS, F.col(c).alias("id"))
    named = connected_components(pairs.select(node("b").alias("a"), node("a").alias("b")))
    return named.select("node.*", F.col("component.id").alias("group_id"))


def merged(dets: DataFrame, pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """One annotation per group: least id, all rings, the box around them, the pairs' median score.

    Every pair counts both of its scores, so a fragment weighs as often as it
    is in a pair, and twice in the one with itself.
    """
    scores = dets.select(*KEYS, "id", "score")
    often = pairs.select(*KEYS, F.explode(F.array("a", "b")).alias("id")).groupBy(*KEYS, "id").agg(F.count("*").alias("often"))  # where pairs are made: they are never shuffled
    ends = often.join(scores, [*KEYS, "id"]).join(groups, [*KEYS, "id"])
    medians = ends.groupBy(*KEYS, "group_id").agg(F.percentile("score", F.lit(0.5), F.col("often")).alias("score"))
    x, y = F.min("box.x"), F.min("box.y")
    shape = dets.join(groups, [*KEYS, "id"]).groupBy(*KEYS, "group_id").agg(
        F.min("category_id").alias("category_id"),
        F.count("*").alias("n_fragments"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("id", "segmentation"))), lambda s: s["segmentation"])).alias("segmentation"),
        F.struct(x.alias("x"), y.alias("y"), (F.max(F.col("box.x") + F.col("box.w")) - x).alias("w"), (F.max(F.col("box.y") + F.col("box.h")) - y).alias("h")).alias("box"),
    )
    return shape.join(medians, [*KEYS, "group_id"]).withColumnRenamed("group_id", "id")


def merge_fragments(dets: DataFrame, buffer: float = 1.0, outlined: bool = False) -> DataFrame:
    """Fragments merged where their boxes, grown by ``buffer``, meet, or, if ``outlined``, where their outlines do."""
    pairs = fragment_pairs(dets, buffer, touch=meet_within(buffer) if outlined else None)
    return merged(dets, pairs, stored(grouped(pairs if outlined else fragment_links(dets, buffer)), "groups"))


def dissolved(objects: DataFrame, buffer: float = 0.0) -> DataFrame:
    """Merged fragments with the outlines of their union as segmentation, and its ``area``; gaps of less than two ``buffer`` are filled."""
    if buffer > 0:
        objects = objects.withColumn("segmentation", closed(buffer)("segmentation"))
        return objects.withColumn("area", united_area("segmentation")).withColumn("box", segmentation_box(F.col("segmentation")))
    return objects.withColumn("area", united_area("segmentation")).withColumn("segmentation", united("segmentation"))


def per_dataset(dets: DataFrame, images: DataFrame, buffer: float = 1.0, least_score: float = 0.2, outlined: bool = False) -> DataFrame:
    """Panorama annotations of all datasets: detections from ``least_score`` on moved, grouped and dissolved, numbered within each.

    ``outlined``: fragments are grown by their outlines rather than by their
    boxes, and what is merged is shrunk again.

    The export of one dataset is a filter on ``dataset``.
    """
    moved = stored(to_panorama(dets.filter(F.col("score") >= least_score), images), "panorama")
    return numbered_within(dissolved(merge_fragments(moved, buffer, outlined), buffer if outlined else 0.0).withColumnRenamed("id", "fragment_id"), ["image_id", "fragment_id"], "id", ["dataset"])
