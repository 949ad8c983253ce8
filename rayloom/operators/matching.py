"""Matching detections with labels, and points with points."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rayloom.functions.geometry import box_iou, boxes_meet
from rayloom.lineage import dealt_out, stored
from rayloom.operators.conserved import Conservation
from rayloom.operators.spatial import near_pairs


def best_labels(dets: DataFrame, labels: DataFrame, keys: Sequence[str] = ("image_id",), iou: Callable[[], Column] | None = None, cell: float = 32.0, carry: Sequence[str] = ()) -> DataFrame:
    """For each detection that meets a label, the label of highest IoU: ``det_id, label_id, iou``, the keys, and columns of ``dets`` to ``carry`` along.

    Of equal IoUs the least label id wins, so of labels with the same box only
    the one of least id is compared.  A detection is in one cell, that of its
    corner in the grid whose cells are as wide as it is (``cell``, doubled
    until it fits), and labels are dealt to the cells of the detections that
    they may meet.  So the detections are shuffled once, and the highest IoU
    and then, in a second pass over the same cells, its label are aggregated
    where they lie, by hash, without a sort of the pairs.  ``cell`` should be
    about the width of a usual box.  ``iou``, on ``left_box`` and
    ``right_box``, takes the place of the boxes' own.  Ids of detections are
    unique within the keys.
    """
    on = [*keys, "doubled", "cell_x", "cell_y"]  # no key is a double, which a join and an aggregate would shuffle by in different ways
    flat = lambda rows, side: rows.select("*", *[F.col("box")[c].alias(f"{side}_{c}") for c in "xywh"]).drop("box")
    box_of = lambda side: F.struct(*[F.col(f"{side}_{c}").alias(c) for c in "xywh"])
    size = F.pow(F.lit(2.0), F.col("doubled")) * cell
    at = lambda v: F.floor(v / size).cast("long")
    doubled = F.coalesce(F.greatest(F.floor(F.log2(F.greatest(F.col("box")["w"], F.col("box")["h"]) / cell)) + 1, F.lit(0)), F.lit(0)).cast("int").alias("doubled")

    some = flat(dets.select("det_id", "box", *keys, *carry, doubled), "left").withColumns({"cell_x": at(F.col("left_x")), "cell_y": at(F.col("left_y"))})
    some = dealt_out(some, *on)
    unlike = flat(labels.groupBy("box", *keys).agg(F.min("label_id").alias("label_id")), "right").crossJoin(F.broadcast(dets.select(doubled).distinct()))  # a few sizes
    for c, extent in (("x", "w"), ("y", "h")):
        low, high = F.col(f"right_{c}"), F.col(f"right_{c}") + F.col(f"right_{extent}")
        unlike = unlike.withColumn(f"cell_{c}", F.explode(F.sequence(at(low - size * (1 + 1e-9)), at(high))))
    unlike = dealt_out(unlike, *on)
    value = iou() if iou else box_iou(F.col("left_box"), F.col("right_box"))

    def scored(rows: DataFrame) -> DataFrame:
        met = rows.join(unlike, on).withColumn("left_box", box_of("left")).withColumn("right_box", box_of("right"))
        return met.filter(boxes_meet(F.col("left_box"), F.col("right_box"))).withColumn("iou", value)

    # Boxes are carried through the first aggregate as keys: joining them back by id would shuffle all detections again.
    top = scored(some).groupBy(*on, "det_id", *carry, *[f"left_{c}" for c in "xywh"]).agg(F.max("iou").alias("top"))
    of_top = F.min(F.when(F.col("iou") == F.col("top"), F.col("label_id")))  # as a filter it would be part of the join's condition, and the IoU be worked out several times
    found = scored(top).groupBy(*on, "det_id", *carry, "top").agg(of_top.alias("label_id")).filter(F.col("label_id").isNotNull())
    return found.select("det_id", "label_id", *keys, F.col("top").alias("iou"), *carry)


def matched(best: DataFrame, least_iou: float = 0.25, keys: Sequence[str] = ("image_id",), by: Sequence[str] = ()) -> DataFrame:
    """Of the detections whose best label is the same, the one of highest IoU; of equal ones the least id.

    A detection that loses its best label doesn't get another.
    """
    enough = best.filter(F.col("iou") >= least_iou)
    first = enough.groupBy("label_id", *keys, *by).agg(F.min(F.struct((-F.col("iou")).alias("worse"), "det_id")).alias("b"))
    return first.select("label_id", *keys, *by, F.col("b.det_id").alias("det_id"), (-F.col("b.worse")).alias("iou"))


def tagged(dets: DataFrame, labels: DataFrame, least_iou: float = 0.25, keys: Sequence[str] = ("image_id",), iou: Callable[[], Column] | None = None, cell: float = 32.0, check: Conservation | None = None) -> DataFrame:
    """Every detection and every label as TP, FP or FN.

    ``dets``: ``det_id, box, score, det_class`` and the keys; ``labels``:
    ``label_id, box, label_class`` and the keys.  Classes of detections start
    at 0 and those of labels at 1; a match of other classes is tagged all the
    same, with both classes to see it by.  Without labels all detections are
    FP, without detections all labels are FN.  IoU is rounded to 3 digits
    after the threshold is applied.  ``check`` counts what goes in and comes
    out as the plan runs, and expects that every detection is a TP or an FP
    and every label is found or an FN.
    """
    told_dets, told_labels = dets.select("det_id", "score", "det_class", *keys), labels.select("label_id", "label_class", *keys)
    won = matched(best_labels(dets, labels, keys, iou, cell), least_iou, keys)
    hits = stored(won.join(told_labels, ["label_id", *keys]), "hits")  # read twice; classes come with them, so that only hits meet labels
    if check is not None:
        told_dets, told_missing = check.watch(told_dets, "detections"), check.watch(told_labels, "labels")
    else:
        told_missing = told_labels
    found = told_dets.join(hits.select("det_id", "label_id", "label_class", "iou", *keys), ["det_id", *keys], "left")
    missed = told_missing.join(hits.select("label_id", *keys), ["label_id", *keys], "left_anti")
    of_dets = found.select(F.when(F.col("label_id").isNull(), "FP").otherwise("TP").alias("tag"), "label_id", "label_class", "det_id", "score", "det_class", F.round("iou", 3).alias("iou"), *keys)
    tags = of_dets.unionByName(missed.withColumn("tag", F.lit("FN")), allowMissingColumns=True)
    if check is None:
        return tags
    check.expect("tags.TP + tags.FP", "detections")
    check.expect("tags.TP + tags.FN", "labels")
    return check.watch(tags, "tags", **{t: F.col("tag") == t for t in ("TP", "FP", "FN")})


def _bands(points: DataFrame, reach: float, xy: Sequence[str], keys: Sequence[str]) -> list[float]:
    """Radii that double up to ``reach``; the first makes cells of about one point where points fill those of ``reach`` evenly."""
    cells = points.groupBy(*keys, *[F.floor(F.col(c) / reach).alias(f"cell_{i}") for i, c in enumerate(xy)]).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.count("*").alias("cells")).first()
    steps = math.ceil(math.log((cells.n or 1) / max(cells.cells, 1), 4)) if cells.cells else 0
    return [reach / 2**k for k in range(min(max(steps, 0), 20), -1, -1)]


def greedy_pairs(left: DataFrame, right: DataFrame, reach: float, left_xy: Sequence[str], right_xy: Sequence[str], left_id: str, right_id: str, keys: Sequence[str] = ()) -> DataFrame:
    """One-to-one pairs closer than ``reach``, taken in order of distance, then ids.

    Short distances are settled first, and only ends that are still free then
    are paired further away, so crowded places don't give all their pairs.
    Within a radius, each round takes every pair that is first for both of its
    ends and drops the pairs of ends that are taken: what one long pass in
    order would take.
    """
    cols = [*keys, left_id, right_id, "distance"]
    taken: DataFrame | None = None
    order = F.struct("distance", left_id, right_id)
    for radius in _bands(right, reach, right_xy, keys):
        open_pairs = stored(near_pairs(left, right, radius, left_xy, right_xy, keys, strict=True).select(*cols), "greedy")
        won: DataFrame | None = None
        while not open_pairs.isEmpty():
            of_left = open_pairs.groupBy(*keys, left_id).agg(F.min(order).alias("first_l"))
            of_right = open_pairs.groupBy(*keys, right_id).agg(F.min(order).alias("first_r"))
            both = open_pairs.join(of_left, [*keys, left_id]).join(of_right, [*keys, right_id])
            now = stored(both.filter((F.col("first_l") == F.col("first_r")) & (order == F.col("first_l"))).select(*cols), "taken")
            won = now if won is None else won.unionByName(now)
            rest = open_pairs.join(now.select(*keys, left_id), [*keys, left_id], "left_anti").join(now.select(*keys, right_id), [*keys, right_id], "left_anti")
            open_pairs = stored(rest, "greedy")
        if won is not None:
            taken = won if taken is None else taken.unionByName(won)
            if radius < reach:
                left = stored(left.join(won.select(*keys, left_id), [*keys, left_id], "left_anti"), "free")
                right = stored(right.join(won.select(*keys, right_id), [*keys, right_id], "left_anti"), "free")
    return open_pairs if taken is None else taken


def distance_report(pairs: DataFrame, n_left: DataFrame, n_right: DataFrame) -> DataFrame:
    """Counts, precision, recall, F1 and distance statistics of greedy pairs (``n_left``: truth, ``n_right``: found)."""
    stats = pairs.agg(
        F.count("*").alias("tp"),
        F.avg("distance").alias("mean_distance"),
        F.stddev_pop("distance").alias("std_distance"),
        F.min("distance").alias("min_distance"),
        F.max("distance").alias("max_distance"),
        F.median("distance").alias("median_distance"),
    )
    truth, found = n_left.agg(F.count("*").alias("n_truth")), n_right.agg(F.count("*").alias("n_found"))
    tp = F.col("tp")
    out = stats.crossJoin(truth).crossJoin(found)  # one row each
    precision, recall = F.coalesce(F.try_divide(tp, F.col("n_found")), F.lit(0.0)), F.coalesce(F.try_divide(tp, F.col("n_truth")), F.lit(0.0))
    return out.withColumns({"fp": F.col("n_found") - tp, "fn": F.col("n_truth") - tp, "precision": precision, "recall": recall}).withColumn(
        "f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    )
