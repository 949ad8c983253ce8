"""Counts, precision, recall and F1: by class, over thresholds, as a confusion table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rayloom.operators.matching import best_labels

METHODS = ("macro-average", "macro-weighted-average", "micro-average")


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1_score(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def by_class(tags: DataFrame, classes: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """``<by>, class, tp, fp, fn, precision, recall`` of tagged rows, a row for every class."""
    known = F.when(F.col("tag") == "FN", F.col("label_class") - 1).otherwise(F.col("det_class"))
    count = lambda tag: F.count_if((F.col("tag") == tag) & (F.col("known") == F.col("class"))).alias(tag.lower())
    each = tags.withColumn("known", known).withColumn("class", F.explode(F.array(*[F.lit(c) for c in classes])))
    counts = each.groupBy(*by, "class").agg(count("TP"), count("FP"), count("FN"))
    return counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))


def summary(classes: DataFrame, method: str = "macro-average", by: Sequence[str] = ()) -> DataFrame:
    """``<by>, tp, fp, fn, precision, recall, f1`` over the classes of :func:`by_class`.

    The weighted average weighs a class by its share of labels and divides by
    the number of classes all the same.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    labels = F.col("tp") + F.col("fn")
    if method == "micro-average":
        precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    elif method == "macro-average":
        precision, recall = F.avg("precision"), F.avg("recall")
    else:
        precision, recall = (ratio(F.sum(labels * F.col(c)), F.sum(labels)) / F.count("*") for c in ("precision", "recall"))
    grouped = classes.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), precision.alias("precision"), recall.alias("recall"))
    return grouped.withColumn("f1", f1_score(F.col("precision"), F.col("recall")))


def threshold_grid(least: float, step: float = 0.05) -> list[float]:
    """Thresholds from the half that is nearest below the least score up to 1, 1 not included."""
    first = round(2 * least, 1) / 2
    return [round(first + k * step, 4) for k in range(int((1 - first) / step + 0.999999)) if first + k * step < 1 - 1e-9]


def sweep(dets: DataFrame, labels: DataFrame, thresholds: Sequence[float], least_iou: float = 0.25, keys: Sequence[str] = ("image_id",), cell: float = 32.0) -> DataFrame:
    """``threshold, tp, fp, fn, precision, recall, f1`` at each score threshold.

    A detection's best label does not depend on the threshold, and a label is
    found where any of the detections that it is the best label of is above
    it.  So the spatial join runs once, and a threshold needs only the highest
    score per label.
    """
    spark = dets.sparkSession
    best = best_labels(dets, labels, keys, cell=cell, carry=["score"]).filter(F.col("iou") >= least_iou)
    tops = best.groupBy("label_id", *keys).agg(F.max("score").alias("score"))
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    above = lambda df, n: df.select(F.explode(F.filter(grid, lambda t: t <= F.col("score"))).alias("threshold")).groupBy("threshold").agg(F.count("*").alias(n))
    total = labels.agg(F.count("*").alias("n_labels"))
    rows = spark.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    out = rows.join(above(tops, "tp"), "threshold", "left").join(above(dets.select("score"), "n_dets"), "threshold", "left").crossJoin(F.broadcast(total)).fillna(0)
    out = out.select("threshold", "tp", (F.col("n_dets") - F.col("tp")).alias("fp"), (F.col("n_labels") - F.col("tp")).alias("fn"))
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", f1_score(F.col("precision"), F.col("recall")))


def best_threshold(swept: DataFrame) -> DataFrame:
    """The row of highest F1; the lowest threshold of several."""
    return swept.orderBy(F.col("f1").desc(), "threshold").limit(1)


def confusion(tags: DataFrame, true_col: str, found_col: str, names: Sequence[str], by: Sequence[str] = (), none: str = "background") -> DataFrame:
    """``<by>, true_class`` and a column of counts for each name and ``missed_labels``."""
    every = [*names, none]
    counted = tags.select(*by, F.coalesce(F.col(true_col), F.lit(none)).alias("true_class"), F.coalesce(F.col(found_col), F.lit(none)).alias("found"))
    table = counted.groupBy(*by, "true_class").pivot("found", every).agg(F.count(F.lit(1)))
    return table.fillna(0, every).withColumnRenamed(none, "missed_labels")


def with_categories(tags: DataFrame, categories: DataFrame) -> DataFrame:
    """Tagged rows with ``category`` of the label and ``det_category`` of the detection (``categories``: ``id, name``, ids from 1)."""
    of_labels = categories.select(F.col("id").cast("int").alias("label_class"), F.col("name").alias("category"))
    of_dets = categories.select((F.col("id") - 1).cast("int").alias("det_class"), F.col("name").alias("det_category"))
    return tags.join(of_labels, "label_class", "left").join(of_dets, "det_class", "left")


def report(tags: DataFrame, categories: DataFrame, method: str = "macro-average", by: Sequence[str] = ("dataset",)) -> dict[str, DataFrame]:
    """The tables of an evaluation by dataset: ``tagged``, ``by_class``, ``global`` and ``confusion``.

    ``categories`` is a table of a few rows; its names become columns.
    """
    known = categories.orderBy("id").collect()
    named = with_categories(tags, categories)
    classes = by_class(tags, [int(r.id) - 1 for r in known], by)
    return {
        "tagged": named,
        "by_class": classes.join(categories.select((F.col("id") - 1).cast("int").alias("class"), F.col("name").alias("category")), "class").orderBy(*by, "class"),
        "global": summary(classes, method, by),
        "confusion": confusion(named, "category", "det_category", sorted(r.name for r in known), by),
    }


def described(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, n, mean, std, min, q25, median, q75, max`` with exact quantiles."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("r")
    q = lambda p: F.percentile("v", p)
    return df.select(rows).select("r.*").groupBy("column").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), q(0.25).alias("q25"), q(0.5).alias("median"), q(0.75).alias("q75"), F.max("v").alias("max")
    )


def best_trials(progress: DataFrame, run_col: str = "run", precision: str = "precision", recall: str = "recall", map50: str = "map50") -> DataFrame:
    """Best precision, F1 and mAP of every run over its epochs; runs by F1, best first."""
    scored = progress.withColumn("f1", f1_score(F.col(precision), F.col(recall)))
    return scored.groupBy(run_col).agg(F.max(precision).alias("best_precision"), F.max("f1").alias("best_f1"), F.max(map50).alias("best_map50")).orderBy(F.col("best_f1").desc(), run_col)


def no_rows(spark: SparkSession, schema: str) -> DataFrame:
    """An empty table with a schema: "nothing found" rather than "not done"."""
    return spark.createDataFrame([], schema)
