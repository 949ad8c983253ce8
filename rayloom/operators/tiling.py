"""Tiles of panoramas, annotations clipped to them, splits and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rayloom.functions.geometry import borderline, box_in_tile, ring_area, ring_in_tile
from rayloom.functions.names import tile_name

TILE = 512
#: Share of an image's height below which a tile counts as low.
LOW = 0.5


def lot(*columns: str | Column, seed: int = 42) -> Column:
    """A number that only the columns and the seed decide, to draw samples by."""
    return F.xxhash64(F.lit(seed), *columns)


def starts(low: Column, high: Column, step: Column) -> Column:
    """``low, low + step, ...`` below ``high``."""
    last = high - 1
    return F.when(last >= low, F.sequence(low.cast("long"), last.cast("long"), step.cast("long"))).otherwise(F.array().cast("array<bigint>"))


def tiles(images: DataFrame, size: int = TILE) -> DataFrame:
    """A row for each tile of each image.

    ``images`` has ``image_id, file_name, width, height, overlap_x, overlap_y,
    padding_y``; tiles begin below the padding and step by the size less the
    overlap.  Adds ``tile_x, tile_y, tile_name``.
    """
    rows = starts(F.col("padding_y"), F.col("height") - F.col("padding_y") - F.col("overlap_y"), size - F.col("overlap_y"))
    columns = starts(F.lit(0), F.col("width") - F.col("overlap_x"), size - F.col("overlap_x"))
    placed = images.withColumn("tile_y", F.explode(rows)).withColumn("tile_x", F.explode(columns))
    return placed.withColumn("tile_name", tile_name(F.col("file_name"), F.col("tile_x"), F.col("tile_y")))


def outside(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Whether a box has no area in an image."""
    return (x + w <= 0) | (x >= width) | (y + h <= 0) | (y >= height)


def clipped(annotations: DataFrame, images: DataFrame, size: int = TILE) -> DataFrame:
    """Annotations in the tiles that they overlap.

    ``annotations``: ``ann_id, image_id, bbox, segmentation`` with COCO arrays;
    ``images`` as for :func:`tiles`.  The tiles of an image are regular, so the
    ones that a box overlaps follow from its edges, without a range join.
    Boxes outside the image, in its padding, or only at a tile's edges are left
    out.  Returns ``ann_id, image_id, tile_x, tile_y, box, segmentation, area``.
    """
    frame = images.select("image_id", "width", "height", "overlap_x", "overlap_y", "padding_y")
    boxed = annotations.select("ann_id", "image_id", "segmentation", *[F.get("bbox", F.lit(k)).cast("double").alias(c) for k, c in enumerate("xywh")]).join(frame, "image_id")
    inside = boxed.filter(~outside(*[F.col(c) for c in ("x", "y", "w", "h", "width", "height")]) & (F.col("y") <= F.col("height") - F.col("padding_y")))

    def met(low: str, extent: str, first: Column, end: Column, step: Column) -> Column:
        all_starts = starts(first, end, step)
        k_low = F.greatest(F.floor((F.col(low) - first - size) / step) + 1, F.lit(0))
        k_high = F.least(F.ceil((F.col(low) + F.col(extent) - first) / step) - 1, F.size(all_starts) - 1)
        return F.when(k_high >= k_low, F.transform(F.sequence(k_low.cast("long"), k_high.cast("long")), lambda k: first + k * step)).otherwise(F.array().cast("array<bigint>"))

    step_x, step_y = size - F.col("overlap_x"), size - F.col("overlap_y")
    zero = F.lit(0).cast("long")
    dealt = inside.withColumn("tile_x", F.explode(met("x", "w", zero, F.col("width") - F.col("overlap_x"), step_x))).withColumn(
        "tile_y", F.explode(met("y", "h", F.col("padding_y").cast("long"), F.col("height") - F.col("padding_y") - F.col("overlap_y"), step_y))
    )
    cut = dealt.withColumn("box", box_in_tile(F.col("x") - F.col("tile_x"), F.col("y") - F.col("tile_y"), F.col("w"), F.col("h"), size))
    corners = F.array(F.col("box.x"), F.col("box.y"), F.col("box.x") + F.col("box.w"), F.col("box.y") + F.col("box.h"))
    shape = ring_in_tile(F.get("segmentation", F.lit(0)).cast("array<double>"), F.col("tile_x"), F.col("tile_y"), size)
    kept = cut.filter(~borderline(corners, size)).withColumn("shape", shape).filter(~borderline(F.col("shape.rest"), size))
    return kept.select("ann_id", "image_id", "tile_x", "tile_y", "box", F.array("shape.ring").alias("segmentation"), ring_area(F.col("shape.ring")).alias("area"))


def excluded(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """How many boxes lie outside their images, and their extremes together with the origin."""
    boxed = annotations.select("image_id", *[F.get("bbox", F.lit(k)).cast("double").alias(c) for k, c in enumerate("xywh")]).join(images.select("image_id", "width", "height"), "image_id")
    out = boxed.filter(outside(*[F.col(c) for c in ("x", "y", "w", "h", "width", "height")]))
    zero = F.lit(0.0)
    return out.agg(
        F.count("*").alias("n"),
        F.least(zero, F.min("x")).alias("min_x"),
        F.greatest(zero, F.max(F.col("x") + F.col("w"))).alias("max_x"),
        F.least(zero, F.min("y")).alias("min_y"),
        F.greatest(zero, F.max(F.col("y") + F.col("h"))).alias("max_y"),
    )


def split(images: DataFrame, valid: DataFrame, by: Sequence[str] = ("aoi",), id_col: str = "image_id", train: float = 0.7, seed: int = 42, test_only: bool = False) -> DataFrame:
    """``images`` with ``dataset``: trn, val and tst of the valid ones of each group, oth for the rest.

    The shares are exact, up to rounding: ``train`` of a group, then half of
    what is left.  With ``test_only`` all valid images are tst.
    """
    named = valid.select(*by, id_col).distinct()
    if test_only:
        parts = named.withColumn("dataset", F.lit("tst"))
    else:
        drawn = Window.partitionBy(*by).orderBy(lot(id_col, seed=seed), id_col)
        n = F.count("*").over(Window.partitionBy(*by))
        n_train = F.bround(n * train).cast("long")
        n_val = F.bround((n - n_train) * 0.5).cast("long")
        nth = F.row_number().over(drawn)
        parts = named.withColumn("dataset", F.when(nth <= n_train, "trn").when(nth <= n_train + n_val, "val").otherwise("tst"))
    return images.join(parts, [*by, id_col], "left").withColumn("dataset", F.coalesce("dataset", F.lit("oth")))


def empty_tiles(all_tiles: DataFrame, annotated: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """Tiles without annotation, so many that they are ``share`` of an image's chosen ones; low tiles come first.

    An image without any annotation gives one tile.  ``annotated`` holds
    ``image_id, tile_x, tile_y``.
    """
    keys = ["image_id", "tile_x", "tile_y"]
    with_some = annotated.select(*keys).distinct()
    wanted = with_some.groupBy("image_id").agg(F.count("*").alias("n_with"))
    rest = all_tiles.join(with_some, keys, "left_anti").join(wanted, "image_id", "left")
    need = F.when(F.col("n_with").isNull(), 1).otherwise(F.ceil(F.col("n_with") * share / (1 - share)))
    high = F.when(F.col("n_with").isNull(), 0).otherwise((F.col("tile_y") < F.col("height") * LOW).cast("int"))
    order = Window.partitionBy("image_id").orderBy(high, lot(*keys, seed=seed), "tile_y", "tile_x")
    return rest.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= need).drop("nth", "n_with")


def quota(df: DataFrame, by: Sequence[str], most: int, id_col: str, seed: int = 42) -> DataFrame:
    """At most so many rows of each group, drawn by hash."""
    order = Window.partitionBy(*by).orderBy(lot(id_col, seed=seed), id_col)
    return df.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= most).drop("_nth")


def drawn(df: DataFrame, id_col: str, share: float, seed: int = 42) -> DataFrame:
    """About ``share`` of the rows, by hash: reruns draw the same ones."""
    return df.filter(F.pmod(lot(id_col, seed=seed), F.lit(1_000_000)) < int(share * 1_000_000))


def numbered(df: DataFrame, order: Sequence[str], name: str, first: int = 0) -> DataFrame:
    """Consecutive numbers in order, without sorting all rows in one task.

    Rows are ranged over partitions by the order; each partition's count gives
    the offset of the next ones.  Rows alike in ``order`` are interchangeable.
    """
    from rayloom.lineage import stored

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(ranged.withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return placed.withColumn("_nth", nth).join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, F.col("_before") + F.col("_nth") + first).drop("_part", "_nth", "_before")


def numbered_within(df: DataFrame, order: Sequence[str], name: str, by: Sequence[str], first: int = 0) -> DataFrame:
    """Consecutive numbers that begin anew in each group: those over all rows, less the least of the group."""
    every = numbered(df, [*by, *order], "_all")
    least = every.groupBy(*[F.col(c).alias(f"_of_{c}") for c in by]).agg(F.min("_all").alias("_least"))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    return every.join(least, same).select(*df.columns, (F.col("_all") - F.col("_least") + first).alias(name))


def offset_ids(df: DataFrame, group: str, id_col: str) -> DataFrame:
    """Ids made unique over groups, each group's shifted by what those before it, in order, need."""
    tops = df.groupBy(group).agg((F.max(id_col) + 1).alias("_room"))
    shift = tops.withColumn("_shift", F.coalesce(F.sum("_room").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per group
    return df.join(shift.select(group, "_shift"), group).withColumn(id_col, F.col(id_col) + F.col("_shift")).drop("_shift")


def every_nth(df: DataFrame, order: Sequence[str], step: int, by: Sequence[str]) -> DataFrame:
    """Every ``step``-th row of a group in order, the first included."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_nth", nth).filter(F.pmod(F.col("_nth") - 1, F.lit(step)) == 0).drop("_nth")


def tile_jobs(chosen: DataFrame, rejected: DataFrame, grow: float = 1.1) -> DataFrame:
    """What a tile writer has to do: ``tile_name, file_name, tile_x, tile_y, masks``; boxes to black out grow by a factor."""
    b = F.col("box")
    wider = F.struct((b["x"] - b["w"] * (grow - 1) / 2).alias("x"), (b["y"] - b["h"] * (grow - 1) / 2).alias("y"), (b["w"] * grow).alias("w"), (b["h"] * grow).alias("h"))
    masks = rejected.groupBy("tile_name").agg(F.sort_array(F.collect_list(wider)).alias("masks"))
    return chosen.select("tile_name", "file_name", "tile_x", "tile_y").join(masks, "tile_name", "left")


def without_repeats(df: DataFrame, id_col: str) -> DataFrame:
    """Rows alike in all but the id once, with the least id."""
    rest = [c for c in df.columns if c != id_col]
    return df.groupBy(*rest).agg(F.min(id_col).alias(id_col)).select(*df.columns)


def ambiguous(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has, and how many: what a lookup by them has to be free of."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def fresh_only(jobs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Jobs whose output isn't there yet."""
    return jobs.join(done.select(key), key, "left_anti")
