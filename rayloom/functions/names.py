"""File, tile and frame names as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    """What follows the last slash."""
    return F.regexp_extract(path, r"([^/]*)$", 1)


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.\w+$", "")


def trimmed_jpg(name: Column) -> Column:
    """Without trailing characters of the set ``. j p g``: names of tiles are built from such stems."""
    return F.regexp_replace(name, r"[.jpg]+$", "")


def with_suffix(name: Column, suffix: str = ".jpg") -> Column:
    return F.when(name.endswith(suffix), name).otherwise(F.concat(name, F.lit(suffix)))


def tile_name(image: Column, x: Column, y: Column, folder: str = "images") -> Column:
    """``<folder>/<stem>_<x>_<y>.jpg`` of the tile of an image at (x, y)."""
    stem = trimmed_jpg(basename(image))
    return F.concat(F.lit(f"{folder}/"), stem, F.lit("_"), x.cast("string"), F.lit("_"), y.cast("string"), F.lit(".jpg"))


def tile_of(name: Column) -> Column:
    """``stem, x, y`` of a tile's name; null where it isn't one."""
    pattern = r"^(.*)_(\d+)_(\d+)\.jpg$"
    part = lambda k: F.regexp_extract(name, pattern, k)
    told = F.struct(part(1).alias("stem"), part(2).cast("long").alias("x"), part(3).cast("long").alias("y"))
    return F.when(name.rlike(pattern), told)


def frame_of(name: Column) -> Column:
    """``frame_id, camera_model, cube_idx`` of ``<a>-<model>-<face>-<b>.jpg``; nulls in it where there are fewer parts."""
    parts = F.split(without_extension(name), "-")
    enough = F.size(parts) >= 4
    pick = lambda k: F.get(parts, F.lit(k))
    return F.struct(
        F.when(enough, F.concat_ws("-", pick(0), pick(3))).alias("frame_id"),
        F.when(enough, pick(1)).alias("camera_model"),
        F.when(enough, pick(2)).alias("cube_idx"),
    )


def literal_list(text: Column) -> Column:
    """``"['a', 'b']"`` as an array of strings."""
    return F.from_json(F.translate(text, "'", '"'), "array<string>")


def filled_path(path: Column, values: dict[str, str]) -> Column:
    """Placeholders ``{name}`` in a path replaced."""
    for name, value in values.items():
        path = F.replace(path, F.lit("{" + name + "}"), F.lit(value))
    return path


def with_category(df: DataFrame) -> DataFrame:
    """The category column, of whatever case, as ``CATEGORY``; an error where there is none or more than one."""
    named = [c for c in df.columns if c.lower() == "category"]
    if len(named) != 1:
        raise ValueError(f"one category column is needed, not {named}")
    return df.withColumnRenamed(named[0], "CATEGORY")


def cube_image_id(camera: Column, face: Column, faces: int = 6) -> Column:
    """An id for each face of each cube map."""
    return camera * faces + face
