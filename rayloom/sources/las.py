"""Bounds of point clouds from the headers of LAS and LAZ files; no point is read."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rayloom.functions.names import basename
from rayloom.sources.split_json import opened

# Fixed values of the format: places in the public header block.
SIGNATURE, VERSION, LEGACY_COUNT, BOUNDS, COUNT = b"LASF", 24, 107, 179, 247
#: Bytes of the longest header block.
HEADER = 375

RESULT = "path string, num_pts bigint, minx double, miny double, minz double, maxx double, maxy double, maxz double"


def header(data: bytes) -> tuple[int, float, float, float, float, float, float] | None:
    """Number of points and bounds (least x, y, z, then largest); None for anything but a whole header."""
    if len(data) < 227 or data[:4] != SIGNATURE:
        return None
    n = struct.unpack_from("<I", data, LEGACY_COUNT)[0]
    if data[VERSION : VERSION + 2] >= b"\x01\x04":  # from version 1.4 on the count has 8 bytes of its own
        if len(data) < COUNT + 8:
            return None
        n = struct.unpack_from("<Q", data, COUNT)[0] or n
    most_x, least_x, most_y, least_y, most_z, least_z = struct.unpack_from("<6d", data, BOUNDS)
    if not (least_x <= most_x and least_y <= most_y):
        return None
    return n, least_x, least_y, least_z, most_x, most_y, most_z


def listed(spark: SparkSession, path: str) -> list[str]:
    """Files at a path: itself, a folder's, or a pattern's; empty ones too, which Spark's readers leave out."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in fs.globStatus(at) or []:
        inside = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        found += [f.getPath().toString() for f in inside if f.isFile()]
    return sorted(found)


def read_las_bounds(spark: SparkSession, path: str) -> DataFrame:
    """``filename, num_pts, minx, miny, minz, maxx, maxy, maxz, ring`` of the LAS and LAZ files at ``path`` (a folder or pattern).

    A task reads the first bytes of its files.  A file that can't be read has
    0 points and no bounds; its ``ring`` is null.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name in batch["path"]:
                try:
                    fs, at = opened(name)
                    with fs.open_input_file(at) as source:
                        told = header(source.read(HEADER))
                except OSError:
                    told = None
                rows.append((name, *(told or (0, *[None] * 6))))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({c: float for c in ("minx", "miny", "minz", "maxx", "maxy", "maxz")})

    names = [n for n in listed(spark, path) if re.search(r"(?i)\.la[sz]$", n)]
    files = spark.createDataFrame([(n,) for n in names], "path string").repartition(max(1, min(len(names), 1000)))
    found = files.mapInPandas(scan, RESULT)
    box = F.array("minx", "miny", "maxx", "miny", "maxx", "maxy", "minx", "maxy", "minx", "miny")
    return found.select(basename(F.col("path")).alias("filename"), *[c.split()[0] for c in RESULT.split(", ")[1:]], F.when(F.col("minx").isNotNull(), box).alias("ring"))
