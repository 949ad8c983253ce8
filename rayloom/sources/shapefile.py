"""Shapefile layers as tables: geometries of ``.shp`` files with the attributes of the ``.dbf`` beside them.

A file is read by one task, as the format has no other way; folders of many
files are read in parallel.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds by shape type, without and with z or measures: fixed values.
KINDS = {0: "Null", 1: "Point", 3: "LineString", 5: "Polygon", 8: "MultiPoint"}
LAYER = "file string, nth bigint, kind string, properties map<string,string>, x double, y double, rings array<array<double>>"


def shapes(raw: bytes) -> Iterator[tuple[str, float | None, float | None, list[list[float]]]]:
    """``kind, x, y, rings`` of each record; a line's or polygon's parts are its rings, those of many points come as one."""
    at = 100
    while at + 12 <= len(raw):
        (size,) = struct.unpack_from(">i", raw, at + 4)
        (kind,) = struct.unpack_from("<i", raw, at + 8)
        body, at = at + 12, at + 8 + 2 * size
        name = KINDS.get(kind % 10, "Null")
        if name == "Point":
            yield name, *struct.unpack_from("<2d", raw, body), []
        elif name == "MultiPoint":
            (n,) = struct.unpack_from("<i", raw, body + 32)
            yield name, None, None, [list(struct.unpack_from(f"<{2 * n}d", raw, body + 36))]
        elif name in ("LineString", "Polygon"):
            n_parts, n = struct.unpack_from("<2i", raw, body + 32)
            parts = [*struct.unpack_from(f"<{n_parts}i", raw, body + 40), n]
            flat = struct.unpack_from(f"<{2 * n}d", raw, body + 40 + 4 * n_parts)
            rings = [list(flat[2 * a : 2 * b]) for a, b in zip(parts, parts[1:])]
            closed = lambda r: name == "Polygon" and len(r) > 2 and r[:2] == r[-2:]  # noqa: B023, E731
            yield name, None, None, [r[:-2] if closed(r) else r for r in rings]
        else:
            yield "Null", None, None, []


def attributes(raw: bytes, encoding: str = "utf-8") -> list[dict[str, str | None]]:
    """Rows of a ``.dbf`` as strings without blanks at either end; empty fields are null, deleted rows stay so that places agree."""
    n, start, width = struct.unpack_from("<IHH", raw, 4)
    fields, at = [], 32
    while at + 32 <= start and raw[at] != 0x0D:
        fields.append((raw[at : at + 11].split(b"\0")[0].decode(encoding, "replace"), raw[at + 16]))
        at += 32
    rows = []
    for i in range(n):
        at, row = start + i * width + 1, {}
        for name, size in fields:
            row[name] = raw[at : at + size].decode(encoding, "replace").strip(" \0") or None
            at += size
        rows.append(row)
    return rows


def read_shapefile(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """Rows of the ``.shp`` files at a path or in a folder: ``file, nth, kind, properties, x, y, rings``.

    Points have ``x, y``, the others flat ``rings``, polygons without their
    last vertex, which is the first.  Heights are left out.  Without a ``.dbf``
    properties are empty.
    """
    from functools import partial

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[sSdD][hHbB][pPfF]").load(path).select(F.regexp_replace("path", r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).alias("type"), "content")
    told = partial(attributes, encoding=encoding)

    def read(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, file in left.iterrows():
            known = told(bytes(right["content"].iloc[0])) if len(right) else []
            for i, (kind, x, y, rings) in enumerate(shapes(bytes(file["content"]))):
                rows.append((file["stem"], i, kind, {k: v for k, v in (known[i] if i < len(known) else {}).items()}, x, y, rings))
        return pd.DataFrame(rows, columns=["file", "nth", "kind", "properties", "x", "y", "rings"])

    shape, table = (files.filter(F.col("type") == t).groupBy("stem") for t in ("shp", "dbf"))
    return shape.cogroup(table).applyInPandas(read, LAYER)
