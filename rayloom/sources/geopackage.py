"""GeoPackage layers as tables, and tables as GeoPackage files.

A GeoPackage is an SQLite file, so a file is written by one task; folders of
many files are written in parallel.  A layer is read in ranges of row ids, a
task a range, and only the columns and the rows in a box that are asked for:
a file that can be opened by its path is read page by page, through the
layer's R-tree where it has one, others are loaded whole.  Points and polygons
are supported (of several parts each part's outer ring is kept).
"""

from __future__ import annotations

import re
import sqlite3
import struct
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rayloom.sources.split_json import opened

#: Identifier of an SQLite file as a GeoPackage, its version, and bytes of each kind of envelope: fixed values of the format.
APPLICATION, VERSION, ENVELOPES = 0x47504B47, 10300, (0, 32, 48, 48, 64)

FEATURE = "file string, layer string, fid bigint, kind string, x double, y double, rings array<array<double>>, properties map<string,string>"


def _geometry(data: bytes, at: int) -> tuple[str, list[list[float]], int]:
    """Kind, rings (a point is a ring of one vertex) and end of a WKB geometry; heights are left out."""
    order = "<" if data[at] == 1 else ">"
    code = struct.unpack_from(order + "I", data, at + 1)[0]
    size = 2 + (code // 1000 in (1, 2, 3)) + (code // 1000 == 3) + bool(code & 0x80000000) + bool(code & 0x40000000)
    kind, at = (code & 0x0FFFFFFF) % 1000, at + 5

    def vertices(n: int, at: int) -> tuple[list[float], int]:
        values = struct.unpack_from(f"{order}{n * size}d", data, at)
        return [v for k in range(0, len(values), size) for v in values[k : k + 2]], at + 8 * n * size

    if kind == 1:
        ring, at = vertices(1, at)
        return "Point", [ring], at
    n, at = struct.unpack_from(order + "I", data, at)[0], at + 4
    if kind == 3:
        rings = []
        for _ in range(n):
            m, at = struct.unpack_from(order + "I", data, at)[0], at + 4
            ring, at = vertices(m, at)
            rings.append(ring)
        return "Polygon", rings[:1], at
    if kind in (4, 6, 7):
        parts = []
        for _ in range(n):
            _, rings, at = _geometry(data, at)
            parts += rings
        return {4: "MultiPoint", 6: "MultiPolygon", 7: "GeometryCollection"}[kind], parts, at
    return f"kind {kind}", [], at


def geometry_of(blob: bytes | None) -> tuple[str | None, list[list[float]]]:
    if not blob or blob[:2] != b"GP" or blob[3] & 0x10:
        return None, []
    kind, rings, _ = _geometry(blob, 8 + ENVELOPES[(blob[3] >> 1) & 7])
    return kind, rings


def blob_of(rings: list[list[float]] | None, x: float | None, y: float | None, srs: int) -> bytes | None:
    """A polygon of rings, or else a point, as a GeoPackage geometry."""
    head = b"GP" + struct.pack("<BBi", 0, 1, srs)
    if rings:
        closed = [list(r) if list(r[:2]) == list(r[-2:]) else [*r, *r[:2]] for r in rings]
        body = b"".join(struct.pack(f"<BIII{len(r)}d", 1, 3, 1, len(r) // 2, *r) for r in closed)
        return head + (body if len(closed) == 1 else struct.pack("<BII", 1, 6, len(closed)) + body)
    return None if x is None or y is None else head + struct.pack("<BI2d", 1, 1, x, y)


@contextmanager
def database(path: str) -> Iterator[sqlite3.Connection]:
    """A file, to be read: in place if its path can be opened, else from memory."""
    fs, at = opened(path)
    if fs.type_name == "local":
        con = sqlite3.connect(f"file:{quote(at)}?mode=ro&immutable=1", uri=True)
    else:
        with fs.open_input_file(at) as source:
            content = source.read()
        con = sqlite3.connect(":memory:")
        con.deserialize(content)
    try:
        yield con
    finally:
        con.close()


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def layers_of(con: sqlite3.Connection) -> list[tuple[str, str, int, int, bool]]:
    """Each layer: its table and geometry column, first and last row id, and whether it has an R-tree."""
    told = []
    for table, column in con.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY table_name").fetchall():
        low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(table)}").fetchone()
        index = con.execute("SELECT count(*) FROM sqlite_master WHERE name = ?", (f"rtree_{table}_{column}",)).fetchone()[0]
        if low is not None:
            told.append((table, column, low, high, bool(index)))
    return told


def select_rows(con: sqlite3.Connection, table: str, column: str, low: int, high: int, index: bool, box: tuple[float, ...] | None, columns: Sequence[str] | None) -> sqlite3.Cursor:
    """Row id, geometry and properties of the rows in a range; of those alone whose box meets ``box``, where there is an index."""
    known = [r[1] for r in con.execute(f"PRAGMA table_info({_quoted(table)})").fetchall()]
    wanted = [c for c in known if c != column and (columns is None or c in columns)]
    shown = ", ".join(["t.rowid", f"t.{_quoted(column)}", *[f"t.{_quoted(c)}" for c in wanted]])
    if box is None or not index:
        return con.execute(f"SELECT {shown} FROM {_quoted(table)} t WHERE t.rowid BETWEEN ? AND ?", (low, high))
    inside = f"SELECT id FROM {_quoted(f'rtree_{table}_{column}')} WHERE maxx >= ? AND minx <= ? AND maxy >= ? AND miny <= ? AND id BETWEEN ? AND ?"
    return con.execute(f"SELECT {shown} FROM ({inside}) r CROSS JOIN {_quoted(table)} t ON t.rowid = r.id", (box[0], box[2], box[1], box[3], low, high))


def bounds_of(rings: list[list[float]]) -> tuple[float, float, float, float] | None:
    """Least x and y, largest x and y."""
    x, y = [v for r in rings for v in r[::2]], [v for r in rings for v in r[1::2]]
    return (min(x), min(y), max(x), max(y)) if x else None


LAYERS = "file string, layer string, column string, low bigint, high bigint, indexed boolean"


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None, box: tuple[float, float, float, float] | None = None, columns: Sequence[str] | None = None, rows: int = 100_000) -> DataFrame:
    """``FEATURE`` rows of the files at ``path`` (a file, folder or pattern), of one layer or of all.

    ``box`` (least x and y, largest x and y) keeps the features whose bounds
    meet it, ``columns`` names the properties that are read; a task reads at
    most ``rows`` row ids.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for name in batch["path"]:
                with database(name) as con:
                    found += [(name, *told) for told in layers_of(con) if layer in (None, told[0])]
            yield pd.DataFrame(found, columns=["file", "layer", "column", "low", "high", "indexed"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, table, column, low, high, indexed in batch[["file", "layer", "column", "low", "high", "indexed"]].itertuples(index=False):
                with database(name) as con:
                    cursor = select_rows(con, table, column, low, high, bool(indexed), box, columns)
                    names = [c[0] for c in cursor.description][2:]
                    while some := cursor.fetchmany(5000):
                        found = []
                        for fid, blob, *values in some:
                            kind, rings = geometry_of(blob)
                            if box is not None and ((b := bounds_of(rings)) is None or b[2] < box[0] or b[0] > box[2] or b[3] < box[1] or b[1] > box[3]):
                                continue  # the index holds bounds in less digits
                            point = rings[0] if kind == "Point" else (None, None)
                            said = {c: str(v) for c, v in zip(names, values) if v is not None}
                            found.append((name, table, fid, kind, *point, None if kind == "Point" else rings, said))
                        yield pd.DataFrame(found, columns=["file", "layer", "fid", "kind", "x", "y", "rings", "properties"])

    files = spark.read.format("binaryFile").load(path).select("path")
    found = files.mapInPandas(look, LAYERS)
    ranges = found.withColumn("low", F.explode(F.sequence("low", "high", F.lit(rows)))).withColumn("high", F.least("high", F.col("low") + (rows - 1)))
    tasks = spark.sparkContext.defaultParallelism
    return ranges.repartition(tasks, "file", "layer", "low").mapInPandas(read, FEATURE)


def write_geopackage(df: DataFrame, folder: str, layer: str, x: str = "x", y: str = "y", rings: str | None = None, srs: int = 2056) -> DataFrame:
    """A file per partition in ``folder``; returns ``file, n``, once written.

    Partitions should fit a task: repartition first.  Without rows one file
    with the layer's columns is written, so that nothing found differs from
    not done.  Files of attempts that failed are not in the result.
    """
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "boolean": "BOOLEAN"}
    rest = [(c, kinds.get(t, "TEXT")) for c, t in df.dtypes if c not in (x, y, rings)]
    plain = [F.col(c) if k != "TEXT" else F.col(c).cast("string").alias(c) for c, k in rest]
    shape = [F.col(c).cast("double").alias(f"_{c}") if c in df.columns else F.lit(None).cast("double").alias(f"_{c}") for c in (x, y)]
    told = df.select(*plain, *shape, (F.col(rings) if rings else F.lit(None).cast("array<array<double>>")).alias("_rings"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        con = sqlite3.connect(":memory:")
        con.executescript(
            f"""PRAGMA application_id = {APPLICATION}; PRAGMA user_version = {VERSION};
            CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
            INSERT INTO gpkg_spatial_ref_sys VALUES ('srs', {srs}, 'EPSG', {srs}, 'undefined', NULL);
            CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, srs_id INTEGER);
            INSERT INTO gpkg_contents VALUES ('{layer}', 'features', '{layer}', {srs});
            CREATE TABLE gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL);
            INSERT INTO gpkg_geometry_columns VALUES ('{layer}', 'geom', 'GEOMETRY', {srs}, 0, 0);
            CREATE TABLE "{layer}" (fid INTEGER PRIMARY KEY, geom BLOB{"".join(f', "{c}" {k}' for c, k in rest)});
            CREATE TABLE gpkg_extensions (table_name TEXT, column_name TEXT, extension_name TEXT NOT NULL, definition TEXT NOT NULL, scope TEXT NOT NULL);
            INSERT INTO gpkg_extensions VALUES ('{layer}', 'geom', 'gpkg_rtree_index', 'http://www.geopackage.org/spec120/#extension_rtree', 'write-only');
            CREATE VIRTUAL TABLE "rtree_{layer}_geom" USING rtree(id, minx, maxx, miny, maxy);"""
        )
        n = 0
        for batch in batches:
            values = [[None if v is None or v != v else v for v in row] for row in batch.drop(columns="_rings").astype(object).itertuples(index=False)]
            lines = [(blob_of(None if r is None else [list(p) for p in r], *v[-2:], srs), *v[:-2]) for v, r in zip(values, batch["_rings"])]
            con.executemany(f'INSERT INTO "{layer}" (geom{"".join(f", \"{c}\"" for c, _ in rest)}) VALUES ({", ".join("?" * (1 + len(rest)))})', lines)
            edges = [(k, bounds_of(geometry_of(line[0])[1])) for k, line in enumerate(lines, n + 1)]  # row ids count from 1
            con.executemany(f'INSERT INTO "rtree_{layer}_geom" VALUES (?, ?, ?, ?, ?)', [(k, b[0], b[2], b[1], b[3]) for k, b in edges if b])
            n += len(lines)
        con.commit()
        files, path = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder) if ":" in folder else "file://" + folder)
        files.create_dir(path, recursive=True)
        name = f"{layer}-{uuid.uuid4().hex}.gpkg"
        with files.open_output_stream(f"{path}/{name}") as out:
            out.write(con.serialize())
        yield pd.DataFrame({"file": [f"{folder}/{name}"], "n": [n]})

    written = told.mapInPandas(write, "file string, n bigint").collect()  # a row per partition
    if not written:  # Spark runs no task for a table that it knows to be empty
        written = df.sparkSession.range(1).mapInPandas(lambda batches: write(iter(())), "file string, n bigint").collect()
    kept = [r for r in written if r.n] or written[:1]
    return df.sparkSession.createDataFrame([(r.file, r.n) for r in kept], "file string, n long")
