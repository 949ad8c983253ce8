"""Boxes, rings and discs as columns.

A box is a struct ``x, y, w, h``; a ring is COCO's flat array
``[x1, y1, x2, y2, ...]``; a segmentation is an array of rings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rayloom.functions.outlines import overlap, overlaps


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def box_of_array(values: Column) -> Column:
    """COCO's ``[x, y, w, h]``."""
    return box(*[F.get(values, F.lit(k)).cast("double") for k in range(4)])


def points(ring: Column) -> Column:
    """A ring as an array of ``x, y``."""
    half = F.floor(F.size(ring) / 2).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), half - 1), lambda i: F.struct(F.get(ring, 2 * i).alias("x"), F.get(ring, 2 * i + 1).alias("y")))
    return F.when(half > 0, pairs).otherwise(F.array().cast("array<struct<x:double,y:double>>"))


def flat(vertices: Column) -> Column:
    return F.flatten(F.transform(vertices, lambda p: F.array(p["x"], p["y"])))


def shifted(ring: Column, dx: Column, dy: Column) -> Column:
    """A ring moved by (dx, dy): from tile to panorama."""
    return F.transform(ring, lambda v, i: v + F.when(i % 2 == 0, dx).otherwise(dy))


def valid_rings(segmentation: Column) -> Column:
    """Rings of at least a triangle; shorter ones are no polygon."""
    return F.filter(segmentation, lambda r: F.size(r) >= 6)


def ring_box(ring: Column) -> Column:
    """The box around a ring."""
    xs = F.filter(ring, lambda v, i: i % 2 == 0)
    ys = F.filter(ring, lambda v, i: i % 2 == 1)
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))


def segmentation_box(segmentation: Column) -> Column:
    return ring_box(F.flatten(segmentation))


def _edges(ring: Column, value) -> Column:
    """Sum of ``value(x, y, next x, next y)`` over the edges of a ring, that to its first vertex included."""
    n = F.floor(F.size(ring) / 2).cast("int")

    def term(i: Column) -> Column:
        j = (i + 1) % n
        return value(F.get(ring, 2 * i), F.get(ring, 2 * i + 1), F.get(ring, 2 * j), F.get(ring, 2 * j + 1))

    steps = F.transform(F.sequence(F.lit(0), n - 1), term)
    return F.when(n > 0, F.aggregate(steps, F.lit(0.0), lambda total, v: total + v)).otherwise(F.lit(0.0))


def signed_area(ring: Column) -> Column:
    return _edges(ring, lambda x, y, u, v: x * v - u * y) / 2


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def ring_centroid(ring: Column) -> Column:
    """Centre of area; of the vertices where the area is 0."""
    area = signed_area(ring)
    n = F.greatest(F.floor(F.size(ring) / 2), F.lit(1))
    cx = _edges(ring, lambda x, y, u, v: (x + u) * (x * v - u * y)) / (6 * F.nullif(area, F.lit(0.0)))
    cy = _edges(ring, lambda x, y, u, v: (y + v) * (x * v - u * y)) / (6 * F.nullif(area, F.lit(0.0)))
    return F.struct(
        F.coalesce(cx, _edges(ring, lambda x, y, u, v: x) / n).alias("x"),
        F.coalesce(cy, _edges(ring, lambda x, y, u, v: y) / n).alias("y"),
    )


def scaled(ring: Column, factor: float) -> Column:
    """A ring scaled about the mean of its vertices."""
    n = F.greatest(F.floor(F.size(ring) / 2), F.lit(1))
    cx, cy = _edges(ring, lambda x, y, u, v: x) / n, _edges(ring, lambda x, y, u, v: y) / n
    return F.transform(ring, lambda v, i: F.when(i % 2 == 0, cx).otherwise(cy) * (1 - factor) + v * factor)


def clamped(value: Column, low: Column | float, high: Column | float) -> Column:
    return F.greatest(F.least(value, F.lit(high) if isinstance(high, (int, float)) else high), F.lit(low) if isinstance(low, (int, float)) else low)


def overlap_area(a: Column, b: Column) -> Column:
    """Area that two boxes share."""
    width = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    height = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(width, F.lit(0)) * F.greatest(height, F.lit(0))


def boxes_meet(a: Column, b: Column) -> Column:
    """Whether two boxes intersect; a common edge is enough."""
    return (a["x"] <= b["x"] + b["w"]) & (b["x"] <= a["x"] + a["w"]) & (a["y"] <= b["y"] + b["h"]) & (b["y"] <= a["y"] + a["h"])


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes; 0 where the union is empty."""
    both = overlap_area(a, b)
    union = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when(union > 0, both / F.nullif(union, F.lit(0))).otherwise(F.lit(0.0)).cast("double")


def disc_iou(distance: Column, radius: float) -> Column:
    """Intersection over union of two discs of equal radius."""
    d = F.least(distance / (2 * radius), F.lit(1.0))
    lens = 2 * radius * radius * (F.acos(d) - d * F.sqrt(1 - d * d))
    return lens / (2 * F.pi() * radius * radius - lens)


def box_in_tile(x: Column, y: Column, w: Column, h: Column, size: int) -> Column:
    """A box in a tile's coordinates, cut at the tile's edges."""

    def cut(origin: Column, length: Column) -> tuple[Column, Column]:
        short = F.when(origin < 0, F.least(length + origin, F.lit(size))).when(origin + length > size, size - origin).otherwise(length)
        return F.greatest(origin, F.lit(0)), short

    (left, width), (top, height) = cut(x, w), cut(y, h)
    return box(left, top, width, height)


def borderline(ring: Column, size: int, margin: float = 0.02) -> Column:
    """Whether all x, or all y, of a ring lie at a tile's edges; true of an empty ring."""
    near = lambda v: (v <= size * margin) | (v >= size * (1 - margin))
    return F.forall(F.filter(ring, lambda v, i: i % 2 == 0), near) | F.forall(F.filter(ring, lambda v, i: i % 2 == 1), near)


def ring_in_tile(ring: Column, dx: Column, dy: Column, size: int) -> Column:
    """A ring in a tile's coordinates, its vertices clamped to the tile.

    A vertex that stays on the edge that the vertex kept before it lies on, or
    that is there already (the first one aside), is left out.  Returns the
    kept vertices without the first, and all of them, as rings.
    """
    moved = F.transform(points(ring), lambda p: F.struct(clamped(p["x"] - dx, 0, size).alias("x"), clamped(p["y"] - dy, 0, size).alias("y")))
    first = F.get(moved, F.lit(0))

    def step(kept: Column, p: Column) -> Column:
        last = F.coalesce(F.get(kept, F.size(kept) - 1), first)
        edge = lambda v: (v == 0) | (v == size)
        known = (edge(p["x"]) & (last["x"] == p["x"])) | (edge(p["y"]) & (last["y"] == p["y"])) | F.array_contains(kept, p)
        return F.when(known, kept).otherwise(F.array_append(kept, p))

    empty = F.filter(moved, lambda p: F.lit(False))
    kept = F.aggregate(F.slice(moved, 2, F.greatest(F.size(moved) - 1, F.lit(0))), empty, step)
    return F.struct(flat(kept).alias("rest"), F.concat(F.array(first["x"], first["y"]), flat(kept)).alias("ring"))


def rings_overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Area that two polygons share, convex or not."""
    return overlap(a, b)


def point_in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a ring, by the number of edges to its right."""

    def crossed(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
        at = ax + (y - ay) / F.nullif(by - ay, F.lit(0.0)) * (bx - ax)
        return F.when(((ay > y) != (by > y)) & (x < at), 1.0).otherwise(0.0)

    return _edges(ring, crossed) % 2 == 1


def _area(ring: np.ndarray) -> float:
    v = np.asarray(ring, float).reshape(-1, 2)
    return 0.5 * abs(float(np.dot(v[:, 0], np.roll(v[:, 1], -1)) - np.dot(v[:, 1], np.roll(v[:, 0], -1))))


@F.pandas_udf(T.DoubleType())
def ring_iou(left: pd.Series, right: pd.Series) -> pd.Series:
    """Intersection over union of two rings; 0 for less than triangles and empty unions."""

    def iou(a, b, both: float) -> float:
        union = _area(a) + _area(b) - both
        return both / union if union > 0 else 0.0

    some = [(a, b) if a is not None and b is not None and len(a) >= 6 and len(b) >= 6 else None for a, b in zip(left, right)]
    shared = overlaps([p or ([], []) for p in some])
    return pd.Series([iou(*p, x) if p else 0.0 for p, x in zip(some, shared)], dtype=float)


def fit_ellipse(ring: np.ndarray) -> tuple[float, float, float, float, float] | None:
    """Centre, half axes and angle of the direct least-squares ellipse (Halir and Flusser); None where there is none."""
    v = np.asarray(ring, float).reshape(-1, 2)
    if len(v) < 5:
        return None
    middle, spread = v.mean(axis=0), max(float(v.std()), 1e-12)
    x, y = ((v - middle) / spread).T
    square, linear = np.column_stack((x * x, x * y, y * y)), np.column_stack((x, y, np.ones_like(x)))
    fit = ellipse_of_scatter(square.T @ square, square.T @ linear, linear.T @ linear)
    return None if fit is None else (fit[0] * spread + middle[0], fit[1] * spread + middle[1], fit[2] * spread, fit[3] * spread, fit[4])


def ellipse_of_scatter(s1: np.ndarray, s2: np.ndarray, s3: np.ndarray) -> tuple[float, float, float, float, float] | None:
    """The same from the scatter of ``x x, x y, y y`` with itself, with ``x, y, 1``, and of those with themselves."""
    try:
        t = -np.linalg.solve(s3, s2.T)
        reduced = s1 + s2 @ t
        reduced = np.array([reduced[2] / 2, -reduced[1], reduced[0] / 2])
        _, vectors = np.linalg.eig(reduced)
    except np.linalg.LinAlgError:
        return None
    vectors = np.real(vectors)
    good = np.flatnonzero(4 * vectors[0] * vectors[2] - vectors[1] ** 2 > 0)
    if not len(good):
        return None
    a, b, c = vectors[:, good[0]]
    d, e, f = t @ vectors[:, good[0]]
    det = 4 * a * c - b * b
    cx, cy = (b * e - 2 * c * d) / det, (b * d - 2 * a * e) / det
    level = -(f + (d * cx + e * cy) / 2)
    values, axes = np.linalg.eigh(np.array([[a, b / 2], [b / 2, c]]))
    with np.errstate(all="ignore"):
        half = np.sqrt(level / values)
    if not np.all(np.isfinite(half)):
        return None
    return float(cx), float(cy), float(half[0]), float(half[1]), float(np.arctan2(axes[1, 0], axes[0, 0]))


def ellipse_ring(centre_x: float, centre_y: float, a: float, b: float, angle: float, vertices: int = 100) -> np.ndarray:
    t = np.linspace(0, 2 * np.pi, vertices, endpoint=False)
    x, y = a * np.cos(t), b * np.sin(t)
    return np.column_stack((centre_x + x * np.cos(angle) - y * np.sin(angle), centre_y + x * np.sin(angle) + y * np.cos(angle))).ravel()


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "a", "b", "angle", "iou")]))
def ellipse_of(rings: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The ellipse fitted to a ring and its IoU with it; nulls where the fit fails."""
    for batch in rings:
        fits = [None if ring is None else fit_ellipse(ring) for ring in batch]
        drawn = [None if fit is None else ellipse_ring(*fit) for fit in fits]
        shared = overlaps([([], []) if d is None else (ring, d) for ring, d in zip(batch, drawn)])
        rows = [(None,) * 6 if fit is None else (*fit, both / max(_area(ring) + _area(d) - both, 1e-12)) for ring, fit, d, both in zip(batch, fits, drawn, shared)]
        yield pd.DataFrame(rows, columns=["x", "y", "a", "b", "angle", "iou"]).astype(float)


def fit_plane(xyz: np.ndarray) -> tuple[float, float, float]:
    """``a, b, c`` of the least-squares plane ``z = a x + b y + c``."""
    v = np.asarray(xyz, float)
    return tuple(np.linalg.lstsq(np.column_stack((v[:, :2], np.ones(len(v)))), v[:, 2], rcond=None)[0].tolist())


def is_flat(xyz: np.ndarray, most: float = 0.15) -> bool:
    """Whether points lie within a slab of thickness ``most``; not so for fewer than three or collinear ones."""
    v = np.asarray(xyz, float)
    if len(v) < 3:
        return False
    centred = v - v.mean(axis=0)
    _, sizes, axes = np.linalg.svd(centred, full_matrices=False)
    return bool(sizes[1] > 1e-9 and np.ptp(centred @ axes[2]) < most)


@F.pandas_udf(T.StructType([*[T.StructField(c, T.DoubleType()) for c in "abc"], T.StructField("flat", T.BooleanType())]))
def plane_of(points: pd.Series) -> pd.DataFrame:
    """The plane ``z = a x + b y + c`` of an array of ``[x, y, z]``, and whether the points lie flat; nulls for fewer than three."""
    rows = [(None, None, None, False) if p is None or len(p) < 3 else (*fit_plane(v), is_flat(v)) for p in points for v in (None if p is None else np.array([list(x) for x in p], float),)]
    return pd.DataFrame(rows, columns=["a", "b", "c", "flat"]).astype({c: float for c in "abc"})


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def smoothed_rings(rings: pd.Series) -> pd.Series:
    """3-D rings redrawn as ellipses on a plane: heights beyond two deviations go first, if three points are left.

    Rings that no ellipse fits come back as they are.
    """

    def smooth(ring):
        v = np.array([list(p) for p in ring], float)
        off = np.abs(v[:, 2] - v[:, 2].mean()) <= 2 * v[:, 2].std()
        kept = v[off] if off.sum() >= 3 else v
        a, b, c = fit_plane(kept)
        fit = fit_ellipse(kept[:, :2].ravel())
        if fit is None:
            return [list(map(float, p)) for p in v]
        xy = ellipse_ring(*fit, vertices=64).reshape(-1, 2)
        xy = np.vstack((xy, xy[:1]))
        return [[float(x), float(y), float(a * x + b * y + c)] for x, y in xy]

    return pd.Series([None if r is None else smooth(r) for r in rings], dtype=object)


def nearest_nonzero(values: Column) -> Column:
    """An array whose zeros are replaced by the nearest value that isn't 0, the earlier of two; all zeros stay."""
    places = F.filter(F.transform(values, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda p: p["v"] != 0)
    near = lambda i: F.array_min(F.transform(places, lambda p: F.struct(F.abs(p["i"] - i), p["i"], p["v"].alias("v"))))["v"]
    return F.transform(values, lambda v, i: F.when(v == 0, F.coalesce(near(i), v)).otherwise(v))


def without_outliers(values: Column, deviations: float = 2.0) -> Column:
    """Values within so many population deviations of the mean; all of them if fewer than three are left."""
    n = F.greatest(F.size(values), F.lit(1))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    # each step hands its numbers to the next inside an array of one: named in a lambda they would be added up again for every value
    kept = lambda mean, spread: F.filter(values, lambda v: F.abs(v - mean) <= deviations * spread)
    by_mean = lambda mean: F.get(F.transform(F.array(F.sqrt(total(F.transform(values, lambda v: (v - mean) * (v - mean))) / n)), lambda spread: kept(mean, spread)), F.lit(0))
    found = F.get(F.transform(F.array(total(values) / n), by_mean), F.lit(0))
    return F.get(F.transform(F.array(found), lambda f: F.when(F.size(f) >= 3, f).otherwise(values)), F.lit(0))
