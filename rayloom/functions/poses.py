"""The camera chain in steps: a pose's rotation as a column of its own, and plain arithmetic on it.

:mod:`rayloom.functions.camera` has each link as one column; here sines, matrix
and places are columns of the table, one after the other, so that all of it is
compiled and a pose's matrix is worked out once for any number of points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rayloom.functions.camera import BORESIGHT, Matrix, _opk, _ypr, _ypr_angles, product, transposed, vector


def _camera_matrix(t: dict[str, Column]) -> list[Column]:
    """World to camera, with the boresight's matrix as numbers."""
    bore = transposed(_ypr({f"{n}{k}": f(a) for k, a in enumerate(_ypr_angles(*[F.lit(v) for v in BORESIGHT])) for n, f in (("c", F.cos), ("s", F.sin))}))
    back = transposed(product(_ypr(t), bore))
    return [*back[:3], *[-c for c in back[3:]]]


def _with_matrix(df: DataFrame, angles: list[Column], matrix: Callable[[dict[str, Column]], Matrix], name: str) -> DataFrame:
    sines = {f"_{name}_{n}{k}": f(a) for k, a in enumerate(angles) for n, f in (("c", F.cos), ("s", F.sin))}
    told = {c.removeprefix(f"_{name}_"): F.col(c) for c in sines}
    return df.withColumns(sines).withColumn(name, F.array(*matrix(told))).drop(*sines)


def with_camera(df: DataFrame, pose: str, name: str = "matrix") -> DataFrame:
    """``df`` with the world-to-camera matrix of a ``pose`` (yaw, pitch, roll in degrees) as an array of nine."""
    p = F.col(pose)
    return _with_matrix(df, list(_ypr_angles(p["yaw"], p["pitch"], p["roll"])), _camera_matrix, name)


def with_frame(df: DataFrame, frame: str, name: str = "matrix") -> DataFrame:
    """``df`` with the world-to-frame matrix of a ``frame`` (omega, phi, kappa in radians) as an array of nine."""
    f = F.col(frame)
    return _with_matrix(df, [f["omega"], f["phi"], f["kappa"]], lambda t: transposed(_opk(t)), name)


def _rows(m: Column, x: Column, y: Column, z: Column) -> list[Column]:
    return [F.get(m, F.lit(i)) * x + F.get(m, F.lit(i + 1)) * y + F.get(m, F.lit(i + 2)) * z for i in (0, 3, 6)]


def seen_from(point: Column, pose: Column, m: Column) -> Column:
    """A world point in the axes of a pose with matrix ``m``."""
    return vector(*_rows(m, *[point[c] - pose[c] for c in "xyz"]))


def in_world(point: Column, pose: Column, m: Column) -> Column:
    """A point in a pose's axes in the world."""
    return vector(*[pose[c] + sum((F.get(m, F.lit(i + 3 * k)) * point[a] for k, a in enumerate("xyz")), F.lit(0.0)) for i, c in enumerate("xyz")])


def panorama_pixel(v: Column, width: Column, height: Column) -> Column:
    """Pixel ``u, v`` of a direction in a panorama, of a vector that is a column of its own."""
    f = width / (2 * F.pi())
    return F.struct((width / 2 + f * F.atan2(v["x"], v["z"])).alias("u"), (height / 2 + f * F.atan2(v["y"], F.hypot(v["x"], v["z"]))).alias("v"))
