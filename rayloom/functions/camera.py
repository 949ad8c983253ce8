"""Cameras as columns: spherical panoramas, cube maps, rotations, rays.

A vector is a struct ``x, y, z``; a matrix is a list of nine columns, row by
row.  Everything is arithmetic on columns and stays in the JVM; a vector that
is needed more than once is bound with :func:`let`, so that a chain of
projections doesn't grow with each link.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = Sequence[Column]

#: Rotations of the cube's faces, in degrees (omega, phi): fixed values.
FACES = {0: (0.0, 0.0), 1: (0.0, 180.0), 2: (0.0, 90.0), 3: (0.0, 270.0), 4: (90.0, 0.0), 5: (270.0, 0.0)}
#: Directions of the faces that a vector is dealt to, in order: fixed values.
FACE_DIRECTIONS = ((0, 0, -1), (0, 0, 1), (-1, 0, 0), (1, 0, 0), (0, 1, 0), (0, -1, 0))
#: Boresight (yaw, pitch, roll) of the spherical camera in degrees: a fixed value.
BORESIGHT = (0.0, -90.0, 0.0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def vector(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def _pair(a: Column, b: Column, body: Callable[[Column, Column], Column]) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda t: body(t["a"], t["b"]))


def minus(a: Column, b: Column) -> Column:
    return _pair(a, b, lambda u, v: vector(u["x"] - v["x"], u["y"] - v["y"], u["z"] - v["z"]))


def plus(a: Column, b: Column) -> Column:
    return _pair(a, b, lambda u, v: vector(u["x"] + v["x"], u["y"] + v["y"], u["z"] + v["z"]))


def norm(a: Column) -> Column:
    return let(a, lambda v: F.sqrt(dot(v, v)))


def unit(a: Column) -> Column:
    """The vector at length 1; nulls for the zero vector."""
    scaled = lambda t: vector(*[t["v"][c] / t["n"] for c in "xyz"])
    return let(a, lambda v: let(F.struct(v.alias("v"), F.nullif(F.sqrt(dot(v, v)), F.lit(0.0)).alias("n")), scaled))


def product(a: Matrix, b: Matrix) -> list[Column]:
    return [a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)]


def transposed(m: Matrix) -> list[Column]:
    return [m[3 * j + i] for i in range(3) for j in range(3)]


def applied(m: Matrix, v: Column) -> Column:
    return let(v, lambda u: vector(*[m[3 * i] * u["x"] + m[3 * i + 1] * u["y"] + m[3 * i + 2] * u["z"] for i in range(3)]))


def _sines(*angles: Column) -> Column:
    """Cosine and sine of each angle, by ``c0, s0, c1, ...``."""
    return F.struct(*[f(a).alias(f"{n}{k}") for k, a in enumerate(angles) for n, f in (("c", F.cos), ("s", F.sin))])


def _about(axis: str, t: Column, k: int) -> list[Column]:
    """Rotation about an axis by the ``k``-th angle of ``_sines``."""
    one, zero, c, s = F.lit(1.0), F.lit(0.0), t[f"c{k}"], t[f"s{k}"]
    return {"x": [one, zero, zero, zero, c, -s, zero, s, c], "y": [c, zero, s, zero, one, zero, -s, zero, c], "z": [c, -s, zero, s, c, zero, zero, zero, one]}[axis]


def _opk(t: Column) -> list[Column]:
    return product(product(_about("x", t, 0), _about("y", t, 1)), _about("z", t, 2))


def opk_matrix(omega: Column, phi: Column, kappa: Column) -> list[Column]:
    """Rotation by omega, phi and kappa, in radians: about x, then y, then z."""
    return _opk(_sines(omega, phi, kappa))


def turned(v: Column, angles: tuple[Column, ...], matrix: Callable[[Column], Matrix], back: bool = False) -> Column:
    """A vector turned by a matrix of the sines of some angles, or turned back; sines and matrix are worked out once."""

    def by(m: Column) -> Column:
        cells = [F.get(m, F.lit(i)) for i in range(9)]
        return applied(transposed(cells) if back else cells, v)

    return let(_sines(*angles), lambda t: let(F.array(*matrix(t)), by))


def opk_of_matrix(m: Matrix) -> tuple[Column, Column, Column]:
    """Omega, phi and kappa, in radians, of a rotation; omega is 0 where phi is a right angle."""
    across = F.sqrt(m[5] * m[5] + m[8] * m[8])
    phi = F.atan2(m[2], across)
    locked = across < 1e-12
    omega = F.when(locked, 0.0).otherwise(F.atan2(-m[5], m[8]))
    kappa = F.when(locked, F.when(phi > 0, F.atan2(m[4], m[7])).otherwise(-F.atan2(m[4], m[7]))).otherwise(F.atan2(-m[1], m[0]))
    return omega, phi, kappa


def zyx_matrix(rz: Column, ry: Column, rx: Column) -> list[Column]:
    """Rotation by three angles, in radians: about z, then the turned y, then the turned x."""
    t = _sines(rz, ry, rx)
    return product(product(_about("z", t, 0), _about("y", t, 1)), _about("x", t, 2))


def opk_of_zyx(m: Matrix) -> tuple[Column, Column, Column]:
    """Omega, phi and kappa, in radians, of a rotation made by :func:`zyx_matrix`; omega is 0 where phi is a right angle."""
    locked = F.abs(m[6]) >= 1 - 1e-12
    phi = F.when(locked, F.when(m[6] < 0, math.pi / 2).otherwise(-math.pi / 2)).otherwise(F.asin(F.greatest(F.least(-m[6], F.lit(1.0)), F.lit(-1.0))))
    omega = F.when(locked, F.lit(0.0)).otherwise(F.atan2(m[7], m[8]))
    kappa = F.when(locked, F.atan2(-m[1], m[4])).otherwise(F.atan2(m[3], m[0]))
    return omega, phi, kappa


def _ypr(t: Column) -> list[Column]:
    """Rotation by yaw about z, then pitch about x, then roll about y."""
    return product(product(_about("z", t, 0), _about("x", t, 1)), _about("y", t, 2))


def _ypr_angles(yaw: Column, pitch: Column, roll: Column) -> tuple[Column, ...]:
    """In radians, the yaw turned round."""
    return -F.radians(yaw), F.radians(pitch), F.radians(roll)


def _camera(t: Column) -> list[Column]:
    """World to camera: the flipped inverse of the pose's rotation and the boresight's."""
    back = transposed(product(_ypr(t), transposed(_ypr(_sines(*_ypr_angles(*[F.lit(v) for v in BORESIGHT]))))))
    return [*back[:3], *[-c for c in back[3:]]]


def shifted_pose(pose: Column, offsets: Sequence[float], angles: Sequence[str] = ("yaw", "pitch", "roll")) -> Column:
    """A pose with constant offsets added to its place and angles: ``dx, dy, dz`` and one for each of ``angles``."""
    moved = pose
    for name, by in zip(("x", "y", "z", *angles), offsets):
        moved = moved.withField(name, pose[name] + F.lit(float(by)))
    return moved


def to_camera(point: Column, pose: Column) -> Column:
    """A world point in the camera's axes; ``pose`` has x, y, z and yaw, pitch, roll in degrees."""
    return turned(minus(point, pose), _ypr_angles(pose["yaw"], pose["pitch"], pose["roll"]), _camera)


def to_world(point: Column, pose: Column) -> Column:
    """A point in the camera's axes in the world."""
    return plus(turned(point, _ypr_angles(pose["yaw"], pose["pitch"], pose["roll"]), _camera, back=True), pose)


def spherical_projection(v: Column, width: Column, height: Column) -> Column:
    """Pixel ``u, v`` of a direction in a panorama."""
    f = width / (2 * F.pi())
    return let(v, lambda d: F.struct((width / 2 + f * F.atan2(d["x"], d["z"])).alias("u"), (height / 2 + f * F.atan2(d["y"], F.hypot(d["x"], d["z"]))).alias("v")))


def spherical_unprojection(u: Column, v: Column, reach: Column, width: Column, height: Column) -> Column:
    """The point at distance ``reach`` in the direction of a pixel."""
    f = width / (2 * F.pi())
    a, b = (u - width / 2) / f, (v - height / 2) / f
    return vector(reach * F.sin(a) * F.cos(b), reach * F.sin(b), reach * F.cos(a) * F.cos(b))


def spherical_ray(u: Column, v: Column, pose: Column, width: Column, height: Column) -> Column:
    """``origin, direction`` of the ray through a pixel, direction of length 1."""
    seen = to_world(spherical_unprojection(u, v, F.lit(1.0), width, height), pose)
    return F.struct(vector(pose["x"], pose["y"], pose["z"]).alias("origin"), unit(minus(seen, pose)).alias("direction"))


def _face_angles(face: Column) -> tuple[Column, ...]:
    """Omega, phi and kappa of a cube's face by its number."""

    def angle(k: int) -> Column:
        chosen = F.lit(None).cast("double")
        for number, turn in FACES.items():
            chosen = F.when(face == number, F.radians(F.lit(turn[k]))).otherwise(chosen)
        return chosen

    return angle(0), angle(1), F.lit(0.0)


def face_of(v: Column) -> Column:
    """Number of the face that a direction in the frame's axes points at; the first of several."""
    seen = let(v, lambda d: F.array(*[d["x"] * float(x) + d["y"] * float(y) + d["z"] * float(z) for x, y, z in FACE_DIRECTIONS]))
    return let(seen, lambda a: (F.array_position(a, F.array_max(a)) - 1).cast("int"))


def lat_lon(v: Column) -> Column:
    """Latitude and longitude, in degrees, of a direction in the frame's axes."""
    return let(v, lambda d: F.struct(F.degrees(F.atan2(d["y"], F.hypot(d["x"], d["y"]))).alias("lat"), F.degrees(F.atan2(d["x"], -d["z"])).alias("lon")))


def in_mosaic(place: Column, cell: Column) -> Column:
    """Whether a latitude and longitude lie in a sensor's cell (``latmin, latmax, longmin, longmax``)."""
    start = F.pmod(cell["longmin"], F.lit(360))
    reach = F.pmod(cell["longmax"] - start, F.lit(360))
    return (F.pmod(place["lon"] - start, F.lit(360)) <= reach) & place["lat"].between(cell["latmin"], cell["latmax"])


def sensor_of(place: Column, mosaic: Column) -> Column:
    """The first ``sensor`` of a model's mosaic (an array of cells) that a place lies in; -1 for none."""
    return F.coalesce(F.get(F.filter(mosaic, lambda cell: in_mosaic(place, cell)), F.lit(0))["sensor"], F.lit(-1))


def world_to_frame(point: Column, frame: Column) -> Column:
    """A world point in the axes of a frame (``x, y, z`` and ``omega, phi, kappa`` in radians)."""
    return turned(minus(point, frame), (frame["omega"], frame["phi"], frame["kappa"]), _opk, back=True)


def frame_to_world(point: Column, frame: Column) -> Column:
    return plus(turned(point, (frame["omega"], frame["phi"], frame["kappa"]), _opk), frame)


def frame_to_model(point: Column, offset: Column, face: Column) -> Column:
    """A frame's point seen by a sensor at ``offset`` through a face."""
    return turned(minus(point, offset), _face_angles(face), _opk, back=True)


def model_to_frame(point: Column, offset: Column, face: Column) -> Column:
    return plus(turned(point, _face_angles(face), _opk), offset)


def model_to_image(v: Column, focal: Column) -> Column:
    """Place on the image plane; nulls for a direction along it."""

    def place(u: Column) -> Column:
        depth = F.nullif(u["z"], F.lit(0.0))
        return F.struct((-focal * u["x"] / depth).alias("x"), (-focal * u["y"] / depth).alias("y"))

    return let(v, place)


def image_to_model(image: Column, focal: Column) -> Column:
    """The direction, of length 1, through a place on the image plane."""
    return let(image, lambda p: unit(vector(p["x"], p["y"], -focal)))


def image_to_pixel(image: Column, pixel: Column, width: Column, height: Column) -> Column:
    return let(image, lambda p: F.struct((p["x"] / pixel + width / 2).alias("u"), (height / 2 - p["y"] / pixel).alias("v")))


def pixel_to_image(u: Column, v: Column, pixel: Column, width: Column, height: Column) -> Column:
    return F.struct(((u - width / 2) * pixel).alias("x"), ((height / 2 - v) * pixel).alias("y"))


def sensor_origin(frame: Column, offset: Column) -> Column:
    """Where in the world a frame's sensor stands."""
    return frame_to_world(offset, frame)


def cube_ray(u: Column, v: Column, frame: Column, face: Column, offset: Column, pixel: Column, size: Column) -> Column:
    """``origin, direction`` of the ray through a pixel of a cube's face, direction of length 1.

    The focal length of a face is half of its width.
    """
    seen = image_to_model(pixel_to_image(u, v, pixel, size, size), size * pixel / 2)
    ends = F.struct(frame_to_world(model_to_frame(seen, offset, face), frame).alias("there"), sensor_origin(frame, offset).alias("here"))
    return let(ends, lambda t: F.struct(t["here"].alias("origin"), unit(minus(t["there"], t["here"])).alias("direction")))


def disc_radius(mask_area: Column, direction: Column, reach: Column, width: Column, height: Column, normal: Sequence[float] = (0.0, 1.0, 0.0)) -> Column:
    """Radius of a disc that covers so many pixels of a panorama at distance ``reach``."""
    n = vector(*[F.lit(float(v)) for v in normal])
    slope = let(unit(direction), lambda d: F.abs(dot(n, d)) / norm(n) / F.sqrt(F.greatest(1 - d["y"] * d["y"], F.lit(1e-12))))
    scale = width * height / (2 * F.pi() * F.pi()) * slope
    return reach * F.sqrt(mask_area / F.nullif(scale, F.lit(0.0)))
