"""Objects of the world as annotations of panoramas, and annotations as rays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rayloom.functions.camera import cube_ray, face_of, frame_to_model, image_to_pixel, lat_lon, model_to_image, sensor_of, spherical_ray, vector
from rayloom.functions.geometry import ellipse_of, nearest_nonzero, ring_area, ring_box, ring_centroid
from rayloom.functions.poses import panorama_pixel, seen_from, with_camera, with_frame
from rayloom.operators.spatial import near_pairs

#: Faces on which objects aren't annotated, least vertices and area of one, widest box in a panorama.
SKIPPED_FACES, LEAST_VERTICES, LEAST_AREA, MOST_WIDTH = (1, 4, 5), 50, 200.0, 1000.0


def _near(objects: DataFrame, poses: DataFrame, reach: float) -> DataFrame:
    """Objects (``object_id, ring``: ``x, y, z`` structs) and the poses near their middle."""
    mean = lambda c: F.aggregate(F.col("ring"), F.lit(0.0), lambda s, p: s + p[c]) / F.size("ring")
    placed = objects.filter(F.size("ring") > 0).withColumn("mid_x", mean("x")).withColumn("mid_y", mean("y"))
    cameras = poses.select("frame_id", F.struct(*[c for c in poses.columns if c != "frame_id"]).alias("pose"), F.col("x").alias("cam_x"), F.col("y").alias("cam_y"))
    return near_pairs(cameras, placed, reach, ("cam_x", "cam_y"), ("mid_x", "mid_y"), strict=True).drop("cam_x", "cam_y", "mid_x", "mid_y", "distance")


def with_heights(ring: Column) -> Column:
    """A ring whose zero heights are those of the nearest vertices that have one; null where none has."""
    z = nearest_nonzero(F.transform(ring, lambda p: p["z"]))
    known = F.exists(ring, lambda p: p["z"] != 0)
    return F.when(known, F.transform(ring, lambda p, i: vector(p["x"], p["y"], F.get(z, i))))


def one_side(us: Column, width: Column) -> Column:
    """Pixels across a panorama's seam: those of the side with the larger extent, the others moved to its edge."""
    left, right = F.filter(us, lambda u: u < width / 2), F.filter(us, lambda u: u >= width / 2)
    extent = lambda v: F.coalesce(F.array_max(v) - F.array_min(v), F.lit(0.0))
    keep_left = extent(left) > extent(right)
    split = F.array_max(us) - F.array_min(us) > width / 2
    moved = F.transform(us, lambda u: F.when(keep_left, F.when(u < width / 2, u).otherwise(F.lit(0.0))).otherwise(F.when(u >= width / 2, u).otherwise(width - 1)))
    return F.when(split, moved).otherwise(us)


def spherical_annotations(objects: DataFrame, poses: DataFrame, width: int = 8000, height: int = 4000, reach: float = 20.0) -> DataFrame:
    """``object_id, frame_id, ring, box, area`` of objects in the panoramas taken within reach.

    ``poses``: ``frame_id, x, y, z, yaw, pitch, roll``.  Objects without any
    height and boxes as wide as ``MOST_WIDTH`` are left out.
    """
    w, h = F.lit(float(width)), F.lit(float(height))
    near = _near(objects.withColumn("ring", with_heights(F.col("ring"))).filter("ring IS NOT NULL"), poses, reach)
    turned = with_camera(near, "pose").withColumn("c", F.transform("ring", lambda p: seen_from(p, F.col("pose"), F.col("matrix"))))
    seen = turned.withColumn("px", F.transform("c", lambda c: panorama_pixel(c, w, h))).drop("c", "matrix")
    us = F.transform("px", lambda p: F.greatest(F.least(p["u"], w - 1), F.lit(0.0)))
    sided = seen.withColumn("us", one_side(us, w)).withColumn("vs", F.transform("px", lambda p: F.greatest(F.least(p["v"], h - 1), F.lit(0.0))))
    ring = F.flatten(F.zip_with("us", "vs", lambda u, v: F.array(u, v)))
    drawn = sided.withColumn("ring", ring).withColumn("box", ring_box(F.col("ring"))).filter(F.col("box.w") < MOST_WIDTH)
    return drawn.select("object_id", "frame_id", "ring", "box", ring_area(F.col("ring")).alias("area"))


def cube_annotations(objects: DataFrame, frames: DataFrame, sensors: DataFrame, pixel: float = 0.001, reach: float = 20.0) -> DataFrame:
    """``object_id, frame_id, sensor, face, ring, box, area`` of objects on the faces of cube maps taken within reach.

    ``frames``: ``frame_id, x, y, z, omega, phi, kappa, camera_model, size``,
    angles in radians; ``sensors``, the catalogue: ``camera_model, mosaic``, an
    array of ``sensor, latmin, latmax, longmin, longmax, dx, dy, dz``.  The
    vertices of an object are dealt to sensors and faces, and each face that
    has enough of them gets a ring.
    """
    near = _near(objects, frames, reach).withColumn("camera_model", F.col("pose.camera_model")).join(sensors, "camera_model")
    vertices = with_frame(near, "pose").select("object_id", "frame_id", "pose", "mosaic", "matrix", F.posexplode("ring").alias("nth", "p")).withColumn("f", seen_from(F.col("p"), F.col("pose"), F.col("matrix"))).drop("matrix")
    dealt = vertices.withColumn("sensor", sensor_of(lat_lon(F.col("f")), F.col("mosaic"))).withColumn("face", face_of(F.col("f"))).filter(~F.col("face").isin(*SKIPPED_FACES))
    cell = F.get(F.filter("mosaic", lambda c: c["sensor"] == F.col("sensor")), F.lit(0))
    seen = dealt.withColumn("cell", cell).filter("cell IS NOT NULL").withColumn("m", frame_to_model(F.col("f"), vector(F.col("cell.dx"), F.col("cell.dy"), F.col("cell.dz")), F.col("face")))
    size = F.col("pose.size").cast("double")
    px = image_to_pixel(model_to_image(F.col("m"), size * pixel / 2), F.lit(pixel), size, size)
    rows = seen.withColumn("px", px).groupBy("object_id", "frame_id", "sensor", "face").agg(F.sort_array(F.collect_list(F.struct("nth", "px"))).alias("v"))
    ring = F.flatten(F.transform("v", lambda e: F.array(e["px"]["u"], e["px"]["v"])))
    drawn = rows.filter(F.size("v") > LEAST_VERTICES).withColumn("ring", ring).withColumn("area", ring_area(F.col("ring"))).filter(F.col("area") > LEAST_AREA)
    return drawn.select("object_id", "frame_id", "sensor", "face", "ring", ring_box(F.col("ring")).alias("box"), "area")


def spherical_rays(dets: DataFrame, poses: DataFrame, width: int = 8000, height: int = 4000) -> DataFrame:
    """``det_id, frame_id, origin, direction, mask_area`` of detections (``det_id, frame_id, ring``).

    A detection's middle is that of the ellipse fitted to it, or its centroid
    where none fits.  Detections of frames without a pose are left out.
    """
    pose = F.struct(*[c for c in poses.columns if c != "frame_id"]).alias("pose")
    fitted = dets.join(poses.select("frame_id", pose), "frame_id").withColumn("e", ellipse_of("ring")).withColumn("c", ring_centroid(F.col("ring")))
    u, v = F.coalesce(F.nanvl("e.x", F.col("c.x")), F.col("c.x")), F.coalesce(F.nanvl("e.y", F.col("c.y")), F.col("c.y"))
    ray = spherical_ray(u, v, F.col("pose"), F.lit(float(width)), F.lit(float(height)))
    return fitted.withColumn("r", ray).select("det_id", "frame_id", "r.origin", "r.direction", ring_area(F.col("ring")).alias("mask_area"))


def cube_rays(dets: DataFrame, frames: DataFrame, sensors: DataFrame, pixel: float = 0.001, least_iou: float = 0.85) -> DataFrame:
    """The same for cube maps (``dets`` with ``face``); detections that no ellipse fits well are left out.

    The sensor is the one whose cell of the mosaic the ray points at.
    """
    pose = F.struct(*[c for c in frames.columns if c != "frame_id"]).alias("pose")
    fitted = dets.join(frames.select("frame_id", pose), "frame_id").withColumn("camera_model", F.col("pose.camera_model")).join(sensors, "camera_model").withColumn("e", ellipse_of("ring")).filter(F.col("e.iou") >= least_iou)
    size, step, zero = F.col("pose.size").cast("double"), F.lit(pixel), vector(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    at = (F.col("e.x"), F.col("e.y"))
    level = F.struct(*[F.lit(0.0).alias(c) for c in ("x", "y", "z", "omega", "phi", "kappa")])
    ahead = cube_ray(*at, level, F.col("face"), zero, step, size)["direction"]
    placed = fitted.withColumn("sensor", sensor_of(lat_lon(ahead), F.col("mosaic"))).withColumn("cell", F.get(F.filter("mosaic", lambda c: c["sensor"] == F.col("sensor")), F.lit(0))).filter("cell IS NOT NULL")
    ray = cube_ray(*at, F.col("pose"), F.col("face"), vector(F.col("cell.dx"), F.col("cell.dy"), F.col("cell.dz")), step, size)
    return placed.withColumn("r", ray).select("det_id", "frame_id", "r.origin", "r.direction", ring_area(F.col("ring")).alias("mask_area"))


def without_pose(dets: DataFrame, poses: DataFrame) -> DataFrame:
    """``frame_id, n``: frames of detections that have no pose, and how many detections they cost."""
    return dets.join(poses.select("frame_id"), "frame_id", "left_anti").groupBy("frame_id").agg(F.count("*").alias("n"))
