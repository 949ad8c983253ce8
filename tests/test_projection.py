"""Objects drawn into panoramas, and rays cast back at them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rayloom.operators import projection

VERTEX = "struct<x:double,y:double,z:double>"


def disc(cx, cy, cz, r=0.35, n=80):
    t = np.linspace(0, 2 * np.pi, n, endpoint=False)
    return [(float(cx + r * np.cos(a)), float(cy + r * np.sin(a)), float(cz)) for a in t]


def objects(spark, places):
    return spark.createDataFrame([(i, disc(*p)) for i, p in enumerate(places)], f"object_id long, ring array<{VERTEX}>")


def misses(rows, places):
    """How far each ray passes from its object's middle."""
    out = []
    for r in rows:
        o, d, p = np.array(r.origin), np.array(r.direction), np.array(places[r.det_id])
        out.append(np.linalg.norm((p - o) - np.dot(p - o, d) * d))
    return out


def test_spherical_there_and_back(spark):
    places = [(3.0, 4.0, 0.5), (-5.0, 2.0, 0.4), (60.0, 60.0, 0.1)]
    poses = spark.createDataFrame([(9, 0.0, 0.0, 3.0, 30.0, 2.0, -1.0)], "frame_id long, x double, y double, z double, yaw double, pitch double, roll double")
    drawn = projection.spherical_annotations(objects(spark, places), poses)
    assert sorted(r.object_id for r in drawn.collect()) == [0, 1]  # the third is out of reach
    rays = projection.spherical_rays(drawn.select(F.col("object_id").alias("det_id"), "frame_id", "ring"), poses).collect()
    assert len(rays) == 2 and max(misses(rays, places)) < 0.05


def test_objects_without_heights_are_left_out(spark):
    poses = spark.createDataFrame([(9, 0.0, 0.0, 3.0, 0.0, 0.0, 0.0)], "frame_id long, x double, y double, z double, yaw double, pitch double, roll double")
    assert projection.spherical_annotations(objects(spark, [(3.0, 4.0, 0.0)]), poses).count() == 0


@pytest.mark.parametrize("us, want", [([10.0, 50.0, 30.0], [10.0, 50.0, 30.0]), ([5.0, 90.0, 7990.0], [5.0, 90.0, 0.0]), ([5.0, 7900.0, 7990.0], [7999.0, 7900.0, 7990.0])])
def test_seam(spark, us, want):
    assert spark.range(1).select(projection.one_side(F.array(*map(F.lit, us)), F.lit(8000.0)).alias("u")).first().u == want


def test_cube_there_and_back(spark):
    # looking along the frame's axes: the object lies in front of face 0
    places = [(0.3, 0.2, -4.0), (40.0, 0.0, -4.0)]
    frames = spark.createDataFrame([(7, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, "m", 2048)], "frame_id long, x double, y double, z double, omega double, phi double, kappa double, camera_model string, size int")
    cell = "struct<sensor:int,latmin:double,latmax:double,longmin:double,longmax:double,dx:double,dy:double,dz:double>"
    sensors = spark.createDataFrame([("m", [(3, -90.0, 90.0, -180.0, 179.9999, 0.02, 0.01, 0.0)])], f"camera_model string, mosaic array<{cell}>")
    drawn = projection.cube_annotations(objects(spark, places), frames, sensors)
    rows = drawn.collect()
    assert [(r.object_id, r.sensor, r.face) for r in rows] == [(0, 3, 0)] and rows[0].area > 200
    rays = projection.cube_rays(drawn.select(F.col("object_id").alias("det_id"), "frame_id", "face", "ring"), frames, sensors).collect()
    assert len(rays) == 1 and misses(rays, places)[0] < 0.02
