"""Headers of point clouds, ellipses from sums, and counts that a plan gathers."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rayloom.functions.geometry import fit_ellipse
from rayloom.operators import conics, matching
from rayloom.operators.conserved import Conservation, NotConserved
from rayloom.sources import las


def las_header(n, low, high, version=(1, 2), size=227):
    data = bytearray(max(size, 227))
    data[:4], data[24], data[25] = b"LASF", *version
    struct.pack_into("<I", data, 107, n if version < (1, 4) else 0)
    struct.pack_into("<6d", data, 179, high[0], low[0], high[1], low[1], high[2], low[2])
    if version >= (1, 4):
        struct.pack_into("<Q", data, 247, n)
    return bytes(data)


def test_bounds_of_point_clouds(spark, tmp_path):
    (tmp_path / "a.las").write_bytes(las_header(7, (1.0, 2.0, 3.0), (4.0, 6.0, 9.0)) + b"x" * 1000)
    (tmp_path / "b.LAZ").write_bytes(las_header(5_000_000_000, (0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (1, 4), 375))
    (tmp_path / "c.las").write_bytes(b"LASF")
    (tmp_path / "d.las").write_bytes(b"")
    (tmp_path / "e.las").write_bytes(b"\0" * 400)
    (tmp_path / "f.txt").write_bytes(las_header(1, (0.0, 0.0, 0.0), (1.0, 1.0, 1.0)))
    got = {r.filename: r for r in las.read_las_bounds(spark, str(tmp_path)).collect()}
    assert {k: r.num_pts for k, r in got.items()} == {"a.las": 7, "b.LAZ": 5_000_000_000, "c.las": 0, "d.las": 0, "e.las": 0}
    assert got["a.las"].ring == [1.0, 2.0, 4.0, 2.0, 4.0, 6.0, 1.0, 6.0, 1.0, 2.0] and got["a.las"].maxz == 9.0
    assert got["c.las"].ring is None and got["c.las"].minx is None
    assert las.header(las_header(1, (5.0, 0.0, 0.0), (1.0, 1.0, 1.0))) is None  # bounds the wrong way round


def test_ellipses_from_sums(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for g in range(12):
        t, far = rng.random(400) * 2 * np.pi, 1 + 0.01 * rng.standard_normal(400)
        a, b, turn, x0, y0 = 3 + g, 2.0, 0.3 * g, 2.6e6 + 10 * g, 1.2e6
        x, y = x0 + far * (a * np.cos(t) * math.cos(turn) - b * np.sin(t) * math.sin(turn)), y0 + far * (a * np.cos(t) * math.sin(turn) + b * np.sin(t) * math.cos(turn))
        rows += [(g, float(p), float(q)) for p, q in zip(x, y)]
        want[g] = fit_ellipse(np.column_stack((x, y)).ravel())
    rows += [(90, float(i), 1.0) for i in range(9)] + [(91, 1.0, 1.0)] * 7 + [(92, float(i), float(i * i)) for i in range(3)] + [(None, float(np.cos(i)), float(np.sin(i))) for i in range(9)] + [(93, None, 1.0)]
    got = {r.g: r for r in conics.ellipses(spark.createDataFrame(rows, "g int, x double, y double").repartition(7), ["g"]).collect()}
    for g, fit in want.items():
        e = got[g].ellipse
        assert (e.x, e.y) == pytest.approx(fit[:2], abs=1e-6) and sorted((e.a, e.b)) == pytest.approx(sorted(fit[2:4]), rel=1e-6)
        assert len(e.ring) == 130 and e.ring[:2] == e.ring[-2:] and got[g].n == 400
    assert all(got[g].ellipse.x is None and got[g].ellipse.ring is None for g in (90, 91, 92)) and 93 not in got
    assert got[None].ellipse.a == pytest.approx(1, abs=1e-6)


def test_counts_of_a_plan(spark):
    box = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(4.0).alias("w"), F.lit(4.0).alias("h"))
    dets = spark.range(5).select(F.col("id").alias("det_id"), (F.col("id") % 3).alias("image_id"), box.alias("box"), F.lit(0.5).alias("score"), F.lit(0).alias("det_class"))
    labels = spark.range(4).select(F.col("id").alias("label_id"), F.col("id").alias("image_id"), box.alias("box"), F.lit(1).alias("label_class"))
    check = Conservation()
    tags = matching.tagged(dets, labels, check=check)
    assert tags.count() == 6
    assert check.verify() == {"detections": {"all": 5}, "labels": {"all": 4}, "tags": {"all": 6, "TP": 3, "FP": 2, "FN": 1}}
    check.expect("tags.FP", "labels")
    with pytest.raises(NotConserved, match="tags.FP is 2, labels is 4"):
        check.verify()
    lost = Conservation()
    seen = lost.watch(dets, "in")
    lost.expect("in", "out")
    lost.watch(seen.filter("det_id > 1"), "out").collect()
    with pytest.raises(NotConserved):
        lost.verify()
