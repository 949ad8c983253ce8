"""Operators on small fixtures with known answers, and against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rayloom.functions import camera, geometry, names
from rayloom.operators import control, evaluation, graph, matching, panorama, spatial, tiling, triangulation

BOX = "struct<x:double,y:double,w:double,h:double>"


def boxes(spark, rows, kind):
    if kind == "det":
        return spark.createDataFrame([(i, im, b, s, 0) for i, im, b, s in rows], f"det_id long, image_id long, box {BOX}, score double, det_class int")
    return spark.createDataFrame([(i, im, b, 1) for i, im, b in rows], f"label_id long, image_id long, box {BOX}, label_class int")


def test_competition_has_no_second_best(spark):
    labels = boxes(spark, [(1, 0, (0.0, 0.0, 10.0, 10.0)), (2, 0, (8.0, 0.0, 10.0, 10.0))], "label")
    dets = boxes(spark, [(1, 0, (0.0, 0.0, 10.0, 10.0), 0.9), (2, 0, (1.0, 0.0, 10.0, 10.0), 0.8)], "det")
    tags = {(r.tag, r.det_id, r.label_id) for r in matching.tagged(dets, labels, cell=4.0).collect()}
    assert tags == {("TP", 1, 1), ("FP", 2, None), ("FN", None, 2)}


def test_low_iou_and_missing_sides(spark):
    labels = boxes(spark, [(1, 0, (0.0, 0.0, 10.0, 10.0))], "label")
    dets = boxes(spark, [(1, 0, (0.0, 6.7, 10.0, 10.0), 0.9)], "det")
    assert sorted(r.tag for r in matching.tagged(dets, labels).collect()) == ["FN", "FP"]
    assert [r.tag for r in matching.tagged(dets, labels.limit(0)).collect()] == ["FP"]
    assert [r.tag for r in matching.tagged(dets.limit(0), labels).collect()] == ["FN"]


def test_overlap_pairs_against_all_pairs(spark):
    rng = random.Random(3)
    draw = lambda n: [(i, rng.randrange(3), (rng.randrange(90), rng.randrange(90), rng.randrange(25), rng.randrange(25))) for i in range(n)]
    a, b = draw(80), draw(90)
    meet = lambda p, q: p[0] <= q[0] + q[2] and q[0] <= p[0] + p[2] and p[1] <= q[1] + q[3] and q[1] <= p[1] + p[3]
    want = sorted((i, j) for i, m, p in a for j, n, q in b if m == n and meet(p, q))
    left = spark.createDataFrame([(i, m, tuple(map(float, p))) for i, m, p in a], f"i long, image_id long, box {BOX}")
    right = spark.createDataFrame([(i, m, tuple(map(float, p))) for i, m, p in b], f"j long, image_id long, box {BOX}")
    for cell in (7.0, 40.0):
        assert sorted((r.i, r.j) for r in spatial.overlap_pairs(left, right, keys=["image_id"], cell=cell).collect()) == want


def test_sweep_equals_tagging_at_each_threshold(spark):
    rng = random.Random(5)
    labels = boxes(spark, [(i, i % 4, (float(rng.randrange(60)), float(rng.randrange(60)), 12.0, 12.0)) for i in range(40)], "label")
    dets = boxes(spark, [(i, i % 4, (float(rng.randrange(60)), float(rng.randrange(60)), 12.0, 12.0), rng.randrange(100) / 100) for i in range(150)], "det")
    swept = {r.threshold: (r.tp, r.fp, r.fn) for r in evaluation.sweep(dets, labels, [0.0, 0.35, 0.8, 1.5]).collect()}
    for t, counts in swept.items():
        tags = [r.tag for r in matching.tagged(dets.filter(F.col("score") >= t), labels).collect()]
        assert counts == tuple(tags.count(k) for k in ("TP", "FP", "FN"))


def test_threshold_grid():
    grid = evaluation.threshold_grid(0.12)
    assert (grid[0], grid[-1], len(grid)) == (0.1, 0.95, 18)


def test_greedy_equals_one_pass(spark):
    rng = random.Random(9)
    left = [(i, rng.random() * 20, rng.random() * 20) for i in range(60)]
    right = [(i, rng.random() * 20, rng.random() * 20) for i in range(50)]
    pairs = sorted((((x - u) ** 2 + (y - v) ** 2) ** 0.5, i, j) for i, x, y in left for j, u, v in right)
    used_l, used_r, want = set(), set(), set()
    for d, i, j in pairs:
        if d < 2.0 and i not in used_l and j not in used_r:
            used_l.add(i), used_r.add(j), want.add((i, j))
    a = spark.createDataFrame(left, "g long, gx double, gy double")
    b = spark.createDataFrame(right, "p long, px double, py double")
    got = matching.greedy_pairs(a, b, 2.0, ("gx", "gy"), ("px", "py"), "g", "p")
    assert {(r.g, r.p) for r in got.collect()} == want
    report = matching.distance_report(got, a, b).first()
    assert (report.tp, report.fn, report.fp) == (len(want), 60 - len(want), 50 - len(want))
    assert matching.greedy_pairs(a.limit(0), b, 2.0, ("gx", "gy"), ("px", "py"), "g", "p").count() == 0


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 300), (None, 5), (5, None)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}, 300: 300}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tile_grid_counts(spark):
    rows = [(1, "a/x.jpg", 8000, 4000, 44, 8, 736), (2, "a/y.jpg", 2048, 2048, 0, 0, 0), (3, "a/z.jpg", 4016, 4016, 74, 74, 0)]
    images = spark.createDataFrame(rows, "image_id long, file_name string, width int, height int, overlap_x int, overlap_y int, padding_y int")
    found = tiling.tiles(images)
    assert {r.image_id: r.n for r in found.groupBy("image_id").agg(F.count("*").alias("n")).collect()} == {1: 85, 2: 16, 3: 81}
    assert found.filter("image_id = 1").agg(F.max("tile_x"), F.max("tile_y")).first()[:] == (7488, 2752)


def test_clip_and_borderline(spark):
    images = spark.createDataFrame([(1, "a.jpg", 1024, 512, 0, 0, 0)], "image_id long, file_name string, width int, height int, overlap_x int, overlap_y int, padding_y int")
    ring = lambda x, y, w, h: [x, y, x + w, y, x + w, y + h, x, y + h]
    anns = [(i, 1, list(b), [ring(*b)]) for i, b in enumerate([(480.0, 100.0, 64.0, 30.0), (2.0, 100.0, 5.0, 9.0), (2000.0, 10.0, 5.0, 5.0)])]
    got = tiling.clipped(spark.createDataFrame(anns, "ann_id long, image_id long, bbox array<double>, segmentation array<array<double>>"), images).orderBy("tile_x").collect()
    assert [(r.ann_id, r.tile_x, tuple(r.box)) for r in got] == [(0, 0, (480.0, 100.0, 32.0, 30.0)), (0, 512, (0.0, 100.0, 32.0, 30.0))]
    assert [r.area for r in got] == [480.0, 960.0]  # the vertex that stays on the edge of the first tile is left out


def test_numbers_are_consecutive_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = sorted((r.k, r.n) for r in tiling.numbered(df, ["k"], "n", 1).collect())
    assert got == [(k, k + 1) for k in range(1000)]


def test_weighted_median_of_fragments(spark):
    seg = lambda x: [[x, 0.0, x + 10, 0.0, x + 10, 10.0, x, 10.0]]
    rows = [(1, 0, "val", 0.9, 1, (0.0, 0.0, 10.0, 10.0), seg(0.0)), (2, 0, "val", 0.5, 1, (5.0, 0.0, 10.0, 10.0), seg(5.0)), (3, 0, "tst", 0.1, 1, (5.0, 0.0, 10.0, 10.0), seg(5.0))]
    dets = spark.createDataFrame(rows, f"id long, image_id long, dataset string, score double, category_id int, box {BOX}, segmentation array<array<double>>")
    got = {(r.dataset, r.id): r for r in panorama.merge_fragments(dets).collect()}
    assert got[("val", 1)].score == pytest.approx(0.7) and got[("val", 1)].n_fragments == 2 and tuple(got[("val", 1)].box) == (0.0, 0.0, 15.0, 10.0)
    assert got[("tst", 3)].score == pytest.approx(0.1)


def test_tile_and_frame_names(spark):
    row = spark.range(1).select(
        names.tile_of(F.lit("images/abc_1_468_736.jpg")).alias("t"), names.frame_of(F.lit("102-lb4-0-35582.jpg")).alias("f"), names.frame_of(F.lit("a-b.jpg")).alias("g"), names.tile_name(F.lit("x/abcgp.jpg"), F.lit(1), F.lit(2)).alias("n"), names.literal_list(F.lit("['a', 'b']")).alias("l")
    ).first()
    assert tuple(row.t) == ("images/abc_1", 468, 736) and tuple(row.f) == ("102-35582", "lb4", "0") and tuple(row.g) == (None, None, None) and row.n == "images/abc_1_2.jpg" and row.l == ["a", "b"]


def test_polygon_overlap_by_sampling():
    rng = np.random.default_rng(1)
    star = np.array([[0, 0], [10, 2], [4, 4], [9, 10], [3, 6], [0, 9]], float).ravel()
    other = np.array([[2, 1], [8, 1], [8, 8], [5, 3], [2, 8]], float).ravel()

    def inside(ring, p):
        v, hit = ring.reshape(-1, 2), np.zeros(len(p), bool)
        for (x, y), (u, w) in zip(v, np.roll(v, -1, axis=0)):
            cross = (y > p[:, 1]) != (w > p[:, 1])
            with np.errstate(all="ignore"):
                hit ^= cross & (p[:, 0] < (u - x) * (p[:, 1] - y) / (w - y) + x)
        return hit

    p = rng.random((200_000, 2)) * 10
    assert geometry.rings_overlap(star, other) == pytest.approx((inside(star, p) & inside(other, p)).mean() * 100, abs=0.4)


def test_ellipse_plane_flatness():
    ring = geometry.ellipse_ring(3.0, -2.0, 5.0, 2.0, 0.4, 40)
    x, y, a, b, angle = geometry.fit_ellipse(ring)
    assert (x, y) == pytest.approx((3, -2)) and sorted((a, b)) == pytest.approx([2, 5])
    assert geometry.fit_ellipse(np.zeros(20)) is None
    xyz = np.array([[i % 5, i // 5, 0.5 * (i % 5) - i // 5 + 2] for i in range(25)], float)
    assert geometry.fit_plane(xyz) == pytest.approx((0.5, -1, 2)) and geometry.is_flat(xyz) and not geometry.is_flat(xyz[:2]) and not geometry.is_flat(xyz * [1, 0, 0])


def test_zero_heights_and_outliers(spark):
    row = spark.range(1).select(geometry.nearest_nonzero(F.array(*map(F.lit, (0.0, 5.0, 0.0, 0.0, 7.0)))).alias("z"), geometry.without_outliers(F.array(*[F.lit(float(v)) for v in [1] * 9 + [100]])).alias("o")).first()
    assert row.z == [5, 5, 5, 7, 7] and row.o == [1.0] * 9


def test_projection_and_rotations(spark):
    w, h = F.lit(8000.0), F.lit(4000.0)
    v = lambda x, y, z: camera.vector(*[F.lit(float(c)) for c in (x, y, z)])
    opk = camera.opk_of_matrix(camera.opk_matrix(F.lit(0.3), F.lit(-0.7), F.lit(1.9)))
    row = spark.range(1).select(camera.spherical_projection(v(0, 0, 1), w, h).alias("a"), camera.spherical_projection(v(1, 0, 0), w, h).alias("b"), F.array(*opk).alias("o"), camera.face_of(v(0, 0, -1)).alias("f")).first()
    assert tuple(row.a) == (4000, 2000) and row.b.u == pytest.approx(6000) and row.o == pytest.approx([0.3, -0.7, 1.9]) and row.f == 0


def test_cube_ray_points_at_what_was_projected(spark):
    frame = F.struct(*[F.lit(x).alias(n) for x, n in ((10.0, "x"), (20.0, "y"), (3.0, "z"), (0.2, "omega"), (-0.4, "phi"), (1.1, "kappa"))])
    offset, size, step = camera.vector(F.lit(0.1), F.lit(0.0), F.lit(-0.05)), F.lit(2048.0), F.lit(0.001)
    rows = spark.createDataFrame([(float(x), float(y), float(z)) for x, y, z in ((14, 22, 1), (8, 30, 0), (10, 12, 2), (11, 20, -4))], "x double, y double, z double")
    p = camera.vector(F.col("x"), F.col("y"), F.col("z"))
    seen = rows.withColumn("frame", frame).withColumn("f", camera.world_to_frame(p, F.col("frame"))).withColumn("face", camera.face_of(F.col("f"))).withColumn("m", camera.frame_to_model(F.col("f"), offset, F.col("face")))
    pixel = seen.withColumn("px", camera.image_to_pixel(camera.model_to_image(F.col("m"), size * step / 2), step, size, size))
    ray = pixel.withColumn("r", camera.cube_ray(F.col("px.u"), F.col("px.v"), F.col("frame"), F.col("face"), offset, step, size))
    for r in ray.collect():
        to = np.array([r.x, r.y, r.z]) - np.array(r.r.origin)
        assert np.dot(to / np.linalg.norm(to), np.array(r.r.direction)) == pytest.approx(1.0)


def rays(spark, rows):
    def unit(o, t):
        d = np.array(t, float) - np.array(o, float)
        return tuple((d / np.linalg.norm(d)).tolist())

    v = "struct<x:double,y:double,z:double>"
    return spark.createDataFrame([(0, i, f, tuple(map(float, o)), unit(o, t)) for i, f, o, t in rows], f"trajectory long, ray_id long, frame long, origin {v}, direction {v}")


def test_rays_cross_parallel_behind(spark):
    got = triangulation.crossings(rays(spark, [(0, 0, (0, 0, 3), (3, 0, 0)), (1, 1, (6, 0, 3), (3, 0, 0)), (2, 2, (0, 1, 3), (3, 1, 0)), (3, 3, (-5, 0, 3), (-9, 0, 0))])).collect()
    one = next(r for r in got if (r.ray_a, r.ray_b) == (0, 1))
    assert tuple(one.point) == pytest.approx((3, 0, 0), abs=1e-9) and one.length == pytest.approx(3 * 2**0.5)
    assert not any({r.ray_a, r.ray_b} == {0, 2} for r in got)


def test_triangulate_finds_planted_places(spark):
    places = [(4.0, 5.0, 0.0), (10.0, -6.0, 0.2), (17.0, 4.0, 0.1)]
    rows, k = [], 0
    for f in range(10):
        o = (2.0 * f, 0.0, 2.8)
        for p in places:
            if np.linalg.norm(np.array(p) - o) < 15:
                rows.append((k, f, o, p))
                k += 1
    got = sorted((round(r.x, 3), round(r.y, 3), round(r.elevation, 3)) for r in triangulation.triangulate(rays(spark, rows)).filter("intersections >= 3").collect())
    assert all(any(np.linalg.norm(np.array(g) - p) < 0.01 for g in got) for p in places)


def peeled_in_turn(rows, reach):
    left, kept = dict(rows), []
    while left:
        ids, lead = sorted(left), {}
        for i in ids:
            lead[i] = i

        def top(i):
            while lead[i] != i:
                i = lead[i]
            return i

        for i in ids:
            for j in ids:
                if i < j and np.linalg.norm(np.array(left[i][2]) - left[j][2]) <= reach and top(i) != top(j):
                    lead[max(top(i), top(j))] = min(top(i), top(j))
        groups = {}
        for i in ids:
            groups.setdefault(top(i), []).append(i)
        first = min(groups.values(), key=lambda g: (-len(g), g[0]))
        used = {r for i in first for r in left[i][:2]}
        kept += first
        left = {i: v for i, v in left.items() if not used & set(v[:2])}
    return sorted(kept)


def test_peeling_equals_one_cluster_at_a_time(spark):
    rng = random.Random(11)
    rows = {i: (rng.randrange(12), 100 + rng.randrange(12), (rng.random() * 4, rng.random() * 4, 0.0)) for i in range(50)}
    df = spark.createDataFrame([(0, a, b, 0, 1, p, i) for i, (a, b, p) in rows.items()], "trajectory long, ray_a long, ray_b long, frame_a long, frame_b long, point struct<x:double,y:double,z:double>, crossing_id long")
    assert sorted(r.crossing_id for r in triangulation.peeled(df, 0.5).collect()) == peeled_in_turn(rows, 0.5)


def test_disc_iou_and_review(spark):
    row = spark.range(1).select(geometry.disc_iou(F.lit(0.0), 0.35).alias("a"), geometry.disc_iou(F.lit(0.7), 0.35).alias("b")).first()
    assert row.a == pytest.approx(1) and row.b == pytest.approx(0, abs=1e-12)
    status = spark.createDataFrame([(1, True, False, 1), (1, False, True, 2), (2, True, False, 1)], "ann_id long, validated boolean, removed boolean, at long")
    states = control.reviewed(spark.range(1, 4).withColumnRenamed("id", "ann_id"), status)
    assert {r.ann_id: r.state for r in states.collect()} == {1: "removed", 2: "validated", 3: "unchecked"}


def test_split_shares(spark):
    images = spark.range(103).select(F.col("id").alias("image_id"), F.lit("a").alias("aoi"))
    got = {r.dataset: r.n for r in tiling.split(images, images.filter("image_id < 100")).groupBy("dataset").agg(F.count("*").alias("n")).collect()}
    assert got == {"trn": 70, "val": 15, "tst": 15, "oth": 3}
    assert {r.dataset for r in tiling.split(images, images, test_only=True).collect()} == {"tst"}


def test_report_by_dataset(spark):
    rows = [("val", "TP", 1, 0), ("val", "FP", None, 1), ("tst", "FN", 2, None)]
    tags = spark.createDataFrame(rows, "dataset string, tag string, label_class int, det_class int")
    told = evaluation.report(tags, spark.createDataFrame([(1, "round"), (2, "square")], "id int, name string"))
    assert {(r.dataset, r.category): (r.tp, r.fp, r.fn) for r in told["by_class"].collect()} == {("val", "round"): (1, 0, 0), ("val", "square"): (0, 1, 0), ("tst", "round"): (0, 0, 0), ("tst", "square"): (0, 0, 1)}
    assert {r.dataset: r.precision for r in told["global"].collect()} == {"val": 0.5, "tst": 0.0}
    assert {(r.dataset, r.true_class): (r["round"], r.square, r.missed_labels) for r in told["confusion"].collect()} == {("val", "round"): (1, 0, 0), ("val", "background"): (0, 1, 0), ("tst", "square"): (0, 0, 1)}
    assert tiling.ambiguous(tags, "dataset").collect()[0][:] == ("val", 2)
