"""What kept steps from growing with their input: copies, sorts of pairs, frames read again for each row, few tasks."""

import random
import time

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rayloom.functions import geometry, outlines
from rayloom.operators import control, matching, panorama, spatial, triangulation

BOX = "struct<x:double,y:double,w:double,h:double>"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_best_label_compares_equal_boxes_once_and_sorts_no_pairs(spark):
    rng = random.Random(5)
    draw = lambda n: [(i, i % 2, (float(rng.randrange(40)), float(rng.randrange(40)), 10.0, float(8 + i % 2))) for i in range(n)]
    some, told = draw(60), draw(40)
    told += [(100 - i, im, b) for i, im, b in told]  # copies with other ids
    dets = spark.createDataFrame(some, f"det_id long, image_id long, box {BOX}")
    labels = spark.createDataFrame([(i, im, b) for i, im, b in told], f"label_id long, image_id long, box {BOX}")

    def iou(p, q):
        both = max(min(p[0] + p[2], q[0] + q[2]) - max(p[0], q[0]), 0) * max(min(p[1] + p[3], q[1] + q[3]) - max(p[1], q[1]), 0)
        return both / (p[2] * p[3] + q[2] * q[3] - both)

    meet = lambda p, q: all(p[k] <= q[k] + q[k + 2] and q[k] <= p[k] + p[k + 2] for k in (0, 1))
    want = {}
    for d, im, p in some:
        near = [(-iou(p, q), i) for i, jm, q in told if im == jm and meet(p, q)]
        if near:
            want[d] = min(near)[1]
    best = matching.best_labels(dets, labels, cell=16.0)
    assert {r.det_id: r.label_id for r in best.collect()} == want
    assert "SortAggregate" not in plan_of(best)
    assert plan_of(best).count("min(label_id") >= 2  # labels of one box as one row, before the join


def test_next_unchecked_reads_no_shrinking_frame(spark):
    rng = random.Random(2)
    rows = [(i, i % 3, rng.choice(["unchecked", "validated"])) for i in range(60)]
    found = control.next_unchecked(spark.createDataFrame(rows, "id long, grp long, state string"), "id", ["grp"])
    for r in found.collect():
        free = [i for i, g, s in rows if g == r.grp and s == "unchecked"]
        assert r.next_id == min((i for i in free if i > r.id), default=min(free, default=None))
    assert "RowFrame, 1, unboundedfollowing" not in plan_of(found)


def test_outliers_of_a_long_list(spark):
    """Mean and spread once a list: once a value, 20,000 of them are 400 million additions, and more for the spread."""
    rows = spark.range(20000).select((F.col("id") % 50).cast("double").alias("v")).unionByName(spark.createDataFrame([(1e6,)], "v double"))
    held = rows.agg(F.collect_list("v").alias("v"))
    began = time.perf_counter()
    assert held.select(F.size(geometry.without_outliers(F.col("v"), 1.5)).alias("n")).first().n == 20000
    assert time.perf_counter() - began < 20


def test_greedy_by_bands_equals_one_pass(spark):
    """Crowded places: many pairs within reach, of which few are looked at."""
    rng = random.Random(8)
    draw = lambda n: [(i, float(rng.randrange(60)), float(rng.randrange(60))) for i in range(n)]
    a, b = draw(300), draw(200)
    assert len(matching._bands(spark.createDataFrame(b, "rid long, rx double, ry double"), 50.0, ("rx", "ry"), ())) > 3
    found = matching.greedy_pairs(spark.createDataFrame(a, "id long, x double, y double"), spark.createDataFrame(b, "rid long, rx double, ry double"), 50.0, ("x", "y"), ("rx", "ry"), "id", "rid")
    left, right, want = set(), set(), set()
    for d, i, j in sorted((((x - u) ** 2 + (y - v) ** 2) ** 0.5, i, j) for i, x, y in a for j, u, v in b):
        if d < 50 and i not in left and j not in right:
            left.add(i), right.add(j), want.add((i, j))
    assert {(r.id, r.rid) for r in found.collect()} == want


def test_seen_often_by_counts(spark):
    rng = random.Random(4)
    draw = lambda n: [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(n)]
    truth, cams = draw(80), draw(90)
    told = control.seen_often(spark.createDataFrame(truth, "id long, x double, y double"), spark.createDataFrame(cams, "c long, cam_x double, cam_y double"), "id", 12.0, 4)
    assert {r.id for r in told.collect()} == {i for i, x, y in truth if sum((x - u) ** 2 + (y - v) ** 2 <= 144 for _, u, v in cams) >= 4}


def test_pairs_of_rings_are_swept_together(monkeypatch):
    calls = []
    real = outlines.areas_of
    monkeypatch.setattr(outlines, "areas_of", lambda *a: calls.append(1) or real(*a))
    square = lambda x, n: [x, 0.0, x + n, 0.0, x + n, n, x, n]
    got = geometry.ring_iou.func(pd.Series([square(0.0, 2.0)] * 100 + [None]), pd.Series([square(1.0, 2.0)] * 101))
    assert np.allclose(got[:100], 1 / 3) and got[100] == 0 and len(calls) == 1


@pytest.mark.parametrize("name", ["polygon_masks", "polygon_iou", "fitted_ellipses", "fitted_planes", "grown_areas", "spherical_rays", "cube_rays"])
def test_work_on_rows_is_spread_before_it_is_done(spark, name):
    """A small file is one task, however much is made of its rows."""
    from __spark_entry__ import queries

    assert "REPARTITION_BY_NUM" in plan_of(queries()[name](spark, "/root/testdata/sf0.001"))


def test_equal_areas_are_compared_once(spark, monkeypatch):
    square = lambda x: [x, 0.0, x + 4.0, 0.0, x + 4.0, 4.0, x, 4.0]
    left = spark.createDataFrame([(i, square(float(i % 3) * 3)) for i in range(30)] + [(99, None)], "det_id long, ring array<double>")
    right = spark.createDataFrame([(i, square(float(i % 2) * 3 + 1)) for i in range(20)], "label_id long, ring array<double>")
    unlike, members = spatial.alike(left, "det_id", "ring")
    assert {r.det_id for r in unlike.collect()} == {0, 1, 2} and {(r.det_id, r.of) for r in members.collect()} == {(i, i % 3) for i in range(30)}
    got = spatial.ring_pairs(left.withColumnRenamed("ring", "left_ring"), right.withColumnRenamed("ring", "right_ring"), "det_id", "label_id", cell=4.0)
    want = {(i, j) for i in range(30) for j in range(20) if abs(i % 3 * 3 - (j % 2 * 3 + 1)) < 4}
    rows = [(r.det_id, r.label_id) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    tags = control.tagged_areas(left, right, cell=4.0)
    assert {(r.det_id, r.label_id) for r in tags.filter("tag = 'TP'").collect()} == {(0, 0), (1, 1)}


def test_points_in_crowded_areas(spark):
    """Many areas over each other: cells that lie inside any of them take their points without its outline."""
    rng = random.Random(6)
    diamonds = [(rng.uniform(0, 60), rng.uniform(0, 60), 12.5) for _ in range(40)]
    areas = spark.createDataFrame([([x - r, y, x, y - r, x + r, y, x, y + r],) for x, y, r in diamonds] + [(None,)], "ring array<double>")
    points = [(i, rng.uniform(-20, 80), rng.uniform(-20, 80)) for i in range(300)]
    got = spatial.in_polygons(spark.createDataFrame(points + [(999, None, 1.0)], "id long, x double, y double"), areas, cell=16.0)
    assert sorted(r.id for r in got.collect()) == [i for i, x, y in points if any(abs(x - u) + abs(y - v) < r for u, v, r in diamonds)]
    assert "whole-" in str(got.inputFiles())


def test_detections_of_all_sizes_are_shuffled_once(spark):
    """Twice by cells and twice by id, with a row for every cell that a box covers, before."""
    rng = random.Random(4)
    side = lambda: float(rng.choice([0, 1, 7, 31, 32, 33, 64, 300, 5000]))
    rows = lambda n: [(i, i % 2, (float(rng.randrange(-200, 400)), float(rng.randrange(-200, 400)), side(), side())) for i in range(n)]
    some, told = [*rows(150), (150, 0, None)], rows(80)
    dets = spark.createDataFrame(some, f"det_id long, image_id long, box {BOX}").withColumn("score", F.col("det_id") / 10)
    labels = spark.createDataFrame(told, f"label_id long, image_id long, box {BOX}")

    def iou(p, q):
        both = max(min(p[0] + p[2], q[0] + q[2]) - max(p[0], q[0]), 0) * max(min(p[1] + p[3], q[1] + q[3]) - max(p[1], q[1]), 0)
        whole = p[2] * p[3] + q[2] * q[3] - both
        return both / whole if whole else 0

    meet = lambda p, q: all(p[k] <= q[k] + q[k + 2] and q[k] <= p[k] + p[k + 2] for k in (0, 1))
    want = {d: min(near)[1] for d, im, p in some if p and (near := [(-iou(p, q), i) for i, jm, q in told if im == jm and meet(p, q)])}
    best = matching.best_labels(dets, labels, carry=["score"])
    assert {r.det_id: r.label_id for r in best.collect()} == want
    assert all(r.score == r.det_id / 10 for r in best.collect())
    by_id = [line for line in plan_of(best).splitlines() if "hashpartitioning" in line and "det_id" in line]
    assert not by_id and plan_of(best).count("left_x") > 0


def test_fragments_of_a_dense_spot_give_few_links(spark):
    """All pairs of them before, and a median that took every pair's scores."""
    rng = random.Random(6)
    dense = [(i, (rng.random() * 30, rng.random() * 30, 60.0, 60.0)) for i in range(200)]
    loose = [(200 + i, (rng.random() * 3000, rng.random() * 3000, 90.0, 60.0)) for i in range(200)]
    rows = [(i, "val", i % 2, round(rng.random(), 3), 1, b, [[b[0], b[1], b[0] + b[2], b[1], b[0] + b[2], b[1] + b[3]]]) for i, b in dense + loose]
    dets = spark.createDataFrame(rows, f"id long, dataset string, image_id long, score double, category_id int, box {BOX}, segmentation array<array<double>>")
    links, pairs = panorama.fragment_links(dets), panorama.fragment_pairs(dets)
    assert links.count() < 1200 < pairs.count()
    of = {r.id: r.group_id for r in panorama.grouped(links).collect()}
    assert of == {r.id: r.group_id for r in panorama.grouped(pairs).collect()}
    score = {r[0]: r[3] for r in rows}
    taken = pd.DataFrame([(of[p.a], score[k]) for p in pairs.collect() for k in (p.a, p.b)], columns=["id", "score"]).groupby("id")["score"].median()
    got = {r.id: r.score for r in panorama.merge_fragments(dets).collect()}
    assert got == pytest.approx(taken.to_dict())


def test_pixels_of_the_seam_have_one_place(spark, tmp_path):
    """Points right behind the camera were at either edge of the panorama."""
    ids = [1368101, 4837805, 970305, 3025603, 1]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.sql(entry.oracle_sql()["panorama_pixels"]).fetchall())
    got = sorted(map(tuple, entry.queries()["panorama_pixels"](spark, str(tmp_path)).collect()))
    assert got == want and all(0 <= r[4] < 8000 for r in got)


def test_crossings_of_rays_that_can_meet_against_all_pairs(spark):
    """Rays are dealt to the cells that they can cross others in, so far fewer pairs are compared than origins within two radii make."""
    rng, rows = random.Random(8), []
    for i in range(240):
        d = np.array([rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(-1, 0.1)])
        rows.append((i % 2, i, i // 6, np.array([rng.uniform(-30, 30), rng.uniform(-9, 9), rng.uniform(2, 3)]), d / np.linalg.norm(d)))
    point = "struct<x:double,y:double,z:double>"
    df = spark.createDataFrame([(t, i, f, tuple(map(float, o)), tuple(map(float, d))) for t, i, f, o, d in rows], f"trajectory long, ray_id long, frame long, origin {point}, direction {point}")

    def plain(height):
        best = {}
        for t, i, f, o, d in rows:
            for s, j, g, p, e in rows:
                c = d @ e
                if t != s or f >= g or abs(1 - c * c) < 1e-6 or np.linalg.norm(p - o) > 20:
                    continue
                u, v = ((p - o) @ d - ((p - o) @ e) * c) / (1 - c * c), (((p - o) @ d) * c - (p - o) @ e) / (1 - c * c)
                a, b = o + u * d, p + v * e
                low = min(o[2], p[2])
                if 0 <= min(u, v) and max(u, v) <= 10 and np.linalg.norm(a - b) <= 0.4 and not (height and not low - 3.8 < (a[2] + b[2]) / 2 < low - 2.0):
                    best[t, j, f] = min(best.get((t, j, f), (9.0, 0)), (np.linalg.norm(a - b), i))
        return {(*k, i) for k, (_, i) in best.items()}

    for height in (True, False):
        got = [(r.trajectory, r.ray_b, r.frame_a, r.ray_a) for r in triangulation.crossings(df, 0.4, 10.0, height).collect()]
        assert len(got) == len(set(got)) and set(got) == plain(height) and len(got) > 5


def test_crossings_of_another_trajectory_link_nothing(spark):
    rows = [(0, 1, 2, (0.0, 0.0, 0.0)), (0, 3, 4, (0.8, 0.0, 0.0)), (1, 5, 6, (0.4, 0.0, 0.0))]
    df = spark.createDataFrame([(t, a, b, 0, 1, p, i) for i, (t, a, b, p) in enumerate(rows)], "trajectory long, ray_a long, ray_b long, frame_a long, frame_b long, point struct<x:double,y:double,z:double>, crossing_id long")
    assert {r.crossing_id: r.cluster for r in triangulation.peeled(df, 0.5).collect()} == {0: 0, 1: 1, 2: 2}


@pytest.mark.parametrize("axes", ["xy", "xyz"])
def test_clusters_across_blocks_and_of_equal_points(spark, axes):
    rng = random.Random(len(axes))
    spots = [tuple(rng.uniform(-9, 9) if c == "x" else rng.uniform(-2, 2) for c in axes) for _ in range(150)]
    rows = [(i, i % 2, *spots[rng.randrange(150)]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k long, " + ", ".join(f"{c} double" for c in axes))
    for keys in ([], ["k"]):
        lead = {r[0]: r[0] for r in rows}
        changed = True
        while changed:
            changed = False
            for r in rows:
                for s in rows:
                    if lead[s[0]] < lead[r[0]] and (not keys or r[1] == s[1]) and np.linalg.norm(np.subtract(r[2:], s[2:])) <= 0.5:
                        lead[r[0]], changed = lead[s[0]], True
        found = spatial.clusters(df, "id", axes, 0.5, keys)
        assert {r.node: r.component for r in found.collect()} == lead


def test_travel_order_takes_many_stretches_in_one_call(spark):
    """Groups of a task come as sorted batches, cut where a stretch ends: a call for each group costs more than its rows."""
    rng = random.Random(4)
    rows = [(i % 5 if i < 200 else 7, i, float(rng.randrange(60)) if i % 41 else None, rng.uniform(0, 90) if i % 37 else None, rng.uniform(0, 30), 0.0) for i in range(320)]
    df = spark.createDataFrame(rows, "grp long, frame_id long, time double, x double, y double, z double")
    want = {}
    for g in {r[0] for r in rows}:
        todo, order, last = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is None, r[2], r[1])), [], None
        first = min(todo, key=lambda r: (r[2] is not None, r[2], r[1]))  # the first one of all, alone; no time comes before any
        while todo:
            seed = todo[0]
            near = [r for r in todo if r is seed or seed is not first and None not in (r[3], seed[3]) and np.hypot(r[3] - seed[3], r[4] - seed[4]) <= 10]
            order.append((seed, near))
            todo = [r for r in todo if r not in near]
        order.sort(key=lambda o: (o[0][2] is not None, o[0][2], o[0][1]))
        n = 0
        for seed, near in order:
            way = (1.0, 0.0)
            if last is not None and None not in (seed[3], last[3]):
                d = np.hypot(seed[3] - last[3], seed[4] - last[4])
                way = ((seed[3] - last[3]) / d, (seed[4] - last[4]) / d) if d >= 1e-6 else way
            last = seed
            for r in sorted(near, key=lambda r: (-np.inf if r[3] is None else r[3] * way[0] + r[4] * way[1], r[2] is not None, r[2], r[1])):
                want[g, r[1]] = n
                n += 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # stretches go across batches
    try:
        found = triangulation.travel_order(df, ["grp"])
        assert {(r.grp, r.frame_id): r.sort_index for r in found.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_stretches_are_cut_from_batches():
    keys = [0] * 3 + [1] * 9 + [2] + [3] * 4 + [4] * 2
    for size in range(1, len(keys) + 1):
        batches = [pa.record_batch({"k": keys[i : i + size], "n": list(range(i, min(i + size, len(keys))))}) for i in range(0, len(keys), size)]
        got = list(triangulation._stretches(iter(batches), ["k"]))
        assert [n for t in got for n in t.column("n").to_pylist()] == list(range(len(keys)))
        seen = [set(t.column("k").to_pylist()) for t in got]
        assert all(not a & b for i, a in enumerate(seen) for b in seen[:i])


def test_equal_shapes_are_grown_once(spark):
    """A shape of each row was grown before, however few unlike ones there are."""
    square = lambda n: [[0.0, 0.0, n, 0.0, n, n, 0.0, n]]
    rows = [(i, square(2.0 + i % 3)) for i in range(60)] + [(98, []), (99, None)]
    worked = []

    def work(unlike):
        worked.append(unlike.count())
        return unlike.select("s", outlines.grown(-0.5)("s").alias("t"))

    got = {r.id: r.t for r in spatial.once_each(spark.createDataFrame(rows, "id long, s array<array<double>>"), "s", work).collect()}
    assert worked == [4] and got == {i: t and [[0.5, 0.5, t - 0.5, 0.5, t - 0.5, t - 0.5, 0.5, t - 0.5]] for i, t in [(i, 2.0 + i % 3) for i in range(60)]} | {98: [], 99: None}
    plan = plan_of(entry.queries()["grown_areas"](spark, "/root/testdata/sf0.001"))
    assert "HashAggregate" in plan[plan.rindex("ArrowEvalPython") :]  # Python gets unlike shapes only


def test_many_pairs_of_points_make_small_files(spark, tmp_path):
    """A distance took eight bytes of a file, and its rounding by way of text most of the time."""
    rng = random.Random(9)
    draw = lambda n: [(i, float(rng.randrange(900)), float(rng.randrange(900))) for i in range(n)]
    some, told = draw(600), draw(9000)
    left, right = spark.createDataFrame(some, "sid long, sx double, sy double"), spark.createDataFrame(told, "id long, x double, y double")
    size = {}
    for fine in (1, 4):
        pairs = spatial.near_pairs(left, right, 500.0, ("sx", "sy"), ("x", "y"), fine=fine).select("id", "sid", "distance")
        pairs.write.parquet(f"{tmp_path}/{fine}")
        size[fine] = sum(f.stat().st_size for f in (tmp_path / str(fine)).glob("*.parquet"))
    assert "SortMergeJoin" in plan_of(pairs)  # copies of the left points are not broadcast by the size of their file
    xy, uv = np.array(some)[:, 1:], np.array(told)[:, 1:]
    near = [np.flatnonzero(np.hypot(*(uv - p).T) <= 500) for p in xy]
    got = spark.read.parquet(f"{tmp_path}/4").toPandas()
    assert len(got) == sum(map(len, near)) and set(zip(got.sid, got.id)) == {(i, int(j)) for i, js in enumerate(near) for j in js}
    assert size[4] < 0.6 * size[1]


def test_distances_are_rounded_as_numbers(spark):
    whole = spark.range(250001).select(F.sqrt(F.col("id").cast("double")).alias("d"))  # every distance that the query can have
    assert whole.filter(F.round("d", 6) != F.rint(F.col("d") * 1e6) / 1e6).isEmpty()
    assert " round(" not in plan_of(entry.queries()["radius_join"](spark, "/root/testdata/sf0.001"))


def test_pairs_of_equal_areas_become_rows_last(spark, monkeypatch):
    """Pairs of every row on the left were shuffled and sorted before; ids go as arrays, of several pieces where many areas are equal."""
    monkeypatch.setattr(spatial, "PIECES", (2, 3))
    square = lambda x: [x, 0.0, x + 4.0, 0.0, x + 4.0, 4.0, x, 4.0]
    some = [(k, i, square(float(i % 3) * 3)) for k in (0, 1) for i in range(20 + k)] + [(0, 99, None)]
    told = [(k, i, square(float(i % 4) * 3 + 1)) for k in (0, 1) for i in range(31 - k)] + [(1, 98, None), (2, 97, square(1.0))]
    left, right = spark.createDataFrame(some, "k long, l long, left_ring array<double>"), spark.createDataFrame(told, "k long, r long, right_ring array<double>")
    found = spatial.ring_pairs(left, right, "l", "r", ["k"], cell=4.0)
    want = sorted((k, i, j) for k, i, p in some for h, j, q in told if k == h and p and q and abs(p[0] - q[0]) < 4)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 500
    plan = plan_of(found)
    assert plan.index("Generate explode(_rights") < plan.index("Generate explode(_lefts") < plan.index("Join") < plan.index("Exchange")
