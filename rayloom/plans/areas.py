"""Registered queries on areas, masks, poses, cameras and ids, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rayloom.functions import camera, geometry, names, outlines
from rayloom.lineage import dealt_out
from rayloom.operators import conics, control, evaluation, projection, spatial, tiling
from rayloom.plans import relations as R
from rayloom.plans.queries import DIRECTIONS, MATCHED, REVIEW, _directions, _reviewed, query, rounded, tags

#: Squares of four parts each, near enough to overlap.
SQUARES_SQL = "squares AS (SELECT p_partkey // 4 AS grp, (p_partkey * 7) % 12 AS x, (p_partkey * 11) % 12 AS y, 4 + p_size % 7 AS w, 4 + p_size % 5 AS h FROM part)"


def _squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    x, y = ((k * 7) % 12).cast("double"), ((k * 11) % 12).cast("double")
    w, h = (4 + F.col("p_size") % 7).cast("double"), (4 + F.col("p_size") % 5).cast("double")
    ring = F.array(x, y, x + w, y, x + w, y + h, x, y + h)
    return R.table(spark, sf_dir, "part").groupBy(F.floor(k / 4).alias("grp")).agg(F.collect_list(ring).alias("segmentation"))


@query(f"WITH {SQUARES_SQL}, cells AS (SELECT DISTINCT grp, cx, cy FROM (SELECT grp, cx, unnest(range(y, y + h)) AS cy FROM (SELECT *, unnest(range(x, x + w)) AS cx FROM squares))) SELECT grp, count(*)::DOUBLE AS area, count(*)::DOUBLE AS ring_area FROM cells GROUP BY 1")
def united_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of the union of overlapping squares, as measured and as that of the outlines that come back."""
    told = _squares(spark, sf_dir).select("grp", outlines.united_area("segmentation").alias("area"), outlines.united("segmentation").alias("rings"))
    signed = F.aggregate(F.transform("rings", geometry.signed_area), F.lit(0.0), lambda a, x: a + x)  # holes turn the other way
    return told.select("grp", F.round("area", 6).alias("area"), F.round(signed, 6).alias("ring_area"))


@query("SELECT p_partkey, (n * (n + 1) // 2)::BIGINT AS pixels, n AS n_rows FROM (SELECT p_partkey, 3 + p_size AS n FROM part)")
def polygon_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of right triangles."""
    n = F.col("p_size") + 3.25  # no pixel's middle lies on an edge
    zero = F.lit(0.0)
    rows = dealt_out(R.table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", F.array(F.array(zero, zero, n, zero, zero, n)).alias("segmentation"))
    runs = rows.select("p_partkey", outlines.mask_of(512, 512)("segmentation").alias("runs"))
    pixels = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"] + 1)
    return runs.select("p_partkey", pixels.alias("pixels"), F.size("runs").alias("n_rows"))


@query(f"WITH {R.CUSTOMERS_SQL}, {R.SUPPLIERS_SQL} SELECT id, x, y FROM points p WHERE EXISTS (SELECT 1 FROM sites s WHERE abs(x - sx) + abs(y - sy) < 150.5)")
def points_in_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in any of many diamonds."""
    x, y, r = F.col("sx"), F.col("sy"), 150.5
    areas = R.suppliers(spark, sf_dir).select(F.array(x - r, y, x, y - r, x + r, y, x, y + r).alias("ring"))
    return spatial.in_polygons(R.customers(spark, sf_dir), areas, cell=200.0)


@query(
    f"""WITH {R.CUSTOMERS_SQL}, c AS (SELECT floor(x / 500) * 500 AS cx, floor(y / 500) * 500 AS cy, count(*) AS n FROM points GROUP BY ALL),
g AS (SELECT a.v * 500.0::DOUBLE AS cell_x, b.v * 500.0::DOUBLE AS cell_y FROM (SELECT unnest(range(21)) AS v) a CROSS JOIN (SELECT unnest(range(21)) AS v) b)
SELECT cell_x, cell_y, coalesce(n, 0)::BIGINT AS n FROM g LEFT JOIN c ON cx = cell_x AND cy = cell_y"""
)
def whole_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all cells of a grid, the empty ones included."""
    counts = spatial.counted_on_grid(R.customers(spark, sf_dir), "x", "y", 0.0, 0.0, 500.0)
    return spatial.gridded(counts, 0.0, 0.0, 10500.0, 10500.0, 500.0).select("cell_x", "cell_y", "n")


@query(f"WITH {R.IMAGES_SQL}, {R.ANNOTATIONS_SQL} SELECT ann_id, w * h AS area FROM anns JOIN images USING (image_id) WHERE w * h > greatest(width, height) / 2")
def large_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    anns = R.annotations(spark, sf_dir).withColumn("area", F.get("bbox", F.lit(2)) * F.get("bbox", F.lit(3)))
    return control.large_enough(anns, R.images(spark, sf_dir)).select("ann_id", "area")


@query("SELECT p_partkey FROM part WHERE p_partkey % 3 > 0 AND p_size % 4 > 0")
def masks_with_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = (F.col("p_partkey") % 3).cast("double"), (F.col("p_size") % 4).cast("double")
    zero = F.lit(0.0)
    return control.with_masks(R.table(spark, sf_dir, "part").select("p_partkey", F.array(F.array(zero, zero, w, zero, w, h, zero, h)).alias("segmentation"))).select("p_partkey")


@query(MATCHED + " SELECT tag, image_id, coalesce(det_id, label_id) AS shown_id FROM tags")
def shown_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.shown_id(tags(spark, sf_dir)).select("tag", "image_id", "shown_id")


@query(MATCHED + " SELECT image_id, min(score) FILTER (WHERE tag IS NOT NULL) AS least_score FROM tags GROUP BY 1")
def least_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.least_score(tags(spark, sf_dir), ["image_id"])


@query(REVIEW + " SELECT ann_id, grp FROM states WHERE state = 'validated'")
def validated_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviewed(spark, sf_dir).filter("state = 'validated'").select("ann_id", "grp")


@query(
    REVIEW
    + """ SELECT ann_id, grp, state, coalesce(max(CASE WHEN state = 'unchecked' THEN ann_id END) OVER (PARTITION BY grp ORDER BY ann_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  max(CASE WHEN state = 'unchecked' THEN ann_id END) OVER (PARTITION BY grp)) AS previous_id FROM states"""
)
def previous_unchecked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.previous_unchecked(_reviewed(spark, sf_dir), "ann_id", ["grp"])


@query("SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS det_id FROM orders")
def numbers_per_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return tiling.numbered_within(rows, ["o_orderdate", "o_orderkey"], "det_id", ["o_orderpriority"]).drop("o_orderdate")


@query("SELECT event_id, event_id // 6 * 6 + event_id % 6 AS image_id FROM events")
def cube_image_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return R.table(spark, sf_dir, "events").select("event_id", names.cube_image_id(F.floor(e / 6), e % 6).alias("image_id"))


@query("SELECT p_partkey AS part, p_type AS \"CATEGORY\" FROM part")
def category_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.with_category(R.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_type").alias("Category")))


@query("SELECT o_orderkey % 700 AS frame_id, count(*) AS n FROM orders WHERE o_orderkey % 700 NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY 1")
def frames_without_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections whose frame has no pose are reported, not lost unseen; every other customer is a pose."""
    dets = R.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 700).alias("frame_id"))
    poses = R.table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).otherwise(-F.col("c_custkey")).alias("frame_id"))
    return projection.without_pose(dets, poses)


@query("SELECT event_id, event_id % 100 + 0.5::DOUBLE AS x, event_id % 50 - 0.25::DOUBLE AS y, event_id % 7 + 2.0::DOUBLE AS z, event_id % 360 + 1.0::DOUBLE AS yaw, event_id % 20 - 2.0::DOUBLE AS pitch, event_id % 14 + 3.0::DOUBLE AS roll FROM events")
def camera_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    pose = F.struct(*[(e % m).cast("double").alias(n) for m, n in ((100, "x"), (50, "y"), (7, "z"), (360, "yaw"), (20, "pitch"), (14, "roll"))])
    rows = R.table(spark, sf_dir, "events").select("event_id", camera.shifted_pose(pose, (0.5, -0.25, 2.0, 1.0, -2.0, 3.0)).alias("p"))
    return rows.select("event_id", "p.*")


ANGLES_SQL = "a AS (SELECT event_id, radians(event_id % 300 - 150.0::DOUBLE) AS o, radians(event_id % 160 - 80.0::DOUBLE) AS f, radians(event_id % 340 - 170.0::DOUBLE) AS k FROM events)"


def _angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    angle = lambda m, shift: F.radians((e % m - shift).cast("double"))
    return R.table(spark, sf_dir, "events").select("event_id", angle(300, 150).alias("o"), angle(160, 80).alias("f"), angle(340, 170).alias("k"))


@query(
    f"""WITH {ANGLES_SQL} SELECT event_id, round(cos(f) * cos(k), 6) + 0 AS m11, round(-cos(f) * sin(k), 6) + 0 AS m12, round(sin(f), 6) + 0 AS m13,
  round(cos(o) * sin(k) + sin(o) * sin(f) * cos(k), 6) + 0 AS m21, round(-sin(o) * cos(f), 6) + 0 AS m23, round(cos(o) * cos(f), 6) + 0 AS m33 FROM a"""
)
def opk_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotations by omega, phi and kappa, cell by cell."""
    m = camera.opk_matrix(F.col("o"), F.col("f"), F.col("k"))
    return _angles(spark, sf_dir).select("event_id", *[(F.round(m[i], 6) + 0.0).alias(n) for i, n in ((0, "m11"), (1, "m12"), (2, "m13"), (3, "m21"), (5, "m23"), (8, "m33"))])


@query(f"WITH {ANGLES_SQL} SELECT event_id, round(o, 6) AS omega, round(f, 6) AS phi, round(k, 6) AS kappa FROM a")
def angles_of_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles to a matrix and back."""
    found = camera.opk_of_matrix([F.get("m", F.lit(i)) for i in range(9)])
    rows = _angles(spark, sf_dir).select("event_id", F.array(*camera.opk_matrix(F.col("o"), F.col("f"), F.col("k"))).alias("m"))
    return rows.select("event_id", *[(F.round(c, 6) + 0.0).alias(n) for c, n in zip(found, ("omega", "phi", "kappa"))])


@query(f"WITH {DIRECTIONS} SELECT event_id, x + 0 AS x, y + 0 AS y, z + 0 AS z FROM v")
def frame_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World to frame to a sensor's face and back again."""
    rows, v = _directions(spark, sf_dir)
    e = F.col("event_id")
    frame = F.struct(*[(e % m / d).cast("double").alias(n) for m, d, n in ((90, 1, "x"), (70, 1, "y"), (9, 1, "z"), (300, 50, "omega"), (150, 50, "phi"), (310, 50, "kappa"))])
    offset = camera.vector(F.lit(0.1), F.lit(-0.2), F.lit(0.05))
    face = (e % 6).cast("int")
    seen = rows.select("event_id", "v", frame.alias("f"), face.alias("face")).withColumn("m", camera.frame_to_model(camera.world_to_frame(F.col("v"), F.col("f")), offset, F.col("face")))
    back = seen.withColumn("b", camera.frame_to_world(camera.model_to_frame(F.col("m"), offset, F.col("face")), F.col("f")))
    return back.select("event_id", *[(F.round(F.col(f"b.{c}"), 6) + 0.0).alias(c) for c in "xyz"])


@query(f"WITH {DIRECTIONS} SELECT event_id, round(x / sqrt(x * x + y * y + z * z), 6) + 0 AS x, round(y / sqrt(x * x + y * y + z * z), 6) + 0 AS y, round(z / sqrt(x * x + y * y + z * z), 6) + 0 AS z FROM v WHERE z < 0")
def pixel_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions ahead of a camera to pixels of its image and back to directions of length 1."""
    rows, v = _directions(spark, sf_dir)
    step, size, focal = F.lit(0.001), F.lit(2048.0), F.lit(1.024)
    seen = rows.filter(v["z"] < 0).withColumn("p", camera.image_to_pixel(camera.model_to_image(v, focal), step, size, size))
    back = seen.withColumn("b", camera.image_to_model(camera.pixel_to_image(F.col("p.u"), F.col("p.v"), step, size, size), focal))
    return back.select("event_id", *[(F.round(F.col(f"b.{c}"), 6) + 0.0).alias(c) for c in "xyz"])


@query("SELECT p_partkey, (10 + p_partkey % 90)::DOUBLE AS x, (20 + p_partkey % 70)::DOUBLE AS y, (3 + p_size + p_partkey % 5)::DOUBLE AS a, (3 + p_size)::DOUBLE AS b, true AS close FROM part")
def fitted_ellipses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ellipses found again from points on them; ``a`` is the longer half axis."""
    k, s = F.col("p_partkey").cast("double"), F.col("p_size")
    x, y, b = 10.0 + F.col("p_partkey") % 90, 20.0 + F.col("p_partkey") % 70, (3.0 + s).cast("double")
    a = b + F.col("p_partkey") % 5
    at = F.sequence(F.lit(0), F.lit(59))
    ring = F.flatten(F.transform(at, lambda i: F.array((x + a * F.cos(i * (math.tau / 60)) * F.cos(k) - b * F.sin(i * (math.tau / 60)) * F.sin(k)).cast("double"), (y + a * F.cos(i * (math.tau / 60)) * F.sin(k) + b * F.sin(i * (math.tau / 60)) * F.cos(k)).cast("double"))))
    told = dealt_out(R.table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", geometry.ellipse_of(ring).alias("e"))
    return rounded(told.select("p_partkey", "e.x", "e.y", F.greatest("e.a", "e.b").alias("a"), F.least("e.a", "e.b").alias("b"), (F.col("e.iou") > 0.98).alias("close")), "x", "y", "a", "b", digits=4)


@query("SELECT p_partkey, round((p_partkey % 7 - 3) / 10.0, 6) AS a, round((p_partkey % 5 - 2) / 10.0, 6) AS b, (p_size + 0.0)::DOUBLE AS c, p_partkey % 3 <> 1 AS flat FROM part")
def fitted_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes found again from points on them, or, for every third, up to half a metre above and below."""
    k, s = F.col("p_partkey"), F.col("p_size")
    a, b = (k % 7 - 3) / 10, (k % 5 - 2) / 10
    lift = F.when(k % 3 == 1, 0.5).otherwise(0.0)
    corner = lambda x, y, up: F.array(F.lit(float(x)), F.lit(float(y)), (a * x + b * y + s + up * lift).cast("double"))
    ring = F.array(corner(-2, -2, 1), corner(2, -2, -1), corner(2, 2, 1), corner(-2, 2, -1), corner(0, 0, 0))

    told = dealt_out(R.table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", geometry.plane_of(ring).alias("p")).select("p_partkey", "p.*")
    return told.withColumns({c: F.round(c, 6) + 0.0 for c in ("a", "b", "c")})


@query(MATCHED + """ SELECT tag, image_id, coalesce(det_id, -1) AS det_id, coalesce(label_id, -1) AS label_id, CASE label_class WHEN 1 THEN 'cover' WHEN 2 THEN 'grate' WHEN 3 THEN 'drain' END AS category, CASE det_class WHEN 0 THEN 'cover' WHEN 1 THEN 'grate' WHEN 2 THEN 'drain' END AS det_category FROM tags""")
def category_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the classes of labels and detections, by lookup."""
    categories = spark.createDataFrame([(1, "cover"), (2, "grate"), (3, "drain")], "id int, name string")
    return evaluation.with_categories(tags(spark, sf_dir), categories).select("tag", "image_id", "det_id", "label_id", "category", "det_category").fillna(-1)


@query("SELECT p_partkey, 5.0 + p_size / 4.0 AS low_x, 5.0 + 3 * p_size / 4.0 AS high_x, 7.0 + p_size / 4.0 AS low_y, 7.0 + 3 * p_size / 4.0 AS high_y FROM part")
def scaled_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares halved about the middle of their vertices."""
    s, zero = F.col("p_size").cast("double"), F.lit(0.0)
    corners = ((zero, zero), (s, zero), (s, s), (zero, s))
    ring = geometry.scaled(F.array(*[v for x, y in corners for v in (x + 5, y + 7)]), 0.5)
    box = R.table(spark, sf_dir, "part").select("p_partkey", geometry.ring_box(ring).alias("b"))
    return box.select("p_partkey", F.col("b.x").alias("low_x"), (F.col("b.x") + F.col("b.w")).alias("high_x"), F.col("b.y").alias("low_y"), (F.col("b.y") + F.col("b.h")).alias("high_y"))


@query(
    """WITH v AS (SELECT s_suppkey AS k, unnest(range(1, 9)) AS i FROM supplier), n AS (SELECT k, i, CASE WHEN (k + i * i) % 3 = 0 THEN 0.0::DOUBLE ELSE (k % 11 + i)::DOUBLE END AS z FROM v),
f AS (SELECT a.k, a.i, a.z, (SELECT arg_min(b.z, (abs(b.i - a.i), b.i)) FROM n b WHERE b.k = a.k AND b.z <> 0) AS near FROM n a)
SELECT k AS s_suppkey, i, CASE WHEN z = 0 THEN coalesce(near, z) ELSE z END AS z FROM f"""
)
def nearest_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of 0 take that of the nearest vertex that has one."""
    k = F.col("s_suppkey")
    values = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.when((k + i * i) % 3 == 0, 0.0).otherwise((k % 11 + i).cast("double")))
    told = R.table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(geometry.nearest_nonzero(values)).alias("i", "z"))
    return told.select("s_suppkey", (F.col("i") + 1).cast("long").alias("i"), "z")


@query(
    """WITH v AS (SELECT o_orderkey % 400 AS grp, l_quantity AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey), m AS (SELECT grp, avg(q) AS mean, stddev_pop(q) AS spread FROM v GROUP BY 1),
k AS (SELECT grp, count(*) AS n_all, count(*) FILTER (WHERE abs(q - mean) <= 1.5 * spread) AS n FROM v JOIN m USING (grp) GROUP BY 1) SELECT grp, CASE WHEN n >= 3 THEN n ELSE n_all END AS n FROM k"""
)
def values_without_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.table(spark, sf_dir, "lineitem").join(R.table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    held = rows.groupBy((F.col("o_orderkey") % 400).alias("grp")).agg(F.collect_list(F.col("l_quantity").cast("double")).alias("v"))
    return held.select("grp", F.size(geometry.without_outliers(F.col("v"), 1.5)).cast("long").alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 20 AND l_discount * 300 <= 15 AND l_tax * 4 <= 0.2")
def good_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("intersections"), (F.col("l_discount") * 300).alias("mean_intersection_length"), (F.col("l_tax") * 4).alias("mean_intersection_dist"))
    return control.good_candidates(rows, least_intersections=20).select("l_orderkey", "l_linenumber")


@query(f"WITH {ANGLES_SQL} SELECT event_id, round(10 + 2 * sin(f), 6) + 0 AS x, round(20 - 2 * sin(o) * cos(f), 6) + 0 AS y, round(30 + 2 * cos(o) * cos(f), 6) + 0 AS z FROM a")
def sensor_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a sensor two metres along a frame's third axis stands."""
    frame = F.struct(F.lit(10.0).alias("x"), F.lit(20.0).alias("y"), F.lit(30.0).alias("z"), F.col("o").alias("omega"), F.col("f").alias("phi"), F.col("k").alias("kappa"))
    at = camera.sensor_origin(frame, camera.vector(F.lit(0.0), F.lit(0.0), F.lit(2.0)))
    return _angles(spark, sf_dir).select("event_id", at.alias("p")).select("event_id", *[(F.round(F.col(f"p.{c}"), 6) + 0.0).alias(c) for c in "xyz"])


@query("SELECT event_id, (100 + event_id % 7800)::DOUBLE AS u, (500 + event_id % 3000)::DOUBLE AS v, true AS is_unit FROM events")
def spherical_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels to rays, and a point on the ray back to its pixel."""
    e = F.col("event_id")
    pose = F.struct(*[x.cast("double").alias(n) for x, n in ((e % 100, "x"), (e % 50, "y"), (e % 7, "z"), (e % 360, "yaw"), (e % 20 - 10, "pitch"), (e % 14 - 7, "roll"))])
    w, h = F.lit(8000.0), F.lit(4000.0)
    rows = dealt_out(R.table(spark, sf_dir, "events").select("event_id")).select("event_id", pose.alias("pose"), (100.0 + e % 7800).alias("u0"), (500.0 + e % 3000).alias("v0"))
    rays = rows.withColumn("r", camera.spherical_ray(F.col("u0"), F.col("v0"), F.col("pose"), w, h))
    there = camera.vector(*[F.col(f"r.origin.{c}") + 7 * F.col(f"r.direction.{c}") for c in "xyz"])
    seen = rays.withColumn("p", there).withColumn("px", camera.spherical_projection(camera.to_camera(F.col("p"), F.col("pose")), w, h))
    is_unit = F.abs(camera.norm(F.col("r.direction")) - 1) < 1e-9
    return seen.select("event_id", F.round("px.u", 5).alias("u"), F.round("px.v", 5).alias("v"), is_unit.alias("is_unit"))


@query("SELECT event_id, (10 + event_id % 2000)::DOUBLE AS u, (20 + event_id % 1900)::DOUBLE AS v FROM events")
def cube_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of a cube's faces to rays, and a point on the ray back to its pixel."""
    e = F.col("event_id")
    frame = F.struct(*[x.cast("double").alias(n) for x, n in ((e % 90, "x"), (e % 70, "y"), (e % 9, "z"), (e % 300 / 50, "omega"), (e % 150 / 50, "phi"), (e % 310 / 50, "kappa"))])
    offset, step, size = camera.vector(F.lit(0.1), F.lit(-0.2), F.lit(0.05)), F.lit(0.001), F.lit(2048.0)
    rows = dealt_out(R.table(spark, sf_dir, "events").select("event_id")).select("event_id", frame.alias("f"), (e % 6).cast("int").alias("face"), (10.0 + e % 2000).alias("u0"), (20.0 + e % 1900).alias("v0"))
    rays = rows.withColumn("r", camera.cube_ray(F.col("u0"), F.col("v0"), F.col("f"), F.col("face"), offset, step, size))
    there = rays.withColumn("p", camera.vector(*[F.col(f"r.origin.{c}") + 5 * F.col(f"r.direction.{c}") for c in "xyz"]))
    model = there.withColumn("m", camera.frame_to_model(camera.world_to_frame(F.col("p"), F.col("f")), offset, F.col("face")))
    px = model.withColumn("px", camera.image_to_pixel(camera.model_to_image(F.col("m"), F.lit(1.024)), step, size, size))
    return px.select("event_id", F.round("px.u", 5).alias("u"), F.round("px.v", 5).alias("v"))


#: Areas in the shape of an L, and others near most of them; a seventh of those lies elsewhere.
ELLS_SQL = """ells AS (SELECT p_partkey AS label_id, (p_partkey * 37) % 480 AS x, (p_partkey * 53) % 480 AS y, 8 + p_size % 6 AS w, 8 + p_size % 5 AS h FROM part),
moved AS (SELECT label_id AS det_id, x + label_id % 5 - 2 + CASE WHEN label_id % 7 = 3 THEN 600 ELSE 0 END AS x, y + label_id % 3 - 1 AS y, w, h FROM ells),
squares AS (SELECT 'l' AS side, * FROM ells UNION ALL SELECT 'd', * FROM moved),
columns AS (SELECT *, unnest(range(w)) AS cx FROM squares),
cells AS (SELECT side, label_id AS id, x + cx AS cell_x, y + cy AS cell_y FROM (SELECT *, unnest(range(h)) AS cy FROM columns) WHERE cy < h // 2 OR cx < w // 2),
sizes AS (SELECT side, id, count(*) AS n FROM cells GROUP BY ALL),
shared AS (SELECT d.id AS det_id, l.id AS label_id, count(*) AS n FROM cells d JOIN cells l ON d.cell_x = l.cell_x AND d.cell_y = l.cell_y WHERE d.side = 'd' AND l.side = 'l' GROUP BY ALL)"""


def _ells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    x, y, w, h = (k * 37) % 480, (k * 53) % 480, 8 + F.col("p_size") % 6, 8 + F.col("p_size") % 5

    def ell(x, y):
        return F.array(*[v.cast("double") for v in (x, y, x + w, y, x + w, y + F.floor(h / 2), x + F.floor(w / 2), y + F.floor(h / 2), x + F.floor(w / 2), y + h, x, y + h)])

    part = R.table(spark, sf_dir, "part")
    near = ell(x + k % 5 - 2 + F.when(k % 7 == 3, 600).otherwise(0), y + k % 3 - 1)
    return part.select(k.alias("det_id"), near.alias("ring")), part.select(k.alias("label_id"), ell(x, y).alias("ring"))


@query(f"WITH {ELLS_SQL} SELECT det_id, label_id FROM shared")
def areas_that_meet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of concave areas that share some area."""
    dets, labels = _ells(spark, sf_dir)
    return spatial.ring_pairs(dets.withColumnRenamed("ring", "left_ring"), labels.withColumnRenamed("ring", "right_ring"), "det_id", "label_id", cell=8.0)


@query(
    f"""WITH {ELLS_SQL}, ious AS (SELECT s.det_id, s.label_id, round(s.n::DOUBLE / (d.n + l.n - s.n), 9) AS iou FROM shared s JOIN sizes d ON d.side = 'd' AND d.id = s.det_id JOIN sizes l ON l.side = 'l' AND l.id = s.label_id),
best AS (SELECT * FROM ious QUALIFY row_number() OVER (PARTITION BY det_id ORDER BY iou DESC, label_id) = 1),
hits AS (SELECT * FROM best WHERE iou >= 0.25 QUALIFY row_number() OVER (PARTITION BY label_id ORDER BY iou DESC, det_id) = 1)
SELECT CASE WHEN h.det_id IS NULL THEN 'FP' ELSE 'TP' END AS tag, m.det_id, coalesce(h.label_id, -1) AS label_id, round(h.iou, 3) AS iou FROM moved m LEFT JOIN hits h ON h.det_id = m.det_id
UNION ALL SELECT 'FN', -1, e.label_id, NULL FROM ells e LEFT JOIN hits h ON h.label_id = e.label_id WHERE h.label_id IS NULL"""
)
def area_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concave areas held against an inventory of such areas."""
    return control.tagged_areas(*_ells(spark, sf_dir), cell=8.0).select("tag", "det_id", "label_id", "iou").fillna(-1, ["det_id", "label_id"])


@query("SELECT p_partkey, round(w * h + 4 * (w + h) + 128 * sin(pi() / 32), 4) AS grown, (CASE WHEN w > 2 AND h > 2 THEN (w - 2.0) * (h - 2.0) ELSE 0.0 END)::DOUBLE AS shrunk FROM (SELECT p_partkey, 1 + p_size % 7 AS w, 1 + p_size % 5 AS h FROM part)")
def grown_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles grown by 2, with corners of 16 parts, and shrunk by 1."""
    w, h, zero = (F.col("p_size") % 7 + 1).cast("double"), (F.col("p_size") % 5 + 1).cast("double"), F.lit(0.0)
    rows = R.table(spark, sf_dir, "part").select("p_partkey", F.array(F.array(zero, zero, w, zero, w, h, zero, h)).alias("s"))
    size = lambda d: F.aggregate(F.transform(outlines.grown(d)("s"), geometry.signed_area), F.lit(0.0), lambda a, x: a + x)
    told = spatial.once_each(rows, "s", lambda unlike: unlike.select("s", size(2.0).alias("grown"), size(-1.0).alias("shrunk")))
    return told.select("p_partkey", F.round("grown", 4).alias("grown"), (F.round("shrunk", 4) + 0.0).alias("shrunk"))


@query(
    """WITH p AS (SELECT o_orderkey % 1000 AS grp, o_orderkey * 0.7 AS t FROM orders), g AS (SELECT grp, count(*) AS n FROM p GROUP BY 1 HAVING count(*) >= 8)
SELECT grp, n, (2600000 + grp % 97)::DOUBLE AS x, (1200000 + grp % 89)::DOUBLE AS y, (4 + grp % 3)::DOUBLE AS longest, 2.0::DOUBLE AS shortest FROM g"""
)
def fitted_conics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ellipses through points on ellipses."""
    g, t = F.col("o_orderkey") % 1000, F.col("o_orderkey") * 0.7
    points = R.table(spark, sf_dir, "orders").select(g.alias("grp"), (2600000 + g % 97 + (4 + g % 3) * F.cos(t)).alias("x"), (1200000 + g % 89 + 2 * F.sin(t)).alias("y"))
    told = conics.ellipses(points, ["grp"]).filter("n >= 8").select("grp", "n", "ellipse.*")
    return told.select("grp", "n", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), F.round(F.greatest("a", "b"), 2).alias("longest"), F.round(F.least("a", "b"), 2).alias("shortest"))


ZYX_SQL = "z AS (SELECT event_id, event_id % 628 / 100.0::DOUBLE - 3.135 AS rz, event_id % 301 / 50.0::DOUBLE - 3 AS ry, event_id % 113 / 20.0::DOUBLE - 2.81 AS rx FROM events)"


@query(
    f"""WITH {ZYX_SQL}, m AS (SELECT event_id, cos(rz) * cos(ry) AS m11, sin(rz) * cos(ry) AS m21, -sin(ry) AS m31, cos(ry) * sin(rx) AS m32, cos(ry) * cos(rx) AS m33 FROM z)
SELECT event_id, round(atan2(m32, m33), 6) + 0 AS omega, round(asin(-m31), 6) + 0 AS phi, round(atan2(m21, m11), 6) + 0 AS kappa FROM m"""
)
def zyx_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles about z, y and x, some beyond a right angle, as omega, phi and kappa."""
    e = F.col("event_id")
    m = camera.zyx_matrix(e % 628 / 100 - 3.135, e % 301 / 50 - 3, e % 113 / 20 - 2.81)
    rows = R.table(spark, sf_dir, "events").select("event_id", F.array(*m).alias("m"))
    found = camera.opk_of_zyx([F.get("m", F.lit(i)) for i in range(9)])
    return rows.select("event_id", *[(F.round(c, 6) + 0.0).alias(n) for c, n in zip(found, ("omega", "phi", "kappa"))])


@query(
    f"""WITH RECURSIVE {R.CUSTOMERS_SQL}, {R.SUPPLIERS_SQL}, good AS (SELECT id AS place_id, x, y FROM points WHERE id % 7 >= 2 AND id % 17 <= 15 AND id % 13 / 50.0 <= 0.2),
seen AS (SELECT sid AS truth_id, sx AS x, sy AS y FROM (SELECT sid, sx, sy, count(*) AS n FROM sites JOIN points ON abs(sx - x) <= 300 AND abs(sy - y) <= 300 AND sqrt(pow(sx - x, 2) + pow(sy - y, 2)) <= 300 GROUP BY ALL) WHERE n >= 3),
near AS (SELECT truth_id, place_id, sqrt(pow(t.x - g.x, 2) + pow(t.y - g.y, 2)) AS d FROM seen t JOIN good g ON abs(t.x - g.x) <= 400 AND abs(t.y - g.y) <= 400),
ranked AS MATERIALIZED (SELECT truth_id, place_id, d, row_number() OVER (ORDER BY d, truth_id, place_id) AS n FROM near WHERE d < 400),
taken(n, lefts, rights) AS (SELECT n, [truth_id], [place_id] FROM ranked WHERE n = 1 UNION ALL
  SELECT r.n, list_append(lefts, r.truth_id), list_append(rights, r.place_id)
  FROM (SELECT lefts, rights, min(r.n) AS m FROM taken t JOIN ranked r ON r.n > t.n AND NOT list_contains(lefts, r.truth_id) AND NOT list_contains(rights, r.place_id) GROUP BY ALL) f JOIN ranked r ON r.n = f.m),
won AS (SELECT d FROM taken JOIN ranked USING (n)), c AS (SELECT (SELECT count(*) FROM won) AS tp, (SELECT count(*) FROM seen) AS n_truth, (SELECT count(*) FROM good) AS n_found)
SELECT tp, n_found - tp AS fp, n_truth - tp AS fn, coalesce(round(tp / nullif(n_found, 0), 6), 0) AS precision, coalesce(round(tp / nullif(n_truth, 0), 6), 0) AS recall, coalesce(round(2 * tp / nullif(n_found + n_truth, 0), 6), 0) AS f1, round((SELECT avg(d) FROM won), 6) AS mean_distance, round((SELECT median(d) FROM won), 6) AS median_distance FROM c"""
)
def located_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of good quality against a truth that was passed by often enough, matched one to one."""
    k, points = F.col("id"), R.customers(spark, sf_dir)
    found = points.select(k.alias("place_id"), "x", "y", (k % 7).alias("intersections"), (k % 17).alias("mean_intersection_length"), (k % 13 / 50).alias("mean_intersection_dist"))
    truth = R.suppliers(spark, sf_dir).select(F.col("sid").alias("truth_id"), F.col("sx").alias("x"), F.col("sy").alias("y"))
    report, _ = control.located(found, truth, points.select(F.col("x").alias("cam_x"), F.col("y").alias("cam_y")), reach=400.0, seen_from=300.0)
    return rounded(report, "precision", "recall", "f1", "mean_distance", "median_distance").select("tp", "fp", "fn", "precision", "recall", "f1", "mean_distance", "median_distance")


#: A frame for each direction, and the cells of its rotation.
FRAMES_SQL = f"""{DIRECTIONS}, f AS (SELECT event_id, x, y, z, (event_id % 90)::DOUBLE AS fx, (event_id % 70)::DOUBLE AS fy, (event_id % 9)::DOUBLE AS fz, event_id % 300 / 50.0::DOUBLE AS o, event_id % 150 / 50.0::DOUBLE AS p, event_id % 310 / 50.0::DOUBLE AS k FROM v),
m AS (SELECT *, x - fx AS dx, y - fy AS dy, z - fz AS dz, cos(p) * cos(k) AS m11, -cos(p) * sin(k) AS m12, sin(p) AS m13, cos(o) * sin(k) + sin(o) * sin(p) * cos(k) AS m21, cos(o) * cos(k) - sin(o) * sin(p) * sin(k) AS m22, -sin(o) * cos(p) AS m23,
  sin(o) * sin(k) - cos(o) * sin(p) * cos(k) AS m31, sin(o) * cos(k) + cos(o) * sin(p) * sin(k) AS m32, cos(o) * cos(p) AS m33 FROM f)"""


def _framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, v = _directions(spark, sf_dir)
    e = F.col("event_id")
    frame = F.struct(*[(e % n / d).cast("double").alias(c) for n, d, c in ((90, 1, "x"), (70, 1, "y"), (9, 1, "z"), (300, 50, "omega"), (150, 50, "phi"), (310, 50, "kappa"))])
    return rows.select("event_id", v.alias("v"), frame.alias("f"))


@query(f"WITH {FRAMES_SQL} SELECT event_id, round(m11 * dx + m21 * dy + m31 * dz, 6) + 0 AS x, round(m12 * dx + m22 * dy + m32 * dz, 6) + 0 AS y, round(m13 * dx + m23 * dy + m33 * dz, 6) + 0 AS z FROM m")
def frame_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World points in the axes of frames."""
    told = _framed(spark, sf_dir).select("event_id", camera.world_to_frame(F.col("v"), F.col("f")).alias("p"))
    return told.select("event_id", *[(F.round(F.col(f"p.{c}"), 6) + 0.0).alias(c) for c in "xyz"])


@query(f"WITH {FRAMES_SQL} SELECT event_id, round(fx + m11 * x + m12 * y + m13 * z, 6) + 0 AS x, round(fy + m21 * x + m22 * y + m23 * z, 6) + 0 AS y, round(fz + m31 * x + m32 * y + m33 * z, 6) + 0 AS z FROM m")
def world_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in the axes of frames as world points."""
    told = _framed(spark, sf_dir).select("event_id", camera.frame_to_world(F.col("v"), F.col("f")).alias("p"))
    return told.select("event_id", *[(F.round(F.col(f"p.{c}"), 6) + 0.0).alias(c) for c in "xyz"])


@query(f"WITH {DIRECTIONS} SELECT event_id, round(-1.024 * x / z, 6) + 0 AS x, round(-1.024 * y / z, 6) + 0 AS y, round(1024 - 1024 * x / z, 6) AS u, round(1024 + 1024 * y / z, 6) AS v FROM v")
def image_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions in a camera's axes as places on its image plane and as pixels."""
    rows, v = _directions(spark, sf_dir)
    seen = rows.select("event_id", camera.model_to_image(v, F.lit(1.024)).alias("i"))
    pixel = camera.image_to_pixel(F.col("i"), F.lit(0.001), F.lit(2048.0), F.lit(2048.0))
    told = seen.withColumn("p", pixel).select("event_id", "i.x", "i.y", "p.u", "p.v")
    return told.select("event_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("x", "y", "u", "v")])


@query(
    f"""WITH {DIRECTIONS}, t AS (SELECT event_id, x - event_id % 100 AS dx, y - event_id % 50 AS dy, z - event_id % 7 AS dz, radians(-(event_id % 360)::DOUBLE) AS a, radians(event_id % 20 - 10.0::DOUBLE) AS b, radians(event_id % 14 - 7.0::DOUBLE) AS c FROM v),
s AS (SELECT event_id, (cos(a) * cos(c) - sin(a) * sin(b) * sin(c)) * dx + (sin(a) * cos(c) + cos(a) * sin(b) * sin(c)) * dy - cos(b) * sin(c) * dz AS x,
  -(cos(a) * sin(c) + sin(a) * sin(b) * cos(c)) * dx - (sin(a) * sin(c) - cos(a) * sin(b) * cos(c)) * dy - cos(b) * cos(c) * dz AS y, -sin(a) * cos(b) * dx + cos(a) * cos(b) * dy + sin(b) * dz AS z FROM t)
SELECT event_id, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y, round(z, 6) + 0 AS z, round(4000 + 4000 / pi() * atan2(x, z), 4) % 8000 + 0 AS u, round(2000 + 4000 / pi() * atan2(y, sqrt(x * x + z * z)), 4) AS v FROM s"""
)
def panorama_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World points in the axes of turned cameras, and as pixels of their panoramas; the right edge is the left one, as rounding decides on which a point behind the camera falls."""
    rows, v = _directions(spark, sf_dir)
    e = F.col("event_id").cast("double")
    pose = F.struct(*[x.alias(n) for x, n in ((e % 100, "x"), (e % 50, "y"), (e % 7, "z"), (e % 360, "yaw"), (e % 20 - 10, "pitch"), (e % 14 - 7, "roll"))])
    seen = rows.select("event_id", camera.to_camera(v, pose).alias("c")).withColumn("p", camera.spherical_projection(F.col("c"), F.lit(8000.0), F.lit(4000.0)))
    return seen.select("event_id", *[(F.round(F.col(f"c.{c}"), 6) + 0.0).alias(c) for c in "xyz"], (F.round("p.u", 4) % 8000 + 0.0).alias("u"), F.round("p.v", 4).alias("v"))
