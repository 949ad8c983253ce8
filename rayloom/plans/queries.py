"""The registered queries of the library's own operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rayloom.functions import camera, geometry, names, poses
from rayloom.lineage import dealt_out
from rayloom.operators import control, evaluation, graph, matching, panorama, spatial, tiling, triangulation
from rayloom.plans import relations as R
from rayloom.sources import coco
from rayloom.streaming import peeling

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


MATCHED = f"WITH {R.LABELS_SQL}, {R.DETECTIONS_SQL}, {R.BEST_SQL}, {R.HITS_SQL}, {R.TAGS_SQL}"
BY_CLASS = """by_class AS (SELECT c.class, count(*) FILTER (WHERE tag = 'TP' AND known = c.class) AS tp, count(*) FILTER (WHERE tag = 'FP' AND known = c.class) AS fp,
  count(*) FILTER (WHERE tag = 'FN' AND known = c.class) AS fn FROM (SELECT *, CASE WHEN tag = 'FN' THEN label_class - 1 ELSE det_class END AS known FROM tags)
  CROSS JOIN (SELECT unnest([0, 1, 2])::INT AS class) c GROUP BY c.class),
scored AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall FROM by_class)"""


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.tagged(R.detections(spark, sf_dir), R.labels(spark, sf_dir))


# Matching and evaluation


@query(MATCHED + " SELECT tag, coalesce(label_id, -1) AS label_id, coalesce(label_class, -1) AS label_class, coalesce(det_id, -1) AS det_id, score, coalesce(det_class, -1) AS det_class, iou, image_id FROM tags")
def tagged_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags(spark, sf_dir).fillna(-1, ["label_id", "label_class", "det_id", "det_class"])


@query(f"WITH {R.LABELS_SQL}, {R.DETECTIONS_SQL}, {R.BEST_SQL} SELECT det_id, label_id, image_id, round(iou, 6) AS iou FROM best")
def best_label_per_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matching.best_labels(R.detections(spark, sf_dir), R.labels(spark, sf_dir)), "iou")


@query(MATCHED + f", {BY_CLASS} SELECT class, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall FROM scored")
def metrics_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.by_class(tags(spark, sf_dir), [0, 1, 2]), "precision", "recall")


SUMMED = "sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn"
F1 = "SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM s"


@query(MATCHED + f", {BY_CLASS}, s AS (SELECT {SUMMED}, avg(precision) AS p, avg(recall) AS r FROM scored) {F1}")
def metrics_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.summary(evaluation.by_class(tags(spark, sf_dir), [0, 1, 2])), "precision", "recall", "f1")


@query(MATCHED + f", {BY_CLASS}, s AS (SELECT {SUMMED}, sum((tp + fn) * precision) / sum(tp + fn) / count(*) AS p, sum((tp + fn) * recall) / sum(tp + fn) / count(*) AS r FROM scored) {F1}")
def metrics_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.summary(evaluation.by_class(tags(spark, sf_dir), [0, 1, 2]), "macro-weighted-average"), "precision", "recall", "f1")


@query(MATCHED + f", {BY_CLASS}, s AS (SELECT {SUMMED}, sum(tp)::DOUBLE / sum(tp + fp) AS p, sum(tp)::DOUBLE / sum(tp + fn) AS r FROM scored) {F1}")
def metrics_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.summary(evaluation.by_class(tags(spark, sf_dir), [0, 1, 2]), "micro-average"), "precision", "recall", "f1")


THRESHOLDS = [k / 20 for k in range(20)]
SWEPT = f"""WITH {R.LABELS_SQL}, {R.DETECTIONS_SQL}, {R.BEST_SQL}, grid AS (SELECT unnest(range(20)) / 20.0::DOUBLE AS threshold),
counted AS (SELECT g.threshold, (SELECT count(DISTINCT label_id) FROM best WHERE iou >= 0.25 AND score >= g.threshold) AS tp,
  (SELECT count(*) FROM dets WHERE score >= g.threshold) AS n_dets, (SELECT count(*) FROM labels) AS n_labels FROM grid g),
s AS (SELECT threshold, tp, n_dets - tp AS fp, n_labels - tp AS fn, coalesce(tp::DOUBLE / nullif(n_dets, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(n_labels, 0), 0) AS r FROM counted),
swept AS (SELECT threshold, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM s)"""


@query(SWEPT + " SELECT * FROM swept")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.sweep(R.detections(spark, sf_dir), R.labels(spark, sf_dir), THRESHOLDS), "precision", "recall", "f1")


@query(SWEPT + " SELECT * FROM swept ORDER BY f1 DESC, threshold LIMIT 1")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.best_threshold(threshold_sweep(spark, sf_dir))


@query(
    MATCHED
    + """, named AS (SELECT coalesce('class ' || label_class, 'background') AS true_class, coalesce('class ' || (det_class + 1), 'background') AS found FROM tags)
SELECT true_class, count(*) FILTER (WHERE found = 'class 1') AS "class 1", count(*) FILTER (WHERE found = 'class 2') AS "class 2", count(*) FILTER (WHERE found = 'class 3') AS "class 3",
  count(*) FILTER (WHERE found = 'background') AS missed_labels FROM named GROUP BY true_class"""
)
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda c, add: F.concat(F.lit("class "), (F.col(c) + add).cast("string"))
    told = tags(spark, sf_dir).withColumn("true_name", named("label_class", 0)).withColumn("found_name", named("det_class", 1))
    return evaluation.confusion(told, "true_name", "found_name", ["class 1", "class 2", "class 3"])


@query(
    """SELECT c AS "column", count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS median,
  round(quantile_cont(v, 0.75), 6) AS q75, max(v) AS max FROM (SELECT 'p_size' AS c, p_size::DOUBLE AS v FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part) GROUP BY c"""
)
def described_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.described(R.table(spark, sf_dir, "part"), ["p_size", "p_retailprice"]), "mean", "std", "q25", "median", "q75")


@query(
    """WITH p AS (SELECT l_suppkey AS run, l_discount AS precision, l_tax AS recall, l_quantity / 50 AS map50 FROM lineitem)
SELECT run, max(precision) AS best_precision, round(max(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)), 9) AS best_f1, max(map50) AS best_map50 FROM p GROUP BY run"""
)
def best_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    progress = R.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run"), F.col("l_discount").alias("precision"), F.col("l_tax").alias("recall"), (F.col("l_quantity") / 50).alias("map50"))
    return rounded(evaluation.best_trials(progress), "best_f1", digits=9)


# Tiles, clipping, splits


TILES = f"""tiles AS (SELECT i.image_id, i.file_name, i.height, x.tile_x, y.tile_y, 'images/pano_' || i.image_id || '_' || x.tile_x || '_' || y.tile_y || '.jpg' AS tile_name FROM images i,
  LATERAL (SELECT unnest(range(0, i.width - i.overlap_x, 512 - i.overlap_x)) AS tile_x) x, LATERAL (SELECT unnest(range(i.padding_y, i.height - i.padding_y - i.overlap_y, 512 - i.overlap_y)) AS tile_y) y)"""


@query(f"WITH {R.IMAGES_SQL}, {TILES} SELECT image_id, tile_x, tile_y, tile_name FROM tiles")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.tiles(R.images(spark, sf_dir)).select("image_id", "tile_x", "tile_y", "tile_name")


CLIPPED = f"""WITH {R.IMAGES_SQL}, {TILES}, {R.ANNOTATIONS_SQL},
inside AS (SELECT a.* FROM anns a JOIN images i USING (image_id) WHERE NOT (x + w <= 0 OR x >= i.width OR y + h <= 0 OR y >= i.height) AND y <= i.height - i.padding_y),
met AS (SELECT a.ann_id, a.image_id, t.tile_x, t.tile_y, a.x - t.tile_x AS x, a.y - t.tile_y AS y, a.w, a.h FROM inside a JOIN tiles t USING (image_id)
  WHERE a.x < t.tile_x + 512 AND a.x + a.w > t.tile_x AND a.y < t.tile_y + 512 AND a.y + a.h > t.tile_y),
cut AS (SELECT ann_id, image_id, tile_x, tile_y, greatest(x, 0) AS x, greatest(y, 0) AS y, CASE WHEN x < 0 THEN least(w + x, 512) WHEN x + w > 512 THEN 512 - x ELSE w END AS w,
  CASE WHEN y < 0 THEN least(h + y, 512) WHEN y + h > 512 THEN 512 - y ELSE h END AS h FROM met),
boxed AS (SELECT * FROM cut WHERE NOT ((x <= 10.24 OR x >= 501.76) AND (x + w <= 10.24 OR x + w >= 501.76)) AND NOT ((y <= 10.24 OR y >= 501.76) AND (y + h <= 10.24 OR y + h >= 501.76))),
first AS (SELECT *, x + w AS u, y + h AS v, NOT (y IN (0, 512)) AND NOT (x + w = x AND x IN (0, 512)) AS k1 FROM boxed),
second AS (SELECT *, CASE WHEN k1 THEN u ELSE x END AS lx, y AS ly FROM first), third AS (SELECT *, NOT ((u IN (0, 512) AND u = lx) OR (v IN (0, 512) AND v = ly)) AS k2 FROM second),
fourth AS (SELECT *, CASE WHEN k2 THEN u ELSE lx END AS mx, CASE WHEN k2 THEN v ELSE ly END AS my FROM third), fifth AS (SELECT *, NOT ((x IN (0, 512) AND x = mx) OR (v IN (0, 512) AND v = my)) AS k3 FROM fourth),
kept AS (SELECT * FROM fifth WHERE NOT ((NOT k1 OR u <= 10.24 OR u >= 501.76) AND (NOT k2 OR u <= 10.24 OR u >= 501.76) AND (NOT k3 OR x <= 10.24 OR x >= 501.76))
  AND NOT ((NOT k1 OR y <= 10.24 OR y >= 501.76) AND (NOT k2 OR v <= 10.24 OR v >= 501.76) AND (NOT k3 OR v <= 10.24 OR v >= 501.76)))"""


@query(CLIPPED + " SELECT ann_id, image_id, tile_x, tile_y, x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS w, h::DOUBLE AS h FROM kept")
def clipped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tiling.clipped(R.annotations(spark, sf_dir), R.images(spark, sf_dir))
    return found.select("ann_id", "image_id", "tile_x", "tile_y", "box.x", "box.y", "box.w", "box.h")


@query(
    f"""WITH {R.IMAGES_SQL}, {R.ANNOTATIONS_SQL} SELECT count(*) AS n, least(0, min(x))::DOUBLE AS min_x, greatest(0, max(x + w))::DOUBLE AS max_x, least(0, min(y))::DOUBLE AS min_y,
  greatest(0, max(y + h))::DOUBLE AS max_y FROM anns JOIN images i USING (image_id) WHERE x + w <= 0 OR x >= i.width OR y + h <= 0 OR y >= i.height"""
)
def excluded_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.excluded(R.annotations(spark, sf_dir), R.images(spark, sf_dir))


@query(
    """WITH g AS (SELECT n_regionkey AS aoi, count(*) AS n FROM (SELECT c_custkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey) GROUP BY 1),
s AS (SELECT aoi, n, round_even(n * 0.7::DOUBLE, 0)::BIGINT AS trn FROM g), v AS (SELECT *, round_even((n - trn) * 0.5::DOUBLE, 0)::BIGINT AS val FROM s)
SELECT aoi, dataset, n FROM (SELECT aoi, 'trn' AS dataset, trn AS n FROM v UNION ALL SELECT aoi, 'val', val FROM v UNION ALL SELECT aoi, 'tst', n - trn - val FROM v) WHERE n > 0"""
)
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = R.table(spark, sf_dir, "customer").join(R.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("aoi"), F.col("c_custkey").alias("image_id"))
    return tiling.split(who, who).groupBy("aoi", "dataset").agg(F.count("*").alias("n"))


@query(
    CLIPPED
    + """, have AS (SELECT DISTINCT image_id, tile_x, tile_y FROM kept), n_have AS (SELECT image_id, count(*) AS n FROM have GROUP BY 1), n_all AS (SELECT image_id, count(*) AS n FROM tiles GROUP BY 1)
SELECT a.image_id, least(a.n - coalesce(h.n, 0), CASE WHEN h.n IS NULL THEN 1 ELSE ceil(h.n * 0.33 / (1 - 0.33))::BIGINT END) AS n FROM n_all a LEFT JOIN n_have h USING (image_id) WHERE a.n > coalesce(h.n, 0)"""
)
def empty_tile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = R.images(spark, sf_dir)
    have = tiling.clipped(R.annotations(spark, sf_dir), shapes).select("image_id", "tile_x", "tile_y")
    return tiling.empty_tiles(tiling.tiles(shapes), have, 0.33).groupBy("image_id").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority AS grp, least(count(*), 50) AS n FROM orders GROUP BY 1")
def quota_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = R.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("grp"))
    return tiling.quota(orders, ["grp"], 50, "o_orderkey").groupBy("grp").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS nth FROM orders")
def consecutive_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.numbered(R.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], "nth").select("o_orderkey", F.col("nth").cast("long").alias("nth"))


@query(
    """WITH g AS (SELECT p_brand, max(p_partkey) + 1 AS room FROM part GROUP BY 1), s AS (SELECT p_brand, coalesce(sum(room) OVER (ORDER BY p_brand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM g)
SELECT p_brand, (p_partkey + shift)::BIGINT AS p_partkey FROM part JOIN s USING (p_brand)"""
)
def shifted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.offset_ids(R.table(spark, sf_dir, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE (n - 1) % 4 = 0")
def every_fourth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.every_nth(R.table(spark, sf_dir, "events"), ["ts", "event_id"], 4, ["user_id"]).select("user_id", "event_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey % 10 AS k, min(l_suppkey) AS id FROM lineitem GROUP BY ALL")
def repeats_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 10).alias("k"), F.col("l_suppkey").alias("id"))
    return tiling.without_repeats(rows, "id")


# Names


@query(
    r"""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.\w+$', '') AS stem,
  CASE WHEN url LIKE '%.jpg' THEN url ELSE url || '.jpg' END AS suffixed FROM pages"""
)
def url_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return R.table(spark, sf_dir, "pages").select("page_id", names.basename(url).alias("base"), names.without_extension(names.basename(url)).alias("stem"), names.with_suffix(url).alias("suffixed"))


@query("SELECT p_partkey, 'a/p_' || p_partkey AS stem, p_partkey * 3 AS x, p_size::BIGINT AS y FROM part")
def tile_names_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.table(spark, sf_dir, "part").select("p_partkey", names.tile_name(F.concat(F.lit("x/p_"), F.col("p_partkey").cast("string"), F.lit(".jpg")), F.col("p_partkey") * 3, F.col("p_size"), "a").alias("name"))
    return rows.select("p_partkey", names.tile_of(F.col("name")).alias("t")).select("p_partkey", "t.*")


@query(
    """WITH f AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'short-name.jpg' ELSE (100 + s_suppkey) || '-lb' || (s_suppkey % 4) || '-' || (s_suppkey % 6) || '-' || (s_suppkey * 11) || '.jpg' END AS n, s_suppkey % 5 > 0 AS ok FROM supplier)
SELECT s_suppkey, CASE WHEN ok THEN (100 + s_suppkey) || '-' || (s_suppkey * 11) END AS frame_id, CASE WHEN ok THEN 'lb' || (s_suppkey % 4) END AS camera_model, CASE WHEN ok THEN (s_suppkey % 6)::VARCHAR END AS cube_idx FROM f"""
)
def frame_names_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    long = F.concat(text(100 + k), F.lit("-lb"), text(k % 4), F.lit("-"), text(k % 6), F.lit("-"), text(k * 11), F.lit(".jpg"))
    name = F.when(k % 5 == 0, "short-name.jpg").otherwise(long)
    return R.table(spark, sf_dir, "supplier").select("s_suppkey", names.frame_of(name).alias("f")).select("s_suppkey", "f.*")


# Geometry


RING = """r AS (SELECT p_partkey, p_partkey % 97 AS a, p_partkey % 89 AS b, 3 + p_size % 20 AS u, 2 + p_size % 7 AS v FROM part)"""


@query(
    f"""WITH {RING} SELECT p_partkey, (u * v - u * v / 4.0)::DOUBLE AS area, a::DOUBLE AS x, b::DOUBLE AS y, u::DOUBLE AS w, v::DOUBLE AS h,
  round(a + (u * v * u / 2.0 - u * v / 4.0 * u * 0.75) / (u * v * 0.75), 6)::DOUBLE AS cx, round(b + (u * v * v / 2.0 - u * v / 4.0 * v * 0.75) / (u * v * 0.75), 6)::DOUBLE AS cy FROM r"""
)
def ring_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, box and centroid of boxes without their last quarter."""
    a, b, u, v = (F.col("p_partkey") % 97).cast("double"), (F.col("p_partkey") % 89).cast("double"), (3 + F.col("p_size") % 20).cast("double"), (2 + F.col("p_size") % 7).cast("double")
    ring = F.array(a, b, a + u, b, a + u, b + v / 2, a + u / 2, b + v / 2, a + u / 2, b + v, a, b + v)
    rows = R.table(spark, sf_dir, "part").select("p_partkey", ring.alias("ring"))
    box, middle = geometry.ring_box(F.col("ring")), geometry.ring_centroid(F.col("ring"))
    return rows.select("p_partkey", geometry.ring_area(F.col("ring")).alias("area"), box.alias("box"), F.round(middle["x"], 6).alias("cx"), F.round(middle["y"], 6).alias("cy")).select("p_partkey", "area", "box.*", "cx", "cy")


@query(
    """WITH b AS (SELECT p_partkey, (p_partkey % 13)::DOUBLE AS ax, (p_partkey % 11)::DOUBLE AS ay, (5 + p_size % 9)::DOUBLE AS s, (p_partkey % 7)::DOUBLE AS bx, (p_partkey % 5)::DOUBLE AS vy, 8.0::DOUBLE AS q FROM part),
o AS (SELECT *, greatest(least(ax + s, bx + q) - greatest(ax, bx), 0) * greatest(least(ay + s, vy + q) - greatest(ay, vy), 0) AS i FROM b)
SELECT p_partkey, round(i / (s * s + q * q - i), 6) AS iou FROM o"""
)
def polygon_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IoU of rings by polygon algebra, on squares so that SQL can follow."""
    k, s = F.col("p_partkey"), (5 + F.col("p_size") % 9).cast("double")
    square = lambda x, y, n: F.array(x, y, x + n, y, x + n, y + n, x, y + n)
    a, b = square((k % 13).cast("double"), (k % 11).cast("double"), s), square((k % 7).cast("double"), (k % 5).cast("double"), F.lit(8.0))
    return dealt_out(R.table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", F.round(geometry.ring_iou(a, b), 6).alias("iou"))


@query(
    f"""WITH {R.IMAGES_SQL}, {R.ANNOTATIONS_SQL}, r AS (SELECT file_name, width, height, unnest([x, y, x + w, y, x + w, y + h, x, y + h]) AS v, unnest(range(1, 9)) AS nth FROM anns JOIN images USING (image_id))
SELECT file_name, 0 AS class, nth, round(v / CASE WHEN nth % 2 = 1 THEN width ELSE height END, 6) AS share FROM r"""
)
def yolo_label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines, read back number by number."""
    lines = coco.yolo_lines(R.annotations(spark, sf_dir).withColumn("category_id", F.lit(1)), R.images(spark, sf_dir))
    told = lines.select("file_name", F.split("line", " ").alias("t"))
    numbers = told.select("file_name", F.get("t", F.lit(0)).cast("int").alias("class"), F.posexplode(F.slice("t", F.lit(2), F.size("t"))).alias("nth", "share"))
    return numbers.select("file_name", "class", (F.col("nth") + 1).cast("long").alias("nth"), F.col("share").cast("double").alias("share"))


# Spatial joins


@query(f"WITH {R.CUSTOMERS_SQL}, {R.SUPPLIERS_SQL} SELECT id, sid, round(sqrt(pow(sx - x, 2) + pow(sy - y, 2)), 6) AS distance FROM points, sites WHERE pow(sx - x, 2) + pow(sy - y, 2) <= 250000")
def radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = spatial.near_pairs(R.suppliers(spark, sf_dir), R.customers(spark, sf_dir), 500.0, ("sx", "sy"), ("x", "y"), fine=4)
    # F.round goes by way of decimal text, which costs far more than finding a pair
    return near.select("id", "sid", (F.rint(F.col("distance") * 1e6) / 1e6).alias("distance"))


@query(f"WITH {R.CUSTOMERS_SQL}, {R.SUPPLIERS_SQL} SELECT sid, sx AS x, sy AS y FROM sites WHERE (SELECT count(*) FROM points WHERE pow(sx - x, 2) + pow(sy - y, 2) <= 40000) >= 3")
def truth_seen_often(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = R.suppliers(spark, sf_dir).withColumnsRenamed({"sx": "x", "sy": "y"})
    trajectory = R.customers(spark, sf_dir).select(F.col("x").alias("cam_x"), F.col("y").alias("cam_y"))
    return control.seen_often(truth, trajectory, "sid", 200.0, 3).select("sid", "x", "y")


NEAR = "near AS (SELECT a.id AS a, b.id AS b FROM points a, points b WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 10000)"


@query(
    f"""WITH RECURSIVE {R.CUSTOMERS_SQL}, {NEAR}, reach(a, b) AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a WHERE n.b <> r.a)
SELECT a AS node, min(b) AS component FROM (SELECT * FROM reach UNION ALL SELECT id, id FROM points) GROUP BY a"""
)
def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.clusters(R.customers(spark, sf_dir), "id", ("x", "y"), 100.0)


@query(
    f"""WITH {R.CUSTOMERS_SQL}, placed AS (SELECT floor((x + 50) / 100) * 100 - 50 AS cx, floor((y + 50) / 100) * 100 - 50 AS cy, CASE WHEN id % 3 = 0 THEN 'FP' ELSE 'FN' END AS tag FROM points WHERE id % 3 < 2)
SELECT cx AS cell_x, cy AS cell_y, tag, count(*) AS n, (cx::BIGINT) || ', ' || (cy::BIGINT) AS cell_id FROM placed GROUP BY ALL"""
)
def heat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id") % 3
    told = R.customers(spark, sf_dir).withColumn("tag", F.when(k == 0, "FP").when(k == 1, "FN").otherwise("TP"))
    return control.heat_map(told, -50.0, -50.0)


DISCS = f"""WITH {R.CUSTOMERS_SQL}, found AS (SELECT id AS det_id, x + (id % 7) * 0.07 + CASE WHEN id % 4 = 0 THEN 5 ELSE 0 END AS x, y + (id % 5) * 0.06 AS y FROM points), inv AS (SELECT id AS label_id, x, CASE WHEN id % 5 = 0 THEN y - 5 ELSE y END AS y FROM points),
d AS (SELECT det_id, label_id, sqrt(pow(f.x - i.x, 2) + pow(f.y - i.y, 2)) AS dist FROM found f, inv i WHERE abs(f.x - i.x) <= 0.7 AND abs(f.y - i.y) <= 0.7 AND pow(f.x - i.x, 2) + pow(f.y - i.y, 2) <= 0.49),
o AS (SELECT *, 2 * 0.1225 * (acos(dist / 0.7) - dist / 0.7 * sqrt(1 - pow(dist / 0.7, 2))) AS lens FROM d), u AS (SELECT det_id, label_id, lens / (2 * pi() * 0.1225 - lens) AS iou FROM o),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY det_id ORDER BY iou DESC, label_id) = 1), hits AS (SELECT * FROM b WHERE iou >= 0.25 QUALIFY row_number() OVER (PARTITION BY label_id ORDER BY iou DESC, det_id) = 1),
tags AS (SELECT CASE WHEN h.label_id IS NULL THEN 'FP' ELSE 'TP' END AS tag, det_id, h.label_id FROM found LEFT JOIN hits h USING (det_id) UNION ALL SELECT 'FN', NULL, label_id FROM inv WHERE label_id NOT IN (SELECT label_id FROM hits))"""


def _discs(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, k = R.customers(spark, sf_dir), F.col("id")
    found = points.select(k.alias("det_id"), (F.col("x") + (k % 7) * 0.07 + F.when(k % 4 == 0, 5).otherwise(0)).alias("x"), (F.col("y") + (k % 5) * 0.06).alias("y"))
    return control.tagged_points(found, points.select(k.alias("label_id"), "x", F.when(k % 5 == 0, F.col("y") - 5).otherwise(F.col("y")).alias("y")))


@query(DISCS + " SELECT tag, coalesce(det_id, -1) AS det_id, coalesce(label_id, -1) AS label_id, CASE tag WHEN 'TP' THEN 'confirmed' WHEN 'FP' THEN 'new detection' ELSE 'missing' END AS said FROM tags")
def inventory_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _discs(spark, sf_dir).select("tag", "det_id", "label_id", control.meaning(F.col("tag")).alias("said")).fillna(-1)


@query(
    DISCS
    + """, c AS (SELECT count(*) FILTER (WHERE tag = 'TP') AS tp, count(*) FILTER (WHERE tag = 'FP') AS fp, count(*) FILTER (WHERE tag = 'FN') AS fn FROM tags), m AS (SELECT *, tp::DOUBLE / (tp + fp) AS p, tp::DOUBLE / (tp + fn) AS r FROM c)
SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM m"""
)
def inventory_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(control.control_metrics(_discs(spark, sf_dir)), "precision", "recall", "f1")


@query(
    f"""WITH RECURSIVE {R.CUSTOMERS_SQL}, {R.SUPPLIERS_SQL}, near AS (SELECT id, sid, sqrt(pow(x - sx, 2) + pow(y - sy, 2)) AS d FROM points, sites WHERE abs(x - sx) <= 300 AND abs(y - sy) <= 300),
ranked AS MATERIALIZED (SELECT id, sid, d, row_number() OVER (ORDER BY d, id, sid) AS n FROM near WHERE d < 300),
taken(n, lefts, rights) AS (SELECT n, [id], [sid] FROM ranked WHERE n = 1 UNION ALL
  SELECT r.n, list_append(lefts, r.id), list_append(rights, r.sid)
  FROM (SELECT lefts, rights, min(r.n) AS m FROM taken t JOIN ranked r ON r.n > t.n AND NOT list_contains(lefts, r.id) AND NOT list_contains(rights, r.sid) GROUP BY ALL) f JOIN ranked r ON r.n = f.m)
SELECT id, sid, round(d, 6) AS distance FROM taken JOIN ranked USING (n)"""
)
def greedy_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = R.customers(spark, sf_dir).select("id", "x", "y")
    return rounded(matching.greedy_pairs(left, R.suppliers(spark, sf_dir), 300.0, ("x", "y"), ("sx", "sy"), "id", "sid"), "distance")


@query(
    f"""WITH {R.CUSTOMERS_SQL}, {R.SUPPLIERS_SQL}, n AS (SELECT sid, sqrt(pow(sx - x, 2) + pow(sy - y, 2)) AS d, (id % 100)::DOUBLE AS v FROM points, sites WHERE pow(sx - x, 2) + pow(sy - y, 2) <= 90000)
SELECT sid AS cell_id, round(coalesce(avg(v) FILTER (WHERE d = 0), sum(v / nullif(d * d, 0)) / sum(1 / nullif(d * d, 0))), 6) AS value, count(*) AS n FROM n GROUP BY sid"""
)
def interpolated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = R.suppliers(spark, sf_dir).select(F.col("sid").alias("cell_id"), F.col("sx").alias("x"), F.col("sy").alias("y"))
    points = R.customers(spark, sf_dir).select(F.col("x").alias("p_x"), F.col("y").alias("p_y"), (F.col("id") % 100).cast("double").alias("p_value"))
    return rounded(triangulation.interpolated(cells, points, 300.0), "value")


# Panoramas


FRAGMENTS = """frags AS (SELECT p_partkey AS id, p_partkey % 40 AS image_id, ((p_partkey * 37) % 7900)::DOUBLE AS x, ((p_partkey * 53) % 3900)::DOUBLE AS y, (60 + p_size)::DOUBLE AS w, (60 + p_size % 30)::DOUBLE AS h, (p_partkey % 100) / 100.0::DOUBLE AS score FROM part),
touch AS (SELECT a.image_id, a.id AS a, b.id AS b FROM frags a JOIN frags b ON a.image_id = b.image_id AND a.id <= b.id AND a.x - 1 <= b.x + b.w + 1 AND b.x - 1 <= a.x + a.w + 1 AND a.y - 1 <= b.y + b.h + 1 AND b.y - 1 <= a.y + a.h + 1),
both_ways AS (SELECT a, b FROM touch UNION SELECT b, a FROM touch)"""
REACHED = f"WITH RECURSIVE {FRAGMENTS}, reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, t.b FROM reach r JOIN both_ways t ON r.b = t.a), grp AS (SELECT a AS id, min(b) AS group_id FROM reach GROUP BY a)"


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    rows = R.table(spark, sf_dir, "part").select(k.alias("id"), (k % 40).alias("image_id"), F.lit("val").alias("dataset"), ((k * 37) % 7900).cast("double").alias("x"), ((k * 53) % 3900).cast("double").alias("y"), (60 + s).cast("double").alias("w"), (60 + s % 30).cast("double").alias("h"), ((k % 100) / 100).alias("score"))
    x, y, w, h = (F.col(c) for c in "xywh")
    return rows.select("id", "image_id", "dataset", "score", F.lit(1).alias("category_id"), geometry.box(x, y, w, h).alias("box"), F.array(F.array(x, y, x + w, y, x + w, y + h, x, y + h)).alias("segmentation"))


@query(REACHED + " SELECT f.image_id, f.id, g.group_id FROM frags f JOIN grp g USING (id)")
def fragment_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panorama.grouped(panorama.fragment_links(fragments(spark, sf_dir))).select("image_id", "id", "group_id")


@query(
    REACHED
    + """, ends AS (SELECT a AS id FROM touch UNION ALL SELECT b FROM touch), med AS (SELECT group_id, median(score) AS score FROM ends JOIN frags USING (id) JOIN grp USING (id) GROUP BY 1)
SELECT g.group_id AS id, count(*) AS n_fragments, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, round(any_value(med.score), 6) AS score FROM frags JOIN grp g USING (id) JOIN med USING (group_id) GROUP BY 1"""
)
def merged_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panorama.merge_fragments(fragments(spark, sf_dir)).select("id", "n_fragments", "box.x", "box.y", "box.w", "box.h", "score"), "score")


@query(
    """WITH t AS (SELECT p_partkey AS id, n_nationkey::BIGINT AS image_id, (p_size * 44)::DOUBLE AS tx, (p_partkey % 9 * 100)::DOUBLE AS ty, (p_partkey % 50)::DOUBLE AS a FROM part JOIN nation ON n_nationkey = p_partkey % 30)
SELECT id, image_id, tx + a AS x, ty + a AS y, 20.0::DOUBLE AS w, 10.0::DOUBLE AS h FROM t"""
)
def tiles_to_panorama(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, a = F.col("p_partkey"), (F.col("p_partkey") % 50).cast("double")
    name = names.tile_name(F.concat(F.lit("pano_"), (k % 30).cast("string"), F.lit(".jpg")), F.col("p_size") * 44, k % 9 * 100)
    dets = R.table(spark, sf_dir, "part").select(k.alias("id"), name.alias("file_name"), F.lit("val").alias("dataset"), F.array(F.array(a, a, a + 20, a, a + 20, a + 10, a, a + 10)).alias("segmentation"))
    return panorama.to_panorama(dets, R.images(spark, sf_dir).select("image_id", "file_name")).select("id", "image_id", "box.*")


# Cameras


DIRECTIONS = "v AS (SELECT event_id, (event_id % 17 - 8)::DOUBLE AS x, (event_id % 13 - 6)::DOUBLE AS y, (event_id % 11 - 5)::DOUBLE + 0.5 AS z FROM events)"


def _directions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    e = F.col("event_id")
    v = camera.vector((e % 17 - 8).cast("double"), (e % 13 - 6).cast("double"), (e % 11 - 5).cast("double") + 0.5)
    return R.table(spark, sf_dir, "events").select("event_id", v.alias("v")), F.col("v")


@query(f"WITH {DIRECTIONS} SELECT event_id, round(4000 + 8000 / (2 * pi()) * atan2(x, z), 6) AS u, round(2000 + 8000 / (2 * pi()) * atan2(y, sqrt(x * x + z * z)), 6) AS v FROM v")
def spherical_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, v = _directions(spark, sf_dir)
    return rounded(rows.select("event_id", camera.spherical_projection(v, F.lit(8000.0), F.lit(4000.0)).alias("p")).select("event_id", "p.*"), "u", "v")


@query(f"WITH {DIRECTIONS} SELECT event_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM v")
def camera_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World to camera to pixel and back again."""
    rows, v = _directions(spark, sf_dir)
    e = F.col("event_id").cast("double")
    pose = F.struct(*[x.alias(n) for x, n in ((e % 100, "x"), (e % 50, "y"), (e % 7, "z"), (e % 360, "yaw"), (e % 20 - 10, "pitch"), (e % 14 - 7, "roll"))])
    w, h = F.lit(8000.0), F.lit(4000.0)
    seen = poses.with_camera(rows.withColumn("pose", pose), "pose").withColumn("c", poses.seen_from(v, F.col("pose"), F.col("matrix")))
    pixel = seen.withColumn("p", poses.panorama_pixel(F.col("c"), w, h)).withColumn("r", F.sqrt(camera.dot(F.col("c"), F.col("c"))))
    way = pixel.withColumn("s", camera.spherical_unprojection(F.col("p.u"), F.col("p.v"), F.col("r"), w, h))
    back = way.withColumn("b", poses.in_world(F.col("s"), F.col("pose"), F.col("matrix")))
    clean = [(F.round(F.col(f"b.{c}"), 6) + 0.0).alias(c) for c in "xyz"]
    return back.select("event_id", *clean)


@query(
    f"""WITH {DIRECTIONS}, d AS (SELECT event_id, [-z, z, -x, x, y, -y] AS s, degrees(atan2(y, sqrt(x * x + y * y))) AS lat, degrees(atan2(x, -z)) AS lon FROM v)
SELECT event_id, (list_position(s, list_max(s)) - 1)::INT AS face, round(lat, 6) AS lat, round(lon, 6) AS lon, CASE WHEN lat >= 40 THEN 5 WHEN ((lon + 360) % 360 + 36) % 360 <= 72 THEN 0 WHEN ((lon + 360) % 360 - 36 + 360) % 360 <= 144 THEN 1 ELSE -1 END::INT AS sensor FROM d"""
)
def faces_and_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, v = _directions(spark, sf_dir)
    cell = lambda n, a, b, c, d: F.struct(F.lit(n).alias("sensor"), F.lit(a).alias("latmin"), F.lit(b).alias("latmax"), F.lit(c).alias("longmin"), F.lit(d).alias("longmax"))
    mosaic = F.array(cell(5, 40.0, 90.0, -180.0, 179.999999999), cell(0, -90.0, 90.0, -36.0, 36.0), cell(1, -90.0, 90.0, 36.0, 180.0))
    told = rows.withColumn("p", camera.lat_lon(v))
    return rounded(told.select("event_id", camera.face_of(v).alias("face"), "p.lat", "p.lon", camera.sensor_of(F.col("p"), mosaic).alias("sensor")), "lat", "lon")


@query(
    f"""WITH {DIRECTIONS}, d AS (SELECT event_id, y / sqrt(x * x + y * y + z * z) AS vy FROM v WHERE y <> 0)
SELECT event_id, round(7 * sqrt(500 / (8000.0::DOUBLE * 4000 / (2 * pi() * pi()) * abs(vy) / sqrt(1 - vy * vy))), 6) AS radius FROM d"""
)
def disc_radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, v = _directions(spark, sf_dir)
    radius = camera.disc_radius(F.lit(500.0), v, F.lit(7.0), F.lit(8000.0), F.lit(4000.0))
    return rows.filter(v["y"] != 0).select("event_id", F.round(radius, 6).alias("radius"))


# Triangulation


CROSSED = f"""WITH {R.RAYS_SQL}, pairs AS (SELECT a.trajectory, a.ray_id AS ray_a, b.ray_id AS ray_b, a.frame AS frame_a, b.frame AS frame_b, a.ox, a.oy, a.oz, a.dx, a.dy, a.dz, b.ox AS px, b.oy AS py, b.oz AS pz, b.dx AS ex, b.dy AS ey, b.dz AS ez,
  a.dx * b.dx + a.dy * b.dy + a.dz * b.dz AS c, (b.ox - a.ox) * a.dx + (b.oy - a.oy) * a.dy + (b.oz - a.oz) * a.dz AS va, (b.ox - a.ox) * b.dx + (b.oy - a.oy) * b.dy + (b.oz - a.oz) * b.dz AS vb
  FROM rays a JOIN rays b ON a.trajectory = b.trajectory AND a.frame < b.frame AND abs(a.ox - b.ox) <= 40),
ts AS (SELECT *, (va - vb * c) / (1 - c * c) AS ta, (va * c - vb) / (1 - c * c) AS tb FROM pairs WHERE abs(1 - c * c) >= 1e-6),
met AS (SELECT *, (ox + ta * dx + px + tb * ex) / 2 AS mx, (oy + ta * dy + py + tb * ey) / 2 AS my, (oz + ta * dz + pz + tb * ez) / 2 AS mz,
  sqrt(pow(ox + ta * dx - px - tb * ex, 2) + pow(oy + ta * dy - py - tb * ey, 2) + pow(oz + ta * dz - pz - tb * ez, 2)) AS gap FROM ts WHERE ta BETWEEN 0 AND 20 AND tb BETWEEN 0 AND 20),
good AS (SELECT * FROM met WHERE gap <= 0.2 AND mz > -0.8 AND mz < 1.0),
crossings AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY trajectory, ray_b, frame_a ORDER BY round(gap, 9), ray_a) = 1)"""


@query(CROSSED + " SELECT trajectory, ray_b, frame_a, frame_b, round(gap, 6) AS gap, round(greatest(ta, tb), 6) AS length FROM crossings")
def ray_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = triangulation.crossings(R.rays(spark, sf_dir))
    return found.select("trajectory", "ray_b", "frame_a", "frame_b", (F.round("gap", 6) + 0.0).alias("gap"), F.round("length", 6).alias("length"))


@query()
def triangulated_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(triangulation.triangulate(R.rays(spark, sf_dir)), "x", "y", "elevation").select("x", "y", "elevation", "intersections", "last_seen")


@query()
def followed_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frame by frame, with candidates that free and claim rays."""
    found = peeling.followed(R.rays(spark, sf_dir))
    return rounded(peeling.merged_places(found), "x", "y", "elevation", "mean_intersection_length", "mean_intersection_dist")


@query(
    """WITH RECURSIVE o AS (SELECT user_id, event_id AS frame_id, ts AS time, event_id * 2.0::DOUBLE % 97 AS x, event_id * 7.0::DOUBLE % 40 AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL),
near AS (SELECT a.user_id, a.n, list(b.n) AS around FROM o a JOIN o b USING (user_id) WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 10 GROUP BY ALL),
steps(user_id, seed, taken, got) AS (SELECT user_id, 1, [1::BIGINT], [1::BIGINT] FROM o WHERE n = 1 UNION ALL
  SELECT t.user_id, t.seed, list_concat(t.taken, list_filter(around, lambda k: NOT list_contains(t.taken, k))), list_filter(around, lambda k: NOT list_contains(t.taken, k))
  FROM (SELECT s.user_id, s.taken, min(o.n) AS seed FROM steps s JOIN o ON o.user_id = s.user_id AND NOT list_contains(s.taken, o.n) GROUP BY ALL) t JOIN near ON near.user_id = t.user_id AND near.n = t.seed),
ways AS (SELECT s.user_id, s.seed, s.got, o.x - lag(o.x) OVER w AS wx, o.y - lag(o.y) OVER w AS wy FROM steps s JOIN o ON o.user_id = s.user_id AND o.n = s.seed WINDOW w AS (PARTITION BY s.user_id ORDER BY s.seed)),
scaled AS (SELECT user_id, seed, got, CASE WHEN sqrt(wx * wx + wy * wy) >= 1e-6 THEN wx / sqrt(wx * wx + wy * wy) ELSE 1.0 END AS wx, CASE WHEN sqrt(wx * wx + wy * wy) >= 1e-6 THEN wy / sqrt(wx * wx + wy * wy) ELSE 0.0 END AS wy FROM ways),
held AS (SELECT user_id, seed, wx, wy, unnest(got) AS n FROM scaled)
SELECT user_id, frame_id, row_number() OVER (PARTITION BY user_id ORDER BY seed, x * wx + y * wy, time, frame_id) - 1 AS sort_index FROM held JOIN o USING (user_id, n)"""
)
def travel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    frames = R.table(spark, sf_dir, "events").select("user_id", e.alias("frame_id"), F.unix_micros(F.to_timestamp_ltz(F.col("ts").cast("string"))).cast("double").alias("time"), (e * 2.0 % 97).alias("x"), (e * 7.0 % 40).alias("y"), F.lit(0.0).alias("z"))
    return triangulation.travel_order(frames, ["user_id"])


# Reviews, images with annotations, sets, graphs


REVIEW = """WITH s AS (SELECT event_id % 1000 AS ann_id, arg_max(event_type, ts) AS last FROM events GROUP BY 1),
states AS (SELECT p_partkey AS ann_id, p_brand AS grp, CASE WHEN last = 'error' THEN 'removed' WHEN last = 'click' THEN 'validated' ELSE 'unchecked' END AS state FROM part LEFT JOIN s ON ann_id = p_partkey)"""


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = R.table(spark, sf_dir, "events").select((F.col("event_id") % 1000).alias("ann_id"), (F.col("event_type") == "click").alias("validated"), (F.col("event_type") == "error").alias("removed"), F.col("ts").alias("at"))
    return control.reviewed(R.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ann_id"), F.col("p_brand").alias("grp")), status)


@query(REVIEW + " SELECT state, count(*) AS n FROM states GROUP BY 1")
def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviewed(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))


@query(
    REVIEW
    + """ SELECT ann_id, grp, state, coalesce(min(CASE WHEN state = 'unchecked' THEN ann_id END) OVER (PARTITION BY grp ORDER BY ann_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
  min(CASE WHEN state = 'unchecked' THEN ann_id END) OVER (PARTITION BY grp)) AS next_id FROM states"""
)
def next_unchecked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.next_unchecked(_reviewed(spark, sf_dir), "ann_id", ["grp"])


@query(f"WITH {R.IMAGES_SQL}, {R.ANNOTATIONS_SQL} SELECT i.image_id, count(a.ann_id) AS n, coalesce(min(a.ann_id), -1) AS first_id FROM images i LEFT JOIN anns a USING (image_id) GROUP BY 1")
def nested_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coco.nested(R.images(spark, sf_dir), R.annotations(spark, sf_dir))
    return rows.select("image_id", F.size("annotations").cast("long").alias("n"), F.coalesce(F.get("annotations", F.lit(0))["ann_id"], F.lit(-1)).alias("first_id"))


@query(
    """WITH s AS (SELECT o_custkey % 50 AS grp, list(DISTINCT o_orderkey % 20) FILTER (WHERE o_orderstatus = 'F') AS a, list(DISTINCT o_orderkey % 20) FILTER (WHERE o_orderstatus <> 'F') AS b FROM orders GROUP BY 1),
t AS (SELECT grp, coalesce(a, []) AS a, coalesce(b, []) AS b FROM s)
SELECT grp, len(list_distinct(list_concat(a, b))) AS n_union, len(list_intersect(a, b)) AS n_both, len(list_filter(a, lambda v : NOT list_contains(b, v))) AS n_only FROM t"""
)
def id_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 20
    sets = R.table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("grp")).agg(F.collect_set(F.when(F.col("o_orderstatus") == "F", k)).alias("a"), F.collect_set(F.when(F.col("o_orderstatus") != "F", k)).alias("b"))
    return sets.select("grp", *[F.size(f("a", "b")).cast("long").alias(n) for f, n in ((F.array_union, "n_union"), (F.array_intersect, "n_both"), (F.array_except, "n_only"))])


@query(
    """WITH RECURSIVE e AS (SELECT s_suppkey AS a, CASE WHEN s_suppkey % 7 = 0 THEN s_suppkey - s_suppkey % 49 ELSE s_suppkey - s_suppkey % 7 END AS b FROM supplier), w AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(a, b) AS (SELECT a, b FROM w UNION SELECT r.a, w.b FROM r JOIN w ON r.b = w.a) SELECT a AS node, least(min(b), a) AS component FROM r GROUP BY a"""
)
def linked_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return graph.connected_components(R.table(spark, sf_dir, "supplier").select(k.alias("a"), F.when(k % 7 == 0, k - k % 49).otherwise(k - k % 7).alias("b")))
