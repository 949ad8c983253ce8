"""Places of objects from rays: crossings, clusters, peeling, candidates."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rayloom.functions.camera import disc_radius, dot, let, minus, norm, plus, vector
from rayloom.lineage import dealt_out, stored
from rayloom.operators.spatial import clusters, near_pairs

# Fixed values.
#: Heights of an object below the higher camera and below the lower one, in metres, between which a crossing counts.
BELOW = (2.0, 3.8)
#: Most difference of the radii that two masks stand for, and the panorama that their areas are counted in.
RADIUS_GAP, PANORAMA = 0.2, (8000, 4000)


def closest(a: Column, b: Column) -> Column:
    """``t_a, t_b, point, gap`` where two rays come closest, nulls for parallel ones.

    A ray is a struct of ``origin`` and ``direction`` (length 1); ``t`` is the
    way along it.
    """
    along = lambda v: F.struct(dot(a["direction"], b["direction"]).alias("turn"), dot(v, a["direction"]).alias("a"), dot(v, b["direction"]).alias("b"))
    first = let(minus(b["origin"], a["origin"]), along)
    at = lambda ray, t: plus(ray["origin"], vector(*[ray["direction"][c] * t for c in "xyz"]))

    def ways(k: Column) -> Column:
        spread = F.when(F.abs(1 - k["turn"] * k["turn"]) >= 1e-6, 1 - k["turn"] * k["turn"])
        return F.struct(((k["a"] - k["b"] * k["turn"]) / spread).alias("a"), ((k["a"] * k["turn"] - k["b"]) / spread).alias("b"))

    def ends(t: Column) -> Column:
        return let(F.struct(at(a, t["a"]).alias("p"), at(b, t["b"]).alias("q")), lambda e: told(t, e))

    def told(t: Column, e: Column) -> Column:
        middle = vector(*[(e["p"][c] + e["q"][c]) / 2 for c in "xyz"])
        return F.struct(t["a"].alias("t_a"), t["b"].alias("t_b"), middle.alias("point"), norm(minus(e["p"], e["q"])).alias("gap"))

    return let(first, lambda k: let(ways(k), ends))


def reaching(ways: DataFrame, most_gap: float, radius: float, height: bool) -> DataFrame:
    """``ways`` (``x_, y_, z_, dx_, dy_, dz_``) with ``low_x_, low_y_, high_x_, high_y_``: the box, seen from above, in which a ray can cross another.

    With ``height`` a crossing is below the ray's own camera by ``BELOW[0]`` at
    least, but for half of the gap, so the stretch before is left out, and so
    are rays that don't get there.
    """
    deep = BELOW[0] - most_gap / 2 - 1e-6
    start = F.when(F.col("dz_") < 0, deep / -F.col("dz_")) if height and deep > 0 else F.lit(0.0)
    met = ways.withColumn("start", start).filter(F.col("start") <= radius)
    ends = {c: [F.col(f"{c}_") + t * F.col(f"d{c}_") for t in (F.col("start"), F.lit(radius))] for c in "xy"}
    half = most_gap / 2 + 1e-6  # more than rounding
    return met.withColumns({f"low_{c}_": F.least(*ends[c]) - half for c in "xy"} | {f"high_{c}_": F.greatest(*ends[c]) + half for c in "xy"}).drop("start")


def crossings(rays: DataFrame, most_gap: float = 0.2, radius: float = 20.0, height: bool = True, mask: bool = False) -> DataFrame:
    """Crossings of rays of different frames of a trajectory.

    ``rays``: ``trajectory, ray_id, frame, origin, direction`` and, for
    ``mask``, ``mask_area``; frames are numbers in order.  Two rays cross where
    they come within ``most_gap`` at no more than ``radius`` along either, and,
    with ``height``, at a height below the cameras that an object can have.
    Each ray keeps its best crossing with every earlier frame.  Only rays whose
    origins are within two radii are compared, and of these only such that can
    hold a crossing in the same cell.  Returns ``trajectory, ray_a,
    ray_b, frame_a, frame_b, point, gap, length``; ``b`` is the later frame,
    ``length`` the longer of the two ways.
    """
    place, way = [f"{p}_" for p in "xyz"], [f"d{p}_" for p in "xyz"]
    cols = [F.col("ray_id").alias("ray_"), F.col("frame").alias("frame_"), *[F.col(f"origin.{p}").alias(n) for p, n in zip("xyz", place)], *[F.col(f"direction.{p}").alias(n) for p, n in zip("xyz", way)]]
    names = ["ray_", "frame_", *place, *way]
    if mask:
        cols.append(F.col("mask_area").alias("area_"))
        names.append("area_")
    size, ways = radius, stored(reaching(rays.select("trajectory", *cols), most_gap, radius, height), "rays")  # else a ray is worked out for each of its cells and bounds
    for c in "xy":
        ways = ways.withColumn(f"cell_{c}", F.explode(F.sequence(F.floor(F.col(f"low_{c}_") / size).cast("long"), F.floor(F.col(f"high_{c}_") / size).cast("long"))))
    ways, bounds = ways.drop("high_x_", "high_y_"), ["low_x_", "low_y_"]
    on = ["trajectory", "cell_x", "cell_y"]
    side = lambda s: dealt_out(ways.withColumnsRenamed({n: n + s for n in [*names, *bounds]}), *on)
    near = side("a").join(side("b"), on).filter("frame_a < frame_b")  # no more is asked here: a method that is too long isn't compiled
    # The closest approach in narrow steps, each with its filter: nothing is worked out for pairs that an earlier one drops.
    v = {s: F.expr("(x_b - x_a) * dx_{0} + (y_b - y_a) * dy_{0} + (z_b - z_a) * dz_{0}".format(s)) for s in "ab"}
    turned = near.withColumns({"turn": F.expr("dx_a * dx_b + dy_a * dy_b + dz_a * dz_b"), "v_a": v["a"], "v_b": v["b"]}).withColumn("spread", 1 - F.col("turn") * F.col("turn"))
    met = turned.filter(F.abs("spread") >= 1e-6).withColumns({"t_a": F.expr("(v_a - v_b * turn) / spread"), "t_b": F.expr("(v_a * turn - v_b) / spread")})
    met = met.filter(F.col("t_a").between(0, radius) & F.col("t_b").between(0, radius)).drop("turn", "v_a", "v_b", "spread")
    met = stored(met, "ways")  # else the ways are written out wherever they are used, in a method too long to be compiled
    for c in "xy":  # of the cells that both are in, the pair counts in one
        met = met.filter(F.col(f"cell_{c}") == F.floor(F.greatest(f"low_{c}_a", f"low_{c}_b") / size))
    met = met.filter(" + ".join(f"({p}_a - {p}_b) * ({p}_a - {p}_b)" for p in "xyz") + f" <= {4 * radius * radius!r}")
    met = met.withColumn("gap", F.expr("sqrt({})".format(" + ".join("({0} * {0})".format(f"({p}_a + t_a * d{p}_a - {p}_b - t_b * d{p}_b)") for p in "xyz")))).filter(F.col("gap") <= most_gap)
    middle = {p: F.expr(f"({p}_a + t_a * d{p}_a + {p}_b + t_b * d{p}_b) / 2") for p in "xyz"}
    if height:
        lower = F.least("z_a", "z_b")
        met = met.filter((middle["z"] > lower - BELOW[1]) & (middle["z"] < lower - BELOW[0]))
    if mask:
        size = lambda s: disc_radius(F.col(f"area_{s}"), vector(*[F.col(f"d{p}_{s}") for p in "xyz"]), F.col(f"t_{s}"), *map(F.lit, PANORAMA))
        met = met.filter(F.abs(size("a") - size("b")) <= RADIUS_GAP)
    met = met.select("trajectory", "ray_a", "ray_b", "frame_a", "frame_b", "t_a", "t_b", "gap", vector(*middle.values()).alias("point"))
    best = met.withColumn("length", F.greatest("t_a", "t_b")).groupBy("trajectory", "ray_b", "frame_a", "frame_b").agg(F.min(F.struct("gap", "ray_a", "point", "length")).alias("m"))
    return best.select("trajectory", F.col("m.ray_a").alias("ray_a"), "ray_b", "frame_a", "frame_b", F.col("m.point").alias("point"), F.col("m.gap").alias("gap"), F.col("m.length").alias("length"))


def _clustered(rows: DataFrame, reach: float) -> DataFrame:
    """``rows`` (``trajectory, crossing_id, point``) with the cluster of their trajectory that they fall in."""
    flat = rows.select("trajectory", "crossing_id", *[F.col(f"point.{c}").alias(c) for c in "xyz"])
    named = clusters(flat, "crossing_id", ("x", "y", "z"), reach, ["trajectory"])
    return rows.join(named.select(F.col("node").alias("crossing_id"), F.col("component").alias("cluster")), "crossing_id")


def peeled(found: DataFrame, reach: float = 0.5) -> DataFrame:
    """Crossings that survive peeling, with their ``cluster``.

    In turn the largest cluster is kept and whatever shares a ray with it
    goes.  A cluster that is larger than all it shares a ray with is kept
    whatever else happens, so a round keeps all of those at once; the rest is
    clustered again.  Of equal sizes the least id is first.
    """
    left = stored(found, "crossings")
    kept: DataFrame | None = None
    while not left.isEmpty():
        now = stored(_clustered(left, reach), "clustered")
        sizes = now.groupBy("trajectory", "cluster").agg((-F.count("*")).alias("order"))
        rays = now.select("trajectory", "cluster", F.explode(F.array("ray_a", "ray_b")).alias("ray")).distinct().join(sizes, ["trajectory", "cluster"])
        rank = F.struct("order", "cluster")
        first = rays.groupBy("trajectory", "ray").agg(F.min(rank).alias("first"))
        beaten = rays.join(first, ["trajectory", "ray"]).filter(rank != F.col("first")).select("trajectory", "cluster").distinct()
        won = stored(now.join(beaten, ["trajectory", "cluster"], "left_anti"), "kept")
        kept = won if kept is None else kept.unionByName(won)
        used = won.select("trajectory", F.explode(F.array("ray_a", "ray_b")).alias("ray")).distinct()
        a, b = used.withColumnRenamed("ray", "ray_a"), used.withColumnRenamed("ray", "ray_b")
        left = stored(now.drop("cluster").join(a, ["trajectory", "ray_a"], "left_anti").join(b, ["trajectory", "ray_b"], "left_anti").select(*found.columns), "left")
    return left.withColumn("cluster", F.col("crossing_id")) if kept is None else kept


def candidates(kept: DataFrame, by: Sequence[str] = ("trajectory", "cluster")) -> DataFrame:
    """One place per cluster: the medians of its crossings, their number, mean length and mean gap, and its last frame."""
    return kept.groupBy(*by).agg(
        *[F.median(f"point.{c}").alias(n) for c, n in (("x", "x"), ("y", "y"), ("z", "elevation"))],
        F.count("*").alias("intersections"),
        F.avg("length").alias("mean_intersection_length"),
        F.avg("gap").alias("mean_intersection_dist"),
        F.max("frame_b").alias("last_seen"),
    )


def merge_candidates(kept: DataFrame, found: DataFrame, reach: float = 1.0) -> DataFrame:
    """Candidates whose places are joined by steps of at most ``reach`` as one, made anew from all of their crossings."""
    told = found.select("trajectory", "cluster", "x", "y", "elevation")
    named = clusters(told, "cluster", ("x", "y", "elevation"), reach).select(F.col("node").alias("cluster"), F.col("component").alias("place"))
    return candidates(kept.join(named, "cluster"), ["place"])


def triangulate(rays: DataFrame, most_gap: float = 0.2, reach: float = 0.5, merge_reach: float = 1.0, radius: float = 20.0, height: bool = True, mask: bool = False) -> DataFrame:
    """Places of objects from all rays: crossings, peeling, candidates, and near candidates merged.

    All frames of a trajectory are seen at once; the frame-by-frame pool is
    :mod:`rayloom.streaming.peeling`.
    """
    found = crossings(rays, most_gap, radius, height, mask).withColumn("crossing_id", F.struct("trajectory", "ray_b", "frame_a", "ray_a"))
    kept = peeled(found, reach)  # stored round by round
    return merge_candidates(kept, stored(candidates(kept), "candidates"), merge_reach)


def _stretches(batches: Iterator[pa.RecordBatch], parts: Sequence[str]) -> Iterator[pa.Table]:
    """Sorted batches cut anew, so that rows of the same ``parts`` are in one table; a table has many such stretches or a long one."""
    key = lambda b, i: [b.column(c)[i].as_py() for c in parts]
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last, low, high = key(batch, -1), 0, batch.num_rows - 1  # where the last stretch of the batch begins
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if key(batch, middle) == last else (middle + 1, high)
        if low or (held and key(held[-1], -1) != last):
            if low:
                held.append(batch.slice(0, low))
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(low))
    if held:
        yield pa.Table.from_batches(held)


def _seeds(on: list[tuple], place: list[list], alone: list[bool], radius: float) -> list[int]:
    """The row that collects each row: rows are in stretches (``on``), in order of time within them."""
    n, xyz = len(on), list(zip(*place))
    known = [all(v is not None and math.isfinite(v) for v in p) for p in xyz]
    seed, start = list(range(n)), 0
    while start < n:
        end = start + 1
        while end < n and on[end] == on[start]:
            end += 1
        if end - start > 1:
            free: dict[tuple[int, ...], list[int]] = {}
            for i in range(start, end):
                if known[i]:
                    free.setdefault(tuple(math.floor(v / radius) for v in xyz[i]), []).append(i)
            taken = set()
            for i in range(start, end):
                if i in taken or not known[i]:
                    continue
                taken.add(i)
                if alone[i]:
                    continue
                x, y, z = xyz[i]
                cx, cy, cz = (math.floor(v / radius) for v in xyz[i])
                for cell in itertools.product((cx - 1, cx, cx + 1), (cy - 1, cy, cy + 1), (cz - 1, cz, cz + 1)):
                    if not (some := free.get(cell)):
                        continue
                    left = []
                    for j in some:
                        if j in taken:
                            continue
                        u, v, w = xyz[j][0] - x, xyz[j][1] - y, xyz[j][2] - z
                        if math.sqrt(u * u + v * v + w * w) <= radius:
                            seed[j] = i
                            taken.add(j)
                        else:
                            left.append(j)
                    free[cell] = left
        start = end
    return seed


def travel_order(frames: DataFrame, by: Sequence[str], radius: float = 10.0) -> DataFrame:
    """``<by>, frame_id, sort_index``: frames of each group in order of time, near ones in order of travel.

    ``frames``: ``frame_id, time, x, y, z``, more rows of a frame allowed.  The
    frames are taken by time; each one that is still free collects the free
    ones within ``radius``, in order of their place along the way from the
    last such frame; the first one of a group collects none.

    Who collects whom is settled apart in each stretch of a group: groups are
    cut where no frame is within ``radius`` along x, and then along y, so a
    stretch is a task's, a group isn't.  Frames of a null group are left out.
    """
    first = frames.groupBy(*by, "frame_id").agg(F.min(F.struct("time", "x", "y", "z")).alias("p")).select(*by, "frame_id", "p.*").dropna(subset=list(by))
    parts = list(by)
    for c in ("x", "y"):
        order = Window.partitionBy(*parts).orderBy(c)
        apart = F.when(F.col(c) - F.lag(c).over(order) > radius, 1).otherwise(0)
        first = first.withColumn("cut", apart).withColumn(f"part_{c}", F.sum("cut").over(order)).drop("cut")
        parts.append(f"part_{c}")
    earliest = F.min(F.struct("time", "frame_id")).over(Window.partitionBy(*by))
    rows = first.withColumn("alone", F.struct("time", "frame_id") == earliest).select(*parts, "frame_id", "time", "x", "y", "z", "alone")

    dealt = dealt_out(rows, *parts).sortWithinPartitions(*parts, F.asc_nulls_last("time"), "frame_id")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _stretches(batches, parts):
            place = [some.column(c).to_pylist() for c in ("x", "y", "z")]
            on = list(zip(*(some.column(c).to_pylist() for c in parts)))
            seed = pa.array(_seeds(on, place, some.column("alone").to_pylist(), radius))
            told = [*[some.column(c) for c in (*by, "frame_id", "time", "x", "y", "z")], some.column("time").take(seed), some.column("frame_id").take(seed)]
            yield from pa.table(told, [*by, "frame_id", "time", "x", "y", "z", "seed_time", "seed_id"]).to_batches()

    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in (*by, "frame_id", "time", "x", "y", "z")) + f", seed_time {types['time']}, seed_id {types['frame_id']}"
    taken = stored(dealt.mapInArrow(collect, schema), "collected")
    seeds = taken.filter(F.col("frame_id") == F.col("seed_id")).select(*by, "seed_id", "seed_time", "x", "y", "z")
    last = Window.partitionBy(*by).orderBy("seed_time", "seed_id")
    seeds = seeds.withColumns({f"w{c}": F.col(c) - F.lag(c).over(last) for c in "xyz"}).withColumn("length", F.expr("sqrt(wx * wx + wy * wy + wz * wz)"))
    seeds = seeds.select(*by, "seed_id", *[F.when(F.col("length") >= 1e-6, F.col(f"w{c}") / F.col("length")).otherwise(F.lit(1.0 if c == "x" else 0.0)).alias(f"w{c}") for c in "xyz"])
    along = taken.join(seeds, [*by, "seed_id"]).withColumn("along", F.expr("x * wx + y * wy + z * wz"))
    order = Window.partitionBy(*by).orderBy("seed_time", "seed_id", "along", "time", "frame_id")
    return along.select(*by, "frame_id", (F.row_number().over(order) - 1).cast("long").alias("sort_index"))


def interpolated(cells: DataFrame, points: DataFrame, reach: float, power: float = 2.0) -> DataFrame:
    """``cell_id, value, n``: each cell's (``cell_id, x, y``) mean of near points (``p_x, p_y, p_value``), weighed by distance; a point in place counts alone."""
    near = near_pairs(cells.select("cell_id", "x", "y"), points.select("p_x", "p_y", "p_value"), reach, ("x", "y"), ("p_x", "p_y"))
    weight = 1 / F.pow(F.nullif(F.col("distance"), F.lit(0.0)), power)
    here = F.avg(F.when(F.col("distance") == 0, F.col("p_value")))
    return near.groupBy("cell_id").agg(F.coalesce(here, F.sum(weight * F.col("p_value")) / F.sum(weight)).alias("value"), F.count("*").alias("n"))


def triangulate_frames(frames: DataFrame, ray_builder: Callable[[DataFrame], DataFrame], **options) -> DataFrame:
    """Places of objects from frames of any camera: ``ray_builder`` turns all frames into rays at once."""
    return triangulate(frames.transform(ray_builder), **options)


def leftover(found: DataFrame, kept: DataFrame) -> DataFrame:
    """Crossings that no kept cluster holds: the false ones."""
    return found.join(kept.select("crossing_id"), "crossing_id", "left_anti")
