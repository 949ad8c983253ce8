"""Places of objects from rays, frame by frame: crossings, peeling, and a pool of candidates that frees and claims rays.

Each trajectory is followed in the order of its frames.  A frame's rays cross
those of earlier frames that are in play; all crossings in play are peeled
into clusters; a cluster joins a candidate near by or begins one.  A candidate
that changes brings its crossings and their rays back into play, one that
misses too many frames takes its rays out of play and comes out.

On a stream the rays, crossings and candidates of a trajectory are map states
of their own, and a batch reads and writes only what it meets: rays are found
by the cell of their origin, since rays further apart than two radii can't
cross.  On a table the same frames are followed through sorted partitions.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from statistics import fmean

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rayloom.lineage import stored
from rayloom.operators.spatial import clusters
from rayloom.operators.triangulation import BELOW, PANORAMA, RADIUS_GAP

HELD = "array<struct<ray_a:bigint,ray_b:bigint,x:double,y:double,z:double,length:double,gap:double>>"
RESULT = f"trajectory bigint, candidate bigint, x double, y double, elevation double, intersections bigint, mean_intersection_length double, mean_intersection_dist double, last_seen bigint, missing bigint, held {HELD}"
RAYS = "trajectory bigint, frame bigint, ray_id bigint, ox double, oy double, oz double, dx double, dy double, dz double, area double"
#: Crossings of candidates that a task gathers before it hands them on: a batch costs as much as hundreds of frames.
GATHERED = 5000


@dataclass(frozen=True)
class Rules:
    """Most gap of two rays, reach of a cluster and of a candidate, frames that a candidate may miss, and how far along a ray a crossing counts."""

    most_gap: float = 0.2
    reach: float = 0.5
    update_reach: float = 1.0
    limit: int = 5
    radius: float = 20.0
    height: bool = True
    mask: bool = False

    def cell(self, origin) -> tuple[int, int, int]:
        """Rays that cross have origins in cells beside each other."""
        return tuple(math.floor(v / (2 * self.radius + self.most_gap)) for v in origin)


def _disc(area: float, d: tuple[float, ...], t: float) -> float:
    """Radius of the flat disc whose mask has an area, seen along ``d`` at a distance."""
    width, height = PANORAMA
    scale = width * height / (2 * math.pi**2) * abs(d[1]) / math.sqrt(max(1 - d[1] ** 2, 1e-12))
    return t * math.sqrt(area / scale) if scale else math.nan


def _middle(values: Iterable[float]) -> float:
    some = sorted(values)
    half = len(some) // 2
    return some[half] if len(some) % 2 else (some[half - 1] + some[half]) / 2


Point = tuple[float, float, float]


@dataclass
class Candidate:
    held: set[int]
    centre: Point
    last: int
    missing: int = 0


@dataclass
class Trajectory:
    """What is known of a trajectory after some frames.

    ``rays``: frame, origin and direction, area, and whether in play, by id;
    ``crossings``: the two rays, point, length, gap, and whether in play, by
    number; both hold what is in play or part of an active candidate.

    A crossing never moves, so those within reach of it (``near``) are looked
    for once, when it is first seen, and not in each frame.
    """

    rules: Rules
    rays: dict[int, tuple[int, tuple[float, ...], float | None, bool]] = field(default_factory=dict)
    crossings: dict[int, tuple[int, int, Point, float, float, bool]] = field(default_factory=dict)
    pool: dict[int, Candidate] = field(default_factory=dict)
    next_crossing: int = 0
    next_candidate: int = 0
    cells: dict[tuple[int, int, int], set[int]] = field(default_factory=lambda: defaultdict(set))
    near: dict[int, set[int]] = field(default_factory=dict)
    spots: dict[tuple[int, int, int], list[int]] = field(default_factory=dict)
    centres: dict[tuple[int, ...], Point] = field(default_factory=dict)

    def _play(self, ray: int, on: bool) -> None:
        frame, way, area, was = self.rays[ray]
        if was != on:
            self.rays[ray] = (frame, way, area, on)
        cell = self.rules.cell(way[:3])
        if on:
            self.cells[cell].add(ray)
        elif some := self.cells.get(cell):
            some.discard(ray)
            if not some:  # else what a long trajectory has left behind is passed over in each frame
                del self.cells[cell]

    def _meet(self, frame: int, rays: list[int]) -> None:
        """Crossings of a frame's rays: with each earlier frame the one of least gap, of the least ray of several."""
        by_cell: dict[tuple[int, int, int], list[int]] = {}
        for r in rays:
            by_cell.setdefault(self.rules.cell(self.rays[r][1][:3]), []).append(r)
        found: dict[int, list[tuple]] = {}
        for (x, y, z), some in by_cell.items():
            around: list[int] = []
            for a in (x - 1, x, x + 1):
                for b in (y - 1, y, y + 1):
                    for c in (z - 1, z, z + 1):
                        if held := self.cells.get((a, b, c)):
                            around += held
            near = sorted(r for r in around if self.rays[r][0] != frame)
            if near:
                self._compare(near, some, found)
        for ray in rays:  # crossings are numbered by ray
            for met in found.get(ray, ()):
                self.crossings[self.next_crossing] = met
                self.next_crossing += 1

    def _compare(self, near: list[int], rays: list[int], found: dict[int, list[tuple]]) -> None:
        """The best crossings of some new rays with near earlier ones, all pairs of a part at once."""
        rules, rows = self.rules, max(1, 200_000 // len(near))
        if len(rays) > rows:
            for i in range(0, len(rays), rows):
                self._compare(near, rays[i : i + rows], found)
            return
        ox, oy, oz, dx, dy, dz = np.array([self.rays[r][1] for r in near]).T
        px, py, pz, ex, ey, ez = np.array([self.rays[r][1] for r in rays]).T[:, :, None]
        vx, vy, vz = px - ox, py - oy, pz - oz
        turn = dx * ex + dy * ey + dz * ez
        spread = 1 - turn * turn
        va, vb = vx * dx + vy * dy + vz * dz, vx * ex + vy * ey + vz * ez
        with np.errstate(divide="ignore", invalid="ignore"):
            ta, tb = (va - vb * turn) / spread, (va * turn - vb) / spread
        ok = (np.abs(spread) >= 1e-6) & (ta >= 0) & (tb >= 0) & (ta <= rules.radius) & (tb <= rules.radius)
        best: dict[int, dict[int, tuple]] = {}
        for i, k in zip(*(v.tolist() for v in np.nonzero(ok))):
            earlier, ray, s, t = near[k], rays[i], ta.item(i, k), tb.item(i, k)
            (frame, a, area_a, _), (_, b, area_b, _) = self.rays[earlier], self.rays[ray]
            x, y, z = a[0] + s * a[3], a[1] + s * a[4], a[2] + s * a[5]
            u, v, w = b[0] + t * b[3], b[1] + t * b[4], b[2] + t * b[5]
            gap = math.sqrt((x - u) * (x - u) + (y - v) * (y - v) + (z - w) * (z - w))
            if not gap <= rules.most_gap:
                continue
            if rules.height and not min(a[2], b[2]) - BELOW[1] < (z + w) / 2 < min(a[2], b[2]) - BELOW[0]:
                continue
            if rules.mask and not abs(_disc(area_a, a[3:], s) - _disc(area_b, b[3:], t)) <= RADIUS_GAP:
                continue
            of_ray = best.setdefault(ray, {})
            if frame not in of_ray or gap < of_ray[frame][4]:
                of_ray[frame] = (earlier, ray, ((x + u) / 2, (y + v) / 2, (z + w) / 2), max(s, t), gap, True)
        found.update((ray, list(of_ray.values())) for ray, of_ray in best.items())

    def _place(self, k: int) -> None:
        """Links of a crossing with those within reach that are there already."""
        reach, spots, crossings = self.rules.reach, self.spots, self.crossings
        p = crossings[k][2]
        x, y, z = (math.floor(v / reach) for v in p)
        mine = self.near[k] = set()
        for a in (x - 1, x, x + 1):
            for b in (y - 1, y, y + 1):
                for c in (z - 1, z, z + 1):
                    for m in spots.get((a, b, c), ()):
                        q = crossings[m][2]
                        u, v, w = p[0] - q[0], p[1] - q[1], p[2] - q[2]
                        if math.sqrt(u * u + v * v + w * w) <= reach:
                            mine.add(m)
                            self.near[m].add(k)
        spots.setdefault((x, y, z), []).append(k)

    def _split(self, some: Iterable[int]) -> list[set[int]]:
        near, left, parts = self.near, set(some), []
        while left:
            todo = [left.pop()]
            part = set(todo)
            while todo and left:
                more = near[todo.pop()] & left
                left -= more
                part |= more
                todo += more
            parts.append(part)
        return parts

    def _clusters(self) -> list[list[int]]:
        """Crossings in play, peeled: the largest cluster stays and takes out what shares a ray with it, until none is left."""
        crossings = self.crossings
        for k in crossings:
            if k not in self.near:
                self._place(k)
        names = [k for k, c in crossings.items() if c[5]]
        by_ray: dict[int, list[int]] = {}
        for k in names:
            for r in crossings[k][:2]:
                by_ray.setdefault(r, []).append(k)
        part_of: dict[int, set[int]] = {}
        order: list[tuple[int, int]] = []

        def add(parts: list[set[int]]) -> None:
            for p in parts:
                least = min(p)
                heapq.heappush(order, (-len(p), least))
                part_of.update(dict.fromkeys(p, p))

        add(self._split(names))
        kept = []
        while order:
            size, least = heapq.heappop(order)
            first = part_of.get(least)
            if first is None or (-len(first), min(first)) != (size, least):
                continue  # was split or went since
            kept.append(sorted(first))
            for k in first:
                del part_of[k]
            gone = {m for k in first for r in crossings[k][:2] for m in by_ray[r] if m in part_of}
            broken = {id(part_of[k]): part_of[k] for k in gone}
            for k in gone:
                del part_of[k]
                crossings[k] = (*crossings[k][:5], False)
            for p in broken.values():
                add(self._split(p - gone))
        return kept

    def centre(self, held: Iterable[int]) -> Point:
        points = [self.crossings[k][2] for k in held]
        return points[0] if len(points) == 1 else tuple(_middle(c) for c in zip(*points))

    def _pooled(self, frame: int, found: list[list[int]]) -> set[int]:
        """Candidates that the clusters of a frame have changed or begun."""
        fresh, radius, reach, centres = set(), self.rules.radius, self.rules.update_reach, {}
        for cluster in found:
            held, known = set(cluster), tuple(cluster)
            at = centres[known] = self.centres.get(known) or self.centre(cluster)
            for i, c in self.pool.items():
                d = math.dist(c.centre, at)
                if d >= radius or d >= reach and d > 0:  # a candidate of the same crossings is at the same place
                    continue
                if c.held == held:
                    break
                if d < reach:
                    for k in c.held:
                        if not self.crossings[k][5]:
                            self.crossings[k] = (*self.crossings[k][:5], True)
                    c.held |= held
                    for k in c.held:
                        for r in self.crossings[k][:2]:
                            self._play(r, True)
                    c.centre, c.last, c.missing = self.centre(c.held), frame, 0
                    fresh.add(i)
                    break
            else:
                self.pool[self.next_candidate] = Candidate(held, at, frame)
                fresh.add(self.next_candidate)
                self.next_candidate += 1
        self.centres = centres
        return fresh

    def advance(self, frame: int, rays: list[tuple]) -> list[tuple]:
        """Follow one frame; ``rays``: id, origin and direction (6 numbers), area.  Returns the candidates that leave the pool."""
        earlier = any(self.cells.values())  # a stream loads empty ones, too
        for ray, way, area in rays:
            self.rays[ray] = (frame, tuple(map(float, way)), area, True)
        if earlier:
            self._meet(frame, sorted(r[0] for r in rays))
        for ray, _, _ in rays:
            self._play(ray, True)
        fresh, out = self._pooled(frame, self._clusters()), []
        for i in sorted(self.pool):
            if i in fresh:
                continue
            c = self.pool[i]
            c.missing += 1
            if c.missing > self.rules.limit:
                out.append(self.told(i))
                for k in c.held:
                    self.crossings[k] = (*self.crossings[k][:5], False)
                    for r in self.crossings[k][:2]:
                        self._play(r, False)
                del self.pool[i]
        if out:
            self._forget()
        return out

    def _forget(self) -> None:
        """Drop crossings of no candidate, and rays out of play that none of the others has."""
        held = set().union(*(c.held for c in self.pool.values())) if self.pool else set()
        for k in self.crossings.keys() - held:
            p = self.crossings.pop(k)[2]
            for m in self.near.pop(k, ()):
                self.near[m].discard(k)
            spot = tuple(math.floor(v / self.rules.reach) for v in p)
            if k in (here := self.spots.get(spot, [])):
                here.remove(k)
                if not here:
                    del self.spots[spot]
        used = {r for c in self.crossings.values() for r in c[:2]}
        self.rays = {r: v for r, v in self.rays.items() if v[3] or r in used}

    def told(self, i: int) -> tuple:
        c = self.pool[i]
        some = [self.crossings[k] for k in sorted(c.held)]
        held = [(a, b, *map(float, p), length, gap) for a, b, p, length, gap, _ in some]
        return (i, *map(float, c.centre), len(some), fmean(x[3] for x in some), fmean(x[4] for x in some), c.last, c.missing, held)

    def rest(self) -> list[tuple]:
        """Candidates that are still active, at the end of a trajectory."""
        return [self.told(i) for i in sorted(self.pool)]


_NAMES = [c.split()[0] for c in RESULT.split(", ")[:-1]] + ["held"]
_FIELDS = [c.split(":")[0] for c in HELD.removeprefix("array<struct<").split(",")]


def _frame(trajectory: int, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(trajectory, *r[:-1], [dict(zip(_FIELDS, h)) for h in r[-1]]) for r in rows], columns=_NAMES)


def flat_rays(rays: DataFrame) -> DataFrame:
    """``RAYS`` of ``trajectory, frame, ray_id, origin, direction`` and, if it is there, ``mask_area``; a null ``ray_id`` stands for a frame without rays."""
    area = F.col("mask_area").cast("double") if "mask_area" in rays.columns else F.lit(None).cast("double")
    ways = [F.col(f"{v}.{c}").cast("double").alias(f"{n}{c}") for v, n in (("origin", "o"), ("direction", "d")) for c in "xyz"]
    return rays.select(*[F.col(c).cast("bigint").alias(c) for c in ("trajectory", "frame", "ray_id")], *ways, area.alias("area"))


def _batch(rows: list[tuple[int, tuple]]) -> pa.RecordBatch:
    """:data:`RESULT` of trajectories with what :meth:`Trajectory.told` says of their candidates."""
    held = [r[-1] for _, r in rows]
    flat = [h for some in held for h in some]
    kinds = [pa.int64()] * 2 + [pa.float64()] * 5
    fields = pa.StructArray.from_arrays([pa.array([h[i] for h in flat], kind) for i, kind in enumerate(kinds)], _FIELDS)
    offsets = np.concatenate([[0], np.cumsum([len(some) for some in held])]).astype(np.int32)
    kinds = [pa.int64()] + [pa.float64()] * 3 + [pa.int64()] + [pa.float64()] * 2 + [pa.int64()] * 2
    told = [pa.array([r[i] for _, r in rows], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.int64()), *told, pa.ListArray.from_arrays(pa.array(offsets), fields)], names=_NAMES)


def _frames(rows: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, int, list[tuple]]]:
    """Trajectory, frame and rays of each frame of sorted rows (:data:`RAYS`)."""
    names = [c.split()[0] for c in RAYS.split(", ")]
    trajectory, frame, ray, *way, area = (rows.column(c).to_pylist() for c in names)
    way = list(zip(*way))
    at, n = 0, len(ray)
    while at < n:
        t, f, some = trajectory[at], frame[at], []
        while at < n and frame[at] == f and trajectory[at] == t:
            if ray[at] is not None:
                some.append((ray[at], tuple(math.nan if v is None else v for v in way[at]) if None in way[at] else way[at], area[at]))
            at += 1
        yield t, f, some


def followed(rays: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Candidates (``RESULT``) of a table of rays as :func:`flat_rays` takes them.

    A trajectory is followed in one task, as each of its frames depends on
    those before; the task reads its sorted rows batch by batch and holds what
    is in play.  Rows without a trajectory or frame are left out.
    """

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[tuple]]]:
        last: tuple[int, int, list[tuple]] | None = None  # may go on in the next batch
        for batch in batches:
            for trajectory, frame, some in _frames(batch):
                if last is not None and last[:2] == (trajectory, frame):
                    last[2].extend(some)
                    continue
                if last is not None:
                    yield last
                last = (trajectory, frame, some)
        if last is not None:
            yield last

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on, state, ready, size = None, Trajectory(rules), [], 0
        for trajectory, frame, some in frames(batches):
            out = []
            if trajectory != on:
                out += [(on, r) for r in state.rest()]
                on, state = trajectory, Trajectory(rules)
            out += [(on, r) for r in state.advance(frame, some)]
            ready += out
            size += sum(len(r[-1]) for _, r in out)
            if size >= GATHERED:
                yield _batch(ready)
                ready, size = [], 0
        ready += [(on, r) for r in state.rest()]
        if ready:
            yield _batch(ready)

    tasks = int(rays.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that few bytes don't end in one task
    dealt = flat_rays(rays).dropna(subset=["trajectory", "frame"]).repartition(tasks, "trajectory").sortWithinPartitions("trajectory", "frame", "ray_id")
    return dealt.mapInArrow(follow, RESULT)


class Follower(StatefulProcessor):
    """Follows trajectories of a stream; see :func:`followed_stream`."""

    def __init__(self, rules: Rules, silence_ms: int):
        self.rules, self.silence_ms = rules, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rays = handle.getMapState("rays", "ray bigint", "frame bigint, way array<double>, area double, playing boolean")
        self.cells = handle.getMapState("cells", "x bigint, y bigint, z bigint", "rays array<bigint>")
        self.crossings = handle.getMapState("crossings", "crossing bigint", "ray_a bigint, ray_b bigint, point array<double>, length double, gap double, playing boolean")
        self.pool = handle.getMapState("candidates", "candidate bigint", "held array<bigint>, last bigint, missing bigint")
        self.counts = handle.getValueState("counts", "next_crossing bigint, next_candidate bigint")

    def _load(self, cells: set[tuple[int, int, int]]) -> Trajectory:
        """The trajectory's candidates and crossings, and the rays of these and of some cells."""
        state = Trajectory(self.rules)
        if self.counts.exists():
            state.next_crossing, state.next_candidate = self.counts.get()
        for (k,), v in self.crossings.iterator():
            state.crossings[k] = (v[0], v[1], tuple(v[2]), v[3], v[4], v[5])
        for (k,), v in sorted(self.pool.iterator(), key=lambda e: e[0][0]):  # in the order of their numbers, as they began
            state.pool[k] = Candidate(set(v[0]), state.centre(v[0]), v[1], v[2])
        wanted = {r for c in state.crossings.values() for r in c[:2]}
        wanted |= {r for c in cells if self.cells.containsKey(c) for r in self.cells.getValue(c)[0]}
        todo = sorted(wanted)
        for r in todo:
            frame, way, area, playing = self.rays.getValue((r,))
            state.rays[r] = (frame, tuple(way), area, playing)
        for c in cells | {self.rules.cell(v[1][:3]) for v in state.rays.values()}:  # whole cells, as they are written whole
            told = self.cells.getValue(c)[0] if self.cells.containsKey(c) else []
            state.cells[c] = set(told)
            for r in told:
                if r not in state.rays:
                    frame, way, area, playing = self.rays.getValue((r,))
                    state.rays[r] = (frame, tuple(way), area, playing)
        return state

    def _save(self, state: Trajectory, before: Trajectory) -> None:
        """Write what has changed."""
        for name, entry in (("rays", lambda v: (v[0], list(v[1]), v[2], v[3])), ("crossings", lambda v: (v[0], v[1], list(v[2]), v[3], v[4], v[5])), ("pool", lambda v: (sorted(v.held), v.last, v.missing))):
            kept, now, old = getattr(self, name), getattr(state, name), getattr(before, name)
            for k in old.keys() - now.keys():
                kept.removeKey((k,))
            for k, v in now.items():
                if k not in old or entry(v) != entry(old[k]):
                    kept.updateValue((k,), entry(v))
        for c in state.cells.keys() | before.cells.keys():
            rays = state.cells.get(c, set())
            if rays != before.cells.get(c, set()):
                if rays:
                    self.cells.updateValue(c, (sorted(rays),))
                else:
                    self.cells.removeKey(c)
        self.counts.update((state.next_crossing, state.next_candidate))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values(["frame", "ray_id"]).dropna(subset=["frame"])
        frames = list(_frames(pa.Table.from_pandas(rows, pa.schema([(c.split()[0], pa.int64() if c.endswith("bigint") else pa.float64()) for c in RAYS.split(", ")]), preserve_index=False)))
        cells = {(x + i, y + j, z + k) for _, _, some in frames for _, w, _ in some for x, y, z in [self.rules.cell(w[:3])] for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)}
        state = self._load(cells)
        before = Trajectory(self.rules, dict(state.rays), dict(state.crossings), {i: Candidate(set(c.held), c.centre, c.last, c.missing) for i, c in state.pool.items()})
        before.cells = {c: set(r) for c, r in state.cells.items()}
        out = [r for _, frame, some in frames for r in state.advance(frame, some)]
        self._save(state, before)
        if timerValues.getCurrentProcessingTimeInMs() > 0:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t if isinstance(t, int) else t[-1])
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silence_ms)
        if out:
            yield _frame(int(key[0]), out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The trajectory has ended: what is active comes out, and its state goes."""
        out = self._load(set()).rest()
        for state in (self.rays, self.cells, self.crossings, self.pool, self.counts):
            state.clear()
        if out:
            yield _frame(int(key[0]), out)

    def close(self) -> None:
        pass


def followed_stream(rays: DataFrame, rules: Rules = Rules(), silence_ms: int = 600_000) -> DataFrame:
    """The same of a stream: candidates come out when they leave the pool, the active ones when a trajectory has had no rows for ``silence_ms``.

    Frames of a trajectory must come in order, rows of a frame in one batch.
    Needs a state store with column families (RocksDB).  A trajectory that
    goes on after it ended begins anew.
    """
    return flat_rays(rays).dropna(subset=["trajectory"]).groupBy("trajectory").transformWithStateInPandas(Follower(rules, silence_ms), RESULT, "append", "processingTime")


def merged_places(found: DataFrame, reach: float = 1.0) -> DataFrame:
    """Candidates whose places are joined by steps of at most ``reach`` as one, made anew from all their crossings; ``last_seen`` is the latest, ``missing`` the least."""
    told = stored(found.withColumn("node", F.struct("trajectory", "candidate")), "followed")
    named = clusters(told.select("node", "x", "y", "elevation"), "node", ("x", "y", "elevation"), reach)
    met = told.join(named, "node")
    each = met.select("component", "trajectory", "last_seen", "missing", F.explode("held").alias("h")).select("component", "trajectory", "last_seen", "missing", "h.*")
    seen = each.groupBy("component").agg(F.max("last_seen").alias("last_seen"), F.min("missing").alias("missing"))
    once = each.dropDuplicates(["component", "trajectory", "ray_a", "ray_b"]).groupBy("component").agg(
        *[F.median(c).alias(n) for c, n in (("x", "x"), ("y", "y"), ("z", "elevation"))],
        F.count("*").alias("intersections"),
        F.avg("length").alias("mean_intersection_length"),
        F.avg("gap").alias("mean_intersection_dist"),
    )
    return once.join(seen, "component").drop("component")
