"""Rays followed frame by frame, against a plain loop over whole lists."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rayloom.streaming import peeling
from rayloom.streaming.peeling import Rules, Trajectory


def plain(frames, rules):
    """Brute force: everything is kept for good, clusters are made anew each time; yields what is active after each frame, and at last all candidates."""
    rays, crossings, cands = [], [], []
    ray_on, cross_on, cand_on = set(), set(), set()

    def meet(a, b):
        p, d, q, e = a[1][:3], a[1][3:], b[1][:3], b[1][3:]
        c = float(d @ e)
        if abs(1 - c * c) < 1e-6:
            return None
        t, s = ((q - p) @ d - ((q - p) @ e) * c) / (1 - c * c), (((q - p) @ d) * c - (q - p) @ e) / (1 - c * c)
        if min(t, s) < 0 or max(t, s) > rules.radius:
            return None
        u, v = p + t * d, q + s * e
        gap, m, low = float(np.linalg.norm(u - v)), (u + v) / 2, min(p[2], q[2])
        if gap > rules.most_gap or rules.height and not low - 3.8 < m[2] < low - 2.0:
            return None
        return m, gap, max(t, s)

    def grouped(some):
        left, out = list(some), []
        while left:
            part = [left.pop(0)]
            for k in part:
                more = [m for m in left if np.linalg.norm(crossings[m][2] - crossings[k][2]) <= rules.reach]
                left = [m for m in left if m not in more]
                part += more
            out.append(part)
        return out

    for frame, some in frames:
        new = []
        for ray, way, area in sorted(some, key=lambda r: r[0]):
            rays.append((frame, np.array(way, float), ray))
            new.append(len(rays) - 1)
        before = len(ray_on)
        ray_on.update(new)
        if before:
            for n in new:
                best = {}
                for o in sorted(ray_on, key=lambda i: rays[i][2]):
                    if rays[o][0] != frame and (got := meet(rays[o], rays[n])) and (rays[o][0] not in best or got[1] < best[rays[o][0]][1][1]):
                        best[rays[o][0]] = (o, got)
                for o, (m, gap, length) in best.values():
                    crossings.append((o, n, m, length, gap))
                    cross_on.add(len(crossings) - 1)
        left, found = sorted(cross_on), []
        while left:
            first = min(grouped(left), key=lambda p: (-len(p), min(p)))
            found.append(first)
            used = {r for k in first for r in crossings[k][:2]}
            gone = [k for k in left if set(crossings[k][:2]) & used]
            cross_on -= set(gone) - set(first)
            left = [k for k in left if k not in gone]
        fresh = set()
        for part in found:
            held, at = set(part), np.median([crossings[k][2] for k in part], axis=0)
            for i in sorted(cand_on):
                d = np.linalg.norm(cands[i]["at"] - at)
                if d < rules.radius and cands[i]["held"] == held:
                    break
                if d < rules.update_reach:
                    cross_on |= cands[i]["held"]
                    cands[i]["held"] |= held
                    ray_on |= {r for k in cands[i]["held"] for r in crossings[k][:2]}
                    cands[i] |= {"at": np.median([crossings[k][2] for k in cands[i]["held"]], axis=0), "last": frame, "missing": 0}
                    fresh.add(i)
                    break
            else:
                cands.append({"at": at, "held": held, "last": frame, "missing": 0})
                cand_on.add(len(cands) - 1)
                fresh.add(len(cands) - 1)
        for i in sorted(cand_on - fresh):
            cands[i]["missing"] += 1
            if cands[i]["missing"] > rules.limit:
                ray_on -= {r for k in cands[i]["held"] for r in crossings[k][:2]}
                cross_on -= cands[i]["held"]
                cand_on.discard(i)
        pairs = lambda c: sorted((rays[crossings[k][0]][2], rays[crossings[k][1]][2]) for k in c["held"])
        yield {i: pairs(cands[i]) for i in cand_on}, {rays[r][2] for r in ray_on}, [(i, *np.round(c["at"], 9), pairs(c), c["last"], c["missing"]) for i, c in enumerate(cands)]


def frames_of(seed, n=40, targets=9, most=6, loop=False):
    """Frames along a road with rays to targets below it, some of them off, some at nothing, and frames without any."""
    rng = random.Random(seed)
    spots = [np.array([rng.uniform(0, n * 1.2), rng.uniform(-5, 5), 0.0]) for _ in range(targets)]
    out, ray = [], 0
    for f in range(n):
        at = np.array([(n - abs(n - 2 * f)) * 0.7 if loop else f * 1.2, 0.3 * rng.random(), 3.0])
        near, some = [s for s in spots if np.linalg.norm(s - at) < 12], []
        for s in rng.sample(near, min(len(near), rng.randrange(most))) if near else []:
            d = s + np.array([rng.gauss(0, 0.04), rng.gauss(0, 0.04), rng.gauss(0, 0.02)]) - at
            some.append((ray, tuple(map(float, (*at, *d / np.linalg.norm(d)))), 50.0))
            ray += 1
        out.append((f, some))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_each_frame_against_a_plain_loop(seed):
    rules = Rules(limit=seed % 4, update_reach=0.6 + 0.2 * (seed % 3), reach=0.3 + 0.1 * (seed % 2))
    frames = frames_of(seed, loop=seed % 2 == 1)
    state, left, changed = Trajectory(rules), [], 0
    for (frame, some), (active, playing, every) in zip(frames, plain(frames, rules), strict=True):
        left += state.advance(frame, some)
        assert {i: sorted(state.crossings[k][:2] for k in c.held) for i, c in state.pool.items()} == {i: [tuple(p) for p in v] for i, v in active.items()}
        assert {r for r, v in state.rays.items() if v[3]} == playing
        changed += len(active)
    got = sorted((r[0], *np.round(r[1:4], 9), sorted(h[:2] for h in r[9]), r[7], r[8]) for r in left + state.rest())
    assert changed and len(got) == len(every)
    assert got == every


def table(spark, seeds):
    rows = []
    for s in seeds:
        for f, some in frames_of(s):
            rows += [(s, f, 1000 * s + r, tuple(w[:3]), tuple(w[3:])) for r, w, _ in some] or [(s, f, None, None, None)]
    kind = "struct<x:double,y:double,z:double>"
    return spark.createDataFrame(rows, f"trajectory bigint, frame bigint, ray_id bigint, origin {kind}, direction {kind}")


def want_of(seeds, rules):
    out = []
    for s in seeds:
        *_, (_, _, every) = plain([(f, [(1000 * s + r, w, a) for r, w, a in some]) for f, some in frames_of(s)], rules)
        out += [(s, i, round(float(x), 6), round(float(y), 6), len(p), last, missing) for i, x, y, _, p, last, missing in every]
    return sorted(out)


def told(rows):
    return sorted((r.trajectory, r.candidate, round(r.x, 6), round(r.y, 6), r.intersections, r.last_seen, r.missing) for r in rows)


def test_on_a_table(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # frames go across batches
    try:
        found = peeling.followed(table(spark, [1, 2, 3]).repartition(5), Rules(limit=2))
        assert told(found.collect()) == want_of([1, 2, 3], Rules(limit=2))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    merged = peeling.merged_places(found, 1.0)
    each = {(r.trajectory, h.ray_a, h.ray_b) for r in found.collect() for h in r.held}
    assert merged.agg(F.sum("intersections")).first()[0] >= len(each) > 0
    assert peeling.followed(table(spark, [1]).limit(0)).count() == 0


def test_on_a_stream(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rules, df = Rules(limit=2), table(spark, [1, 2])
    for k, (low, high) in enumerate([(0, 9), (9, 10), (10, 30), (30, 40)]):  # files are batches of whole frames
        df.filter((F.col("frame") >= low) & (F.col("frame") < high)).coalesce(1).write.parquet(str(tmp_path / "w"), mode="overwrite")
        (tmp_path / "in").mkdir(exist_ok=True)
        part = next((tmp_path / "w").glob("part-*.parquet"))
        part.rename(tmp_path / "in" / f"{k}.parquet")
        time.sleep(0.05)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = peeling.followed_stream(stream, rules, silence_ms=3000).writeStream.format("memory").queryName("followed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        want, end = want_of([1, 2], rules), time.time() + 150
        while time.time() < end and spark.sql("SELECT * FROM followed").count() < len(want):
            assert run.exception() is None
            time.sleep(1)
        assert told(spark.sql("SELECT * FROM followed").collect()) == want
    finally:
        run.stop()
        spark.conf.unset(provider)


def test_a_frame_costs_what_is_in_play():
    """Crossings are placed once, not in each frame; nothing stays of places that a trajectory has left."""
    state, placed = Trajectory(Rules(limit=1)), []
    place = state._place
    state._place = lambda k: (placed.append(k), place(k))
    for frame, some in frames_of(3, n=120, targets=40):
        state.advance(frame, some)
        assert all(state.cells.values())
        assert state.near.keys() == state.crossings.keys() and sum(map(len, state.spots.values())) == len(state.near)
    assert len(placed) == len(set(placed)) == state.next_crossing > 50


def test_a_task_gathers_what_it_gives_out():
    rows = [(7, (i, 1.0, 2.0, 3.0, i % 3, 4.0, 5.0, 6, 0, [(k, k + 1, 1.0, 2.0, 3.0, 4.0, 5.0) for k in range(i % 3)])) for i in range(10)]
    got = peeling._batch(rows).to_pylist()
    assert [tuple(r.values())[:-1] for r in got] == [(t, *r[:-1]) for t, r in rows]
    assert [[tuple(h.values()) for h in r["held"]] for r in got] == [r[-1] for _, r in rows]
