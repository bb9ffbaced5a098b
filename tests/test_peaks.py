"""Block-wise greedy maxima and flooding against one sequence over the whole grid, and the ways to place sites."""

import heapq
import random

import numpy as np
import pytest

from latticeworks.operators import peaks

OFFSETS = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if 0 < abs(a) + abs(b) + abs(c) < 3]


def grid_of(seed, shape=(14, 9, 11), share=0.7, levels=6):
    rng = random.Random(seed)
    return {(z, y, x): float(rng.randrange(levels)) for z in range(shape[0]) for y in range(shape[1]) for x in range(shape[2]) if rng.random() < share}


def greedy(d, separation, keep=None):
    out = []
    for p in sorted(d, key=lambda p: (-d[p], p)):
        if all(sum((a - b) ** 2 for a, b in zip(p, q)) >= separation**2 - 1e-9 for q in out):
            out.append(p)
    return out[:keep]


def drowned(level, seeds):
    best, queue, done = {s: (level[s], 0, n) for s, n in seeds.items()}, [], set()
    queue = [(*c, p) for p, c in best.items()]
    heapq.heapify(queue)
    while queue:
        h, s, b, p = heapq.heappop(queue)
        if p in done:
            continue
        done.add(p)
        for o in OFFSETS:
            q = tuple(a + c for a, c in zip(p, o))
            if q in level and q not in seeds and q not in done:
                new = (level[q], 0, b) if level[q] > h else (h, s + 1, b)
                if q not in best or new < best[q]:
                    best[q] = new
                    heapq.heappush(queue, (*new, q))
    return {p: c[2] for p, c in best.items()}


@pytest.mark.parametrize("edge", [4, 7, 48])
def test_spaced_maxima_equal_one_sequence(spark, edge):
    grids = {k: grid_of(k, levels=levels) for k, levels in ((1, 3), (2, 200))}
    rows = spark.createDataFrame([(k, *p, v) for k, d in grids.items() for p, v in d.items()], "k int, z int, y int, x int, density double").repartition(3)
    rounds = []
    got = peaks.spaced_maxima(rows, ["k"], 3.0, edge, rounds).collect()
    for k, d in grids.items():
        assert sorted((r["z"], r["y"], r["x"]) for r in got if r["k"] == k) == sorted(greedy(d, 3.0))
    assert len(rounds) > 2 or edge == 48


@pytest.mark.parametrize("edge", [3, 5, 48])
def test_flood_equals_one_task(spark, edge):
    rows, expected = [], {}
    for k, levels in ((1, 2), (2, 5), (3, 1000)):
        d = {(z - 4, y, x): v for (z, y, x), v in grid_of(10 + k, share=0.55, levels=levels).items()}
        seeds = {p: n + 1 for n, p in enumerate(greedy(d, 5.0, 6))}
        level = {p: int(1000 - v) for p, v in d.items()}
        rows += [(k, *p, level[p], seeds.get(p)) for p in d]
        expected |= {(k, *p): b for p, b in drowned(level, seeds).items()}
    frame = spark.createDataFrame(rows, "k int, z int, y int, x int, level int, seed int").repartition(3)
    rounds = []
    got = {(r["k"], r["z"], r["y"], r["x"]): r["basin"] for r in peaks.flood(frame, ["k"], edge, rounds).collect()}
    assert got == expected and (len(rounds) > 2 or edge == 48)
    assert peaks.flood(frame.limit(0), ["k"], edge).count() == 0


def blob(cy, cx, tall=10.0, reach=3):
    return {(z, y, x): tall - abs(z) - abs(y - cy) - abs(x - cx) for z in range(-reach, reach + 1) for y in range(cy - reach, cy + reach + 1) for x in range(cx - reach, cx + reach + 1)}


def test_ways_of_placing_sites(spark):
    clusters = {
        "centre": (blob(0, 0), 1),
        "flood": ({**blob(0, 8, 9.5), **blob(0, 0)} | {(0, 0, x): 3.0 for x in (4,)}, 2),
        "exclusion": ({(0, 0, x): 10.0 - x for x in range(6)}, 3),
        "k-means": ({(0, 0, 0): 1.0, (0, 0, 1): 2.0, (0, 0, 2): 1.5}, 3),
    }
    rows = [(name, *p, v, n) for name, (d, n) in clusters.items() for p, v in d.items()]
    frame = spark.createDataFrame(rows, "k string, z int, y int, x int, density double, n int")
    got = peaks.cluster_sites(frame, ["k"], edge=5).collect()
    assert {name: sorted({r["way"] for r in got if r["k"] == name}) for name in clusters} == {name: [name] for name in clusters}
    assert {name: sorted(r["peak"] for r in got if r["k"] == name) for name in clusters} == {name: list(range(1, n + 1)) for name, (_, n) in clusters.items()}
    flooded = sorted((r["x"], r["y"], r["z"]) for r in got if r["k"] == "flood")
    assert [round(x) for x, _, _ in flooded] == [0, 8]
    d, n = clusters["exclusion"]
    assert sorted((r["z"], r["y"], r["x"]) for r in got if r["k"] == "exclusion") == sorted(greedy(d, 2.0, n))
    centre = next(r for r in got if r["k"] == "centre")
    assert np.allclose([centre["z"], centre["y"], centre["x"]], 0)
