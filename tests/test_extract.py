"""The extraction job against a plain version over small maps: every way of placing, the fallback and the repair."""

import random

import numpy as np
import pytest
from test_golden import brute_allocation
from test_peaks import OFFSETS, drowned, greedy
from test_repair import plain as plain_repair

from latticeworks.jobs.extract import checked, extract_sites


def bodies(d):
    """18-connected clusters, by their first voxel."""
    left, out = set(d), {}
    while left:
        first = min(left)
        body, edge = {first}, [first]
        while edge:
            p = edge.pop()
            for o in OFFSETS:
                q = tuple(a + b for a, b in zip(p, o))
                if q in left and q not in body:
                    body.add(q)
                    edge.append(q)
        out[first] = body
        left -= body
    return out


def center(d, body):
    w = np.array([max(d[p], 0) for p in body])
    return tuple(np.average(np.array(list(body), float), axis=0, weights=w if w.sum() > 0 else None))


def flooded(d, body, n):
    own = {p: d[p] for p in body}
    seeds, top = greedy(own, 3.0, n), max(own.values())
    if len(seeds) < n or top <= 0:
        return None
    basins = drowned({p: int((top - v) / top * 60000) for p, v in own.items()}, {p: k + 1 for k, p in enumerate(seeds)})
    centres = [center(d, [p for p in basins if basins[p] == k + 1]) for k in range(n)]
    near = min(np.linalg.norm(np.subtract(a, b)) for i, a in enumerate(centres) for b in centres[:i])
    return centres if near >= 3.5 else None


def maxima(d, separation):
    r = int(separation)
    local = {p: v for p, v in d.items() if not any(d.get((p[0] + a, p[1] + b, p[2] + c), -1e9) > v for a in range(-r, r + 1) for b in range(-r, r + 1) for c in range(-r, r + 1))}
    return greedy(local, separation)


def closest(sites):
    return min((np.linalg.norm(np.subtract(a, b)) for i, a in enumerate(sites) for b in sites[:i]), default=np.inf)


def plain(d, target):
    """(position, way, phase) of each site of one map, or None where k-means is needed."""
    parts = bodies(d)
    firsts = sorted(parts)
    volumes = [len(parts[f]) for f in firsts]
    if not any(v >= 10 for v in volumes):
        return []
    unit = sum(v for v in volumes if v >= 10) / target
    alloc = brute_allocation([0 if v < 10 else max(1, int(np.rint(v / unit))) for v in volumes], volumes, unit, target)
    sites = []
    for f, n in zip(firsts, alloc):
        if n == 1:
            sites.append((center(d, parts[f]), f, "centre"))
        elif n > 1:
            found = flooded(d, parts[f], n)
            way = "flood"
            if found is None:
                found, way = greedy({p: d[p] for p in parts[f]}, 2.0, n), "exclusion"
            if len(found) < n:
                return None
            sites += [(tuple(map(float, p)), f, way) for p in found]
    if len(sites) == target > 1 and closest([s[0] for s in sites]) < 2.5 - 1e-6:
        strict = maxima(d, 2.5)[:target]
        if len(strict) == target:
            owner = {p: f for f in firsts for p in parts[f]}
            sites = [(tuple(map(float, p)), owner[p], "suppression") for p in strict]
    at = lambda p: d.get(tuple(int(x) for x in p), 0.0)
    free = [p for p in sorted(maxima(d, 3.0), key=lambda p: (-d[p], p))]
    moved, phases = plain_repair(np.array([s[0] for s in sites]).reshape(-1, 3), np.array([at(s[0]) for s in sites]), [firsts.index(s[1]) for s in sites], np.array(free, float), np.array([d[p] for p in free]))
    return [(tuple(np.round(p, 6)), s[2], ph) for p, s, ph in zip(moved, sites, phases)]


def map_of(seed):
    rng = random.Random(seed)
    d = {}
    for _ in range(rng.randrange(2, 14)):
        c, r, tall = [rng.randrange(0, 26) for _ in range(3)], rng.choice([1, 2, 2, 3]), rng.uniform(0.5, 2)
        for o in np.ndindex(2 * r + 1, 2 * r + 1, 2 * r + 1):
            p = tuple(a + b - r for a, b in zip(c, o))
            far = sum((a - b) ** 2 for a, b in zip(p, c))
            if far <= r * r + 1:
                d[p] = max(d.get(p, 0.0), round(tall - 0.1 * far + rng.random() * 0.01, 6))
    return d, max(1, round(len(d) / rng.choice([9, 14, 30])))


@pytest.fixture(scope="module")
def maps():
    made = {k: map_of(k) for k in range(24)}
    ring = {(0, y, x): 1.0 + 0.01 * (y + 9 * x) for y in range(-4, 5) for x in range(-4, 5) if max(abs(y), abs(x)) == 4}
    made[99] = ({**ring, **{(z, y, x): 2.0 - 0.1 * z for z in (0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1)}}, 2)  # both centres coincide
    known = {k: plain(d, t) for k, (d, t) in made.items()}
    made = {k: v for k, v in made.items() if known[k] is not None}
    return made, {k: known[k] for k in made}


def test_sites_equal_plain_version(spark, maps):
    made, expected = maps
    voxels = spark.createDataFrame([(k, *p, v) for k, (d, _) in made.items() for p, v in d.items()], "map int, z int, y int, x int, density double").repartition(4)
    targets = spark.createDataFrame([(k, t) for k, (_, t) in made.items()], "map int, target int")
    out = extract_sites(voxels, targets, ["map"], edge=9)
    got = {k: [] for k in made}
    for r in out.collect():
        got[r["map"]].append((tuple(np.round([r["z"], r["y"], r["x"]], 6)), r["way"], r["phase"], r["usable"]))
    for k in made:
        assert sorted(g[:3] for g in got[k]) == sorted(expected[k]), k
        assert all(g[3] == (closest([g[0] for g in got[k]]) >= 2.5 - 1e-6) for g in got[k])
    ways = {s[1] for e in expected.values() for s in e}
    assert ways == {"centre", "flood", "exclusion", "suppression"} and {s[2] for e in expected.values() for s in e} >= {-1, 0}
    bad = [k for k in made if got[k] and not got[k][0][3]]
    fine = out.join(spark.createDataFrame([(k,) for k in bad] or [(-1,)], "map int"), "map", "left_anti")
    assert checked(fine, ["map"]).count() == sum(len(v) for k, v in got.items() if k not in bad)
    if bad:
        with pytest.raises(ValueError):
            checked(out, ["map"])
