"""Dust and resampling against plain versions on whole arrays."""

import numpy as np
import pytest

from latticeworks.operators import preparation

AXES = ("z", "y", "x")


def frame(spark, arrays):
    rows = [(k, *map(int, p), float(v)) for k, a in arrays.items() for p, v in np.ndenumerate(a) if v]
    return spark.createDataFrame(rows, "map string, z int, y int, x int, density double")


def sizes(spark, arrays):
    return spark.createDataFrame([(k, *a.shape) for k, a in arrays.items()], "map string, nz int, ny int, nx int")


def found(df):
    return {(r["map"], r["z"], r["y"], r["x"]): r["density"] for r in df.collect()}


def plain_resample(a, step):
    out = {}
    for k in np.ndindex(*[int((n - 1) / s + 1e-9) + 1 for n, s in zip(a.shape, step, strict=True)]):
        p = [i * s for i, s in zip(k, step, strict=True)]
        total = 0.0
        for corner in np.ndindex(2, 2, 2):
            at = [int(q) + c for q, c in zip(p, corner, strict=True)]
            if all(i < n for i, n in zip(at, a.shape, strict=True)):
                total += a[tuple(at)] * np.prod([1 - abs(q - i) for q, i in zip(p, at, strict=True)])
        if total:
            out[k] = total
    return out


def plain_dust(a, contour, size, spacing):
    left, out = {tuple(map(int, p)) for p in np.argwhere(a > contour)}, {}
    while left:
        piece, todo = set(), [left.pop()]
        while todo:
            p = todo.pop()
            piece.add(p)
            for d in np.ndindex(3, 3, 3):
                q = tuple(i + j - 1 for i, j in zip(p, d, strict=True))
                if q in left and sum(abs(j - 1) for j in d) <= 2:
                    left.remove(q)
                    todo.append(q)
        span = np.ptp(np.array(list(piece)), axis=0) + 1
        if (span * np.array(spacing)).max() >= size:
            out.update({p: a[p] for p in piece})
    return out


@pytest.fixture(scope="module")
def arrays():
    draw = np.random.default_rng(11)
    return {k: np.round(draw.random(shape) * (draw.random(shape) < share), 3) for k, shape, share in (("a", (9, 7, 8), 0.25), ("b", (4, 12, 5), 0.4), ("one", (2, 2, 2), 1.0))}


@pytest.mark.parametrize("step,edge", [((0.5, 0.5, 0.5), 4), ((1.0, 1.0, 1.0), 3), ((0.471, 0.9, 1.7), 5), ((2.5, 3.0, 0.25), 2), ((0.3, 0.3, 0.3), 32)])
def test_resample(spark, arrays, step, edge):
    got = found(preparation.resample(frame(spark, arrays), sizes(spark, arrays), ["map"], step, edge))
    want = {(k, *p): v for k, a in arrays.items() for p, v in plain_resample(a, step).items()}
    small = {p for p in got.keys() ^ want.keys()}
    assert all(abs(got.get(p, want.get(p))) < 1e-12 for p in small)
    assert all(abs(got[p] - want[p]) < 1e-9 for p in got.keys() & want.keys())


@pytest.mark.parametrize("size,spacing", [(3.0, (1.0, 1.0, 1.0)), (2.0, (1.0, 0.5, 0.25)), (0.0, (1.0, 1.0, 1.0)), (99.0, (1.0, 1.0, 1.0))])
def test_dust(spark, arrays, size, spacing):
    got = found(preparation.without_dust(frame(spark, arrays), ["map"], 0.4, size, spacing))
    assert got == {(k, *p): v for k, a in arrays.items() for p, v in plain_dust(a, 0.4, size, spacing).items()}


def test_prepare(spark, arrays):
    spacing, size, target = (1.0, 0.8, 1.25), 3.0, 0.5
    got = found(preparation.prepare(frame(spark, arrays), sizes(spark, arrays), ["map"], 0.4, spacing, size, target, 4))
    want = {}
    for k, a in arrays.items():
        masked = np.zeros_like(a)
        for p, v in plain_dust(a, 0.4, size, spacing).items():
            masked[p] = v
        fine = np.zeros([int((n - 1) * s / target + 1e-9) + 1 for n, s in zip(a.shape, spacing, strict=True)])
        for p, v in plain_resample(masked, [target / s for s in spacing]).items():
            fine[p] = v
        want.update({(k, *p): v for p, v in plain_dust(fine, 0.4, size, (target,) * 3).items()})
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_empty_and_null(spark):
    rows = spark.createDataFrame([("a", 0, 0, 0, None), ("a", 1, 1, 1, 5.0), ("b", 0, 0, 0, 3.0)], "map string, z int, y int, x int, density double")
    size = spark.createDataFrame([("a", 2, 2, 2)], "map string, nz int, ny int, nx int")
    assert found(preparation.resample(rows, size, ["map"], (1.0, 1.0, 1.0))) == {("a", 1, 1, 1): 5.0}
    assert preparation.resample(rows.limit(0), size, ["map"], (0.5, 0.5, 0.5)).count() == 0
    assert found(preparation.without_dust(rows, ["map"], 1.0, 1.0)) == {("a", 1, 1, 1): 5.0, ("b", 0, 0, 0): 3.0}
    assert preparation.without_dust(rows.limit(0), ["map"], 1.0, 1.0).count() == 0
