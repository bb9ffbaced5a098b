"""Patches along axes that are too long to list their windows for each voxel."""

import pytest
from pyspark.sql import functions as F

from latticeworks.operators import grid

LONG = 1_600_000_000


@pytest.fixture(scope="module")
def assigned(spark):
    shape = spark.createDataFrame([(20, LONG, 24)], "nz int, ny int, nx int")
    voxels = spark.createDataFrame([(9, LONG - 5, 3, 1.5), (0, 0, 0, 2.0), (19, 12, 23, 3.0)], "z int, y int, x int, density double")
    return grid.assign_patches(voxels, shape, 16, 8)


def test_contents(assigned):
    per = (LONG - 16) // 8 + 1
    got = {tuple(r) for r in assigned.select("z", "ib", "jb", "kb", "patch").collect()}
    want = set()
    for z, y, x in ((9, LONG - 5, 3), (0, 0, 0), (19, 12, 23)):
        for ib in (0, 8):
            for jb in range(max(0, y - 24) // 8 * 8, min(y, LONG - 16) + 1, 8):
                for kb in (0, 8):
                    if all(b <= v < b + 16 for b, v in ((ib, z), (jb, y), (kb, x))):
                        want.add((z, ib, jb, kb, (ib // 8 * per + jb // 8) * 2 + kb // 8))
    assert got == want


def test_merge_by_certainty(assigned):
    rows = assigned.withColumn("prob", F.col("patch") % 7 / 10)
    got = {(r["z"], r["patch"]) for r in grid.merge_by_certainty(rows).collect()}
    best = {}
    for r in rows.collect():
        rank = (-abs(r["prob"] - 0.5), r["patch"])
        best[r["z"]] = min(best.get(r["z"], rank), rank)
    assert got == {(z, rank[1]) for z, rank in best.items()}


def test_merge_by_confidence(assigned):
    rows = assigned.withColumn("probs", F.array(F.col("patch") % 5 / 1.0, F.col("patch") % 3 / 1.0))
    got = {(r["z"], r["patch"]) for r in grid.merge_by_confidence(rows).collect()}
    best = {}
    for r in rows.collect():
        rank = (-max(r["probs"]), r["patch"])
        best[r["z"]] = min(best.get(r["z"], rank), rank)
    assert got == {(z, rank[1]) for z, rank in best.items()}
