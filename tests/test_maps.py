"""The map source against plain decoding: modes, axis and byte orders, compressed files, boxes, ranges, bad files."""

import bz2
import gzip
from itertools import permutations

import numpy as np
import pytest

from latticeworks.sources import maps

MODES = (0, 1, 2, 6, 12)


def content(data, mode, axes, big=False, **other):
    """A map file of ``data`` (z, y, x)."""
    nz, ny, nx = data.shape
    m = {"nz": nz, "ny": ny, "nx": nx, "mode": mode, "axes": axes, "origin": (1.0, 2.0, 3.0), "spacing": (0.5, 0.5, 0.5), "big": big, **other}
    turned = np.transpose(data, [3 - a for a in reversed(axes)])
    return maps._header_bytes(m) + turned.astype((">" if big else "<") + maps.KINDS[mode]).tobytes()


@pytest.fixture(scope="module")
def data():
    return np.random.default_rng(3).integers(0, 120, (5, 7, 6)).astype(np.float32)


@pytest.fixture(scope="module")
def folder(tmp_path_factory, data):
    base = tmp_path_factory.mktemp("maps")
    for k, axes in enumerate(permutations((1, 2, 3))):
        for mode in MODES:
            (base / f"m{k}-{mode}.mrc").write_bytes(content(data, mode, axes, big=(k + mode) % 2 == 1))
    (base / "g.map.gz").write_bytes(gzip.compress(content(data, 2, (3, 1, 2))))
    (base / "b.map.bz2").write_bytes(bz2.compress(content(data, 1, (2, 3, 1))))
    return base


def rows(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["path"].rsplit("/", 1)[1], set()).add((r["z"], r["y"], r["x"], r["density"]))
    return out


def plain(data, keep):
    return {(z, y, x, float(v)) for (z, y, x), v in np.ndenumerate(data) if keep(z, y, x, v)}


def test_every_order_mode_and_packing(spark, folder, data):
    got = rows(maps.read_maps(spark, str(folder), floor=None, window=100))
    want = plain(data, lambda *_: True)
    assert len(got) == 32 and all(v == want for v in got.values())
    got = rows(maps.read_maps(spark, f"{folder}/m*.mrc", floor=60.0))
    assert len(got) == 30 and all(v == plain(data, lambda z, y, x, d: d > 60) for v in got.values())


def test_box_and_pushed_filters(spark, folder, data):
    want = plain(data, lambda z, y, x, d: 1 <= z <= 2 and 3 <= y and x <= 4)
    got = rows(maps.read_maps(spark, str(folder), floor=None, box={"z": (1, 2), "y": (3, 99), "x": (-2, 4)}))
    assert len(got) == 32 and all(v == want for v in got.values())
    assert maps.read_maps(spark, str(folder), box={"z": (7, 9)}).count() == 0
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = maps.read_maps(spark, str(folder), floor=None).where("z > 0 and z < 3 and y >= 3 and x <= 4 and density > -1")
        assert all(v == want for v in rows(df).values())
        assert maps.read_maps(spark, f"{folder}/m0-2.mrc", window=1).where("z = 2").rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_ranges_cover_a_file_once(folder):
    every = ((0, 99),) * 3
    parts = maps.ranges(f"{folder}/m0-2.mrc", every, 2 * 7 * 6 * 4)
    assert [(p.lo, p.hi) for p in parts] == [(0, 2), (2, 4), (4, 5)]
    assert [(p.lo, p.hi) for p in maps.ranges(f"{folder}/g.map.gz", every, 1)] == [(0, 7)]


def test_a_range_reads_the_rows_of_its_box_only(folder, monkeypatch):
    read, exactly = [], maps._exactly
    monkeypatch.setattr(maps, "_exactly", lambda file, n: read.append(n) or exactly(file, n))
    part = maps.ranges(f"{folder}/m0-2.mrc", ((0, 99), (2, 3), (1, 2)), 1 << 20)[0]
    assert sum(a.size for _, _, a in part.sections()) == 2 * 2 * 6 and read == [2 * 6 * 4] * 2


def test_bad_files(spark, tmp_path, data):
    good = content(data, 2, (1, 2, 3))
    bad = data.copy()
    bad[4, 0, 0] = np.inf
    turned = bytearray(good)
    turned[64:68] = b"\x02\x00\x00\x00"
    for name, file in {"short": good[:-4], "header": good[:100], "axes": bytes(turned), "infinite": content(bad, 2, (1, 2, 3)), "flat": content(data[:1], 2, (1, 2, 3))}.items():
        (tmp_path / f"{name}.mrc").write_bytes(file)
        with pytest.raises(Exception, match="cut short|permutation|finite|three-dimensional"):
            maps.read_maps(spark, str(tmp_path / f"{name}.mrc")).count()


def test_written_maps(spark, tmp_path, data):
    m = "map_id string, nz int, ny int, nx int, mode int, axes array<int>, origin array<double>, spacing array<double>, big boolean"
    own = [1.0, -2.0, 0.5], [0.5, 0.25, 1.0]
    listed = spark.createDataFrame([("a", 5, 7, 6, 2, [3, 1, 2], *own, True), ("empty", 2, 3, 4, 0, [1, 2, 3], *own, False)], m)
    v = spark.createDataFrame([("a", *p) for p in plain(data, lambda z, y, x, d: d > 100)], "map_id string, z int, y int, x int, density double")
    maps.write_maps(listed, v, str(tmp_path / "out"))
    got, origin, spacing = maps.decode_map((tmp_path / "out" / "a.mrc").read_bytes())
    assert np.array_equal(got, np.where(data > 100, data, 0)) and (origin.tolist(), spacing.tolist()) == own
    grids = {r["path"].rsplit("/", 1)[1]: (r["nz"], r["ny"], r["nx"], r["origin"]) for r in maps.read_grids(spark, str(tmp_path / "out")).collect()}
    assert grids == {"a.mrc": (5, 7, 6, own[0]), "empty.mrc": (2, 3, 4, own[0])}
    with pytest.raises(Exception, match="cannot hold"):
        maps.write_maps(listed.where("map_id = 'empty'"), spark.createDataFrame([("empty", 0, 0, 0, 1.5)], v.schema), str(tmp_path / "no"))


def test_many_small_files_take_several_tasks(spark, tmp_path, data):
    for k in range(100):
        (tmp_path / f"m{k}.mrc").write_bytes(content(data, 2, (1, 2, 3)))
    read = maps.read_maps(spark, str(tmp_path))
    assert read.rdd.getNumPartitions() == 4 and read.count() == 100 * int((data > 0).sum())
