"""The staged run: what a manifest keeps, and a run from map files to atoms that ends early and is taken up again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeworks.jobs import reconstruct as R
from latticeworks.operators import grid
from latticeworks.sources import maps


def test_manifest_keeps_whole_stages_only(spark, tmp_path):
    numbers = lambda n: lambda: spark.range(n)
    run = R.Manifest(spark, str(tmp_path))
    assert run.stage("a", 1, numbers(3)).count() == 3
    with pytest.raises(Exception, match="lost"):
        run.stage("b", 1, lambda: spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("id")))
    again = R.Manifest(spark, str(tmp_path))
    assert again.stage("a", 1, numbers(9)).count() == 3 and again.stage("b", 1, numbers(5)).count() == 5 and again.built == ["b"]
    kept = R.Manifest(spark, str(tmp_path))
    assert kept.stage("a", 1, numbers(9)).count() == 3 and kept.stage("b", 1, numbers(9)).count() == 5 and kept.built == []
    other = R.Manifest(spark, str(tmp_path))
    assert other.stage("a", 2, numbers(4)).count() == 4 and other.stage("b", 1, numbers(6)).count() == 6 and other.built == ["a", "b"]


def test_each_map_by_its_own_quantile(spark):
    draw = np.random.default_rng(5)
    arrays = {"a": draw.random(37) * 9, "b": draw.random(4) + 2, "none": np.zeros(3)}
    rows = spark.createDataFrame([(k, i, float(v)) for k, a in arrays.items() for i, v in enumerate(a)], "map_id string, i int, density double")
    got = {(r["map_id"], r["i"]): r["normalized"] for r in grid.normalize_each(rows, ["map_id"], 1.0).collect()}
    want = {(k, i): float(np.clip((v - 1) / (np.percentile(a[a > 1], 95) - 1), 0, 1)) for k, a in arrays.items() if (a > 1).any() for i, v in enumerate(a)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def beads(origin):
    """A map of 2 x 2 x 2 beads on a line, 12 apart, joined by a thin tube, and a speck of dust."""
    a = np.zeros((10, 10, 44), np.float32)
    a[4:6, 4:6, 2:42] = 2.0
    for k in range(4):
        a[4:6, 4:6, 3 + 12 * k : 5 + 12 * k] = 9.0 + k * 0.01
    a[0, 9, 0] = 9.0
    m = {"nz": 10, "ny": 10, "nx": 44, "mode": 2, "axes": (1, 2, 3), "origin": origin, "spacing": (1.0, 1.0, 1.0), "big": False}
    return maps._header_bytes(m) + a.tobytes()


def test_a_run_that_ends_between_stages(spark, tmp_path):
    (tmp_path / "maps").mkdir()
    for name, origin in (("m1", (5.0, -3.0, 2.0)), ("m2", (0.5, 0.5, 0.5)), ("other", (1.0, 1.0, 1.0))):
        (tmp_path / "maps" / f"{name}.mrc").write_bytes(beads(origin))
    sequences = spark.createDataFrame([("m1", "GCAU"), ("m2", "GAUC")], "map_id string, sequence string")
    calls = []

    def broken(prepared):
        raise RuntimeError("the machine is gone")

    def predict(prepared):
        calls.append(1)
        return prepared.withColumn("label", F.lit(1))

    def go(f, run):
        return R.reconstruct(spark, str(tmp_path / "run"), str(tmp_path / "maps"), sequences, f, None, 1.0, 5.0, 1.0, run=run)

    first, second, third = (R.Manifest(spark, str(tmp_path / "run")) for _ in range(3))
    with pytest.raises(RuntimeError):
        go(broken, first)
    assert first.built == ["grids", "residues", "prepared"]
    out = go(predict, second)
    assert second.built == ["labels", "sites", "pairs", "backbone", "report", "featured", "documents", "atoms"] and len(calls) == 1
    prepared = out["prepared"].groupBy("map_id").agg(F.max("density").alias("top"), F.min("z").alias("low"), F.count("*").alias("n")).collect()
    assert {(r["map_id"], r["top"], r["low"], r["n"]) for r in prepared} == {("m1", 1.0, 4, 160), ("m2", 1.0, 4, 160)}
    sites = {m: sorted(r["x"] for r in out["backbone"].where(F.col("map_id") == m).collect()) for m in ("m1", "m2")}
    assert len(sites["m1"]) == 4 and np.allclose(np.array(sites["m1"]) - 5.0, np.array(sites["m2"]) - 0.5)
    assert {(r["map_id"], r["residue_num"]): r["n"] for r in out["atoms"].groupBy("map_id", "residue_num").agg(F.count("*").alias("n")).collect()} == {(m, k + 1): {"A": 22, "G": 23, "C": 20, "U": 20}[b] for m, s in (("m1", "GCAU"), ("m2", "GAUC")) for k, b in enumerate(s)}
    rows = sorted(map(tuple, out["atoms"].collect()))
    assert sorted(map(tuple, go(broken, third)["atoms"].collect())) == rows and third.built == []
