"""Fixed-width atoms beyond the decimals of their columns."""

from pyspark.sql import functions as F

from latticeworks.operators import placement
from latticeworks.sources import readers, writers


def test_numbers_keep_their_columns(spark):
    for width, values in ((4, [-999, 0, 9_999, 10_000, 10_000 + 26 * 36**3 - 1, 10_000 + 26 * 36**3, 10_000 + 52 * 36**3 - 1]), (5, [1, 99_999, 100_000, 100_001, 12_000_000, 60_000_000])):
        rows = spark.createDataFrame([(v,) for v in values], "v int").select("v", placement.hybrid36(F.col("v"), width).alias("t"))
        got = rows.select("v", "t", placement.from_hybrid36(F.col("t"), width).alias("back")).collect()
        assert all(len(r["t"]) == width and r["back"] == r["v"] for r in got)
    assert spark.sql("select 100000 as v").select(placement.hybrid36(F.col("v"), 5)).first()[0] == "A0000"


def test_many_atoms_read_back_as_they_were(spark, tmp_path):
    atoms = spark.range(100_300).select(F.lit("C1'").alias("atom"), F.lit("G").alias("base"), F.lit("B").alias("chain"), F.expr("cast(id div 10 as int)").alias("residue_num"), F.expr("cast(id % 10 as int)").alias("atom_ord"), *[(F.col("id") % 1000 / 8).alias(f"a{a}") for a in "xyz"], F.lit("C").alias("element"))
    writers.write_lines(placement.pdb_lines(atoms, ["residue_num", "atom_ord"]), str(tmp_path / "lines"))
    got = readers.read_atoms(spark, str(tmp_path / "lines"))
    wrong = got.where("serial - 1 <> residue_num * 10 + (serial - 1) % 10 or abs(x - (serial - 1) % 1000 / 8) > 0.0005 or element <> 'C' or chain <> 'B'")
    assert got.count() == 100_300 and wrong.isEmpty()
    assert tuple(got.agg(F.max("serial"), F.max("residue_num")).first()) == (100_300, 10_029)
