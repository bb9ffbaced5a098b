"""Sinks: fixed-width atoms, atom_site rows, JSON documents, label grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(lines: DataFrame, path: str, head: tuple[str, ...] = (), tail: tuple[str, ...] = ("TER", "END")) -> None:
    """Lines (serial, line) in order between ``head`` and ``tail``, as text parts that read in order by name.

    The lines are range-partitioned by serial, so no task writes them all; a single file is the concatenation of parts.
    """
    spark = lines.sparkSession
    edge = lambda texts, start: spark.createDataFrame([(start + k, t) for k, t in enumerate(texts)], "serial long, line string")
    whole = lines.select(F.col("serial").cast("long").alias("serial"), "line")
    for texts, start in ((head, -(10**6)), (tail, 2**60)):
        if texts:
            whole = whole.unionByName(edge(texts, start))
    whole.repartitionByRange("serial").sortWithinPartitions("serial").select("line").write.mode("overwrite").text(path)


def nested_model(atoms: DataFrame, keys: list[str]) -> DataFrame:
    """json: one document per key with its residues and their atoms in order."""
    atom = F.struct("atom_ord", F.col("atom").alias("name"), "element", F.round("ax", 3).alias("x"), F.round("ay", 3).alias("y"), F.round("az", 3).alias("z"))
    residues = atoms.groupBy(*keys, "residue_num", "base").agg(F.sort_array(F.collect_list(atom)).alias("atoms"))
    model = residues.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("residue_num", "base", "atoms"))).alias("residues"))
    return model.select(*keys, F.to_json(F.struct(F.size("residues").alias("n_residues"), "residues")).alias("json"))


def pair_document(pairs: DataFrame, keys: list[str], model: str = "greedy") -> DataFrame:
    """json: one pair document per key, 0-based, pairs in order."""
    p = F.sort_array(F.collect_list(F.struct("i", "j", "prob", "type", "canonical")))
    return pairs.groupBy(*keys).agg(p.alias("base_pairs")).select(*keys, F.to_json(F.struct(F.lit(model).alias("model"), F.lit(0).alias("index_base"), F.lit(1).alias("first_residue"), "base_pairs")).alias("json"))


def registration_document(sites: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """json: the sites of each key and the residues of ``expected`` (keys, residue_num) that none covers."""
    gaps = expected.join(sites.select(*keys, "residue_num"), [*keys, "residue_num"], "left_anti").groupBy(*keys).agg(F.sort_array(F.collect_list("residue_num")).alias("uncovered"))
    own = sites.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("residue_num", "base", F.array(*[F.round(a, 3) for a in "xyz"]).alias("position")))).alias("p_atoms"))
    return own.join(gaps, keys, "left").select(*keys, F.to_json(F.struct("p_atoms", F.coalesce("uncovered", F.array().cast("array<int>")).alias("uncovered"))).alias("json"))


def write_grid(voxels: DataFrame, path: str, block: int = 64) -> None:
    """Voxels as Parquet, partitioned by map and block of planes, so that a box reads only what it touches."""
    placed = voxels.withColumn("block", F.floor(F.col("z") / block).cast("int"))
    placed.repartition("map_id", "block").sortWithinPartitions("z", "y", "x").write.mode("overwrite").partitionBy("map_id", "block").parquet(path)


def copy_structure(spark, source: str, target: str) -> None:
    """The lines of a fixed-width structure as they are; a file without any atom record is an error."""
    lines = spark.read.text(source)
    if lines.where(F.col("value").rlike("^(ATOM|HETATM)")).isEmpty():
        raise ValueError(f"no atom record in {source}")
    lines.write.mode("overwrite").text(target)
