"""Readers: sequences, density maps, backbone and pair documents, fixed-width atoms, the map catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.placement import from_hybrid36
from ..operators.sequences import clean_sequence
from .maps import decode_map, read_grids, read_maps  # noqa: F401

ANCHOR = "struct<label:string,centroid:array<double>,distance_to_p:double,n_voxels:int>"
SITE = f"struct<atom_idx:int,residue_num:int,base:string,position:array<double>,source:string,derive_method:string,sugar_anchor:{ANCHOR},base_anchor:{ANCHOR},map_feature_confidence:double>"
BACKBONE = f"chains array<struct<p_atoms:array<{SITE}>,atoms:array<{SITE}>>>, p_atoms array<{SITE}>, atoms array<{SITE}>, sequence string"
PAIR_DOCUMENT = "source string, model string, index_base int, first_residue int, sequence string, sequence_length int, base_pairs array<struct<i:int,j:int,prob:double,type:string,canonical:boolean>>"
CATALOGUE = T.StructType([T.StructField("PDB-ID", T.StringType()), T.StructField("EMD-ID", T.IntegerType()), T.StructField("resolution", T.DoubleType()), T.StructField("contour", T.DoubleType())])
GRID_META = "origin_xyz array<double>, voxel_size_xyz array<double>, class_names array<string>, contour double"


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """path, sequence: one clean RNA sequence per file; a bad file is an error when the plan runs."""
    text = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return text.select("path", clean_sequence(F.split("value", r"\r?\n")).alias("sequence"))


def read_backbone(spark: SparkSession, path: str) -> DataFrame:
    """One row per site of backbone documents, wherever they keep them: the first chain's p_atoms or atoms, or their own."""
    doc = spark.read.schema(BACKBONE).json(path, multiLine=True)
    sites = F.coalesce(F.get("chains", F.lit(0))["p_atoms"], F.get("chains", F.lit(0))["atoms"], F.col("p_atoms"), F.col("atoms"))
    checked = F.when(sites.isNull(), F.raise_error(F.lit("no sites in the document")).cast(f"array<{SITE}>")).otherwise(sites)
    return doc.select(F.col("_metadata.file_path").alias("path"), F.explode(checked).alias("s")).select("path", "s.*")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """path, at, i, j (author numbers), prob, canonical (null if missing) of pair documents; the index base is 0 or 1."""
    doc = spark.read.schema(PAIR_DOCUMENT).json(path, multiLine=True)
    base = F.when(F.col("index_base").isin(0, 1), F.col("index_base")).otherwise(F.raise_error(F.lit("index_base must be 0 or 1")).cast("int"))
    shift = F.coalesce("first_residue", F.lit(1)) - base
    rows = doc.select(F.col("_metadata.file_path").alias("path"), shift.alias("shift"), base.alias("base"), "sequence", F.posexplode("base_pairs").alias("at", "p"))
    letter = lambda k: F.coalesce(F.nullif(F.substring(F.col("sequence"), F.col(f"p.{k}") - F.col("base") + 1, F.lit(1)), F.lit("")), F.lit("N"))
    return rows.select("path", "at", (F.col("p.i") + F.col("shift")).alias("i"), (F.col("p.j") + F.col("shift")).alias("j"), "p.prob", "p.canonical", letter("i").alias("base_i"), letter("j").alias("base_j"))


def read_atoms(spark: SparkSession, path: str) -> DataFrame:
    """path, serial, atom, base, chain, residue_num, x, y, z, element of fixed-width ATOM and HETATM lines;
    serials and residues may be hybrid-36."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value").where(F.col("value").rlike("^(ATOM|HETATM)"))
    cut = lambda a, n, kind: F.trim(F.substring("value", a, n)).cast(kind)
    return lines.select("path", from_hybrid36(F.substring("value", 7, 5), 5).alias("serial"), cut(13, 4, "string").alias("atom"), cut(18, 3, "string").alias("base"), cut(22, 1, "string").alias("chain"), from_hybrid36(F.substring("value", 23, 4), 4).alias("residue_num"), cut(31, 8, "double").alias("x"), cut(39, 8, "double").alias("y"), cut(47, 8, "double").alias("z"), cut(77, 2, "string").alias("element"))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The distinct rows of a map catalogue, with a forced schema: ids like 9E74 are no numbers."""
    return spark.read.csv(path, header=True, schema=CATALOGUE).dropDuplicates()


def verified(path_digest: DataFrame, expected: DataFrame) -> DataFrame:
    """path of files whose SHA-256 is not the expected one (path, content against path, digest)."""
    return path_digest.select("path", F.sha2("content", 256).alias("found")).join(expected, "path").where("found <> digest").select("path", "found", "digest")


def read_atom_site(spark: SparkSession, path: str) -> DataFrame:
    """serial, atom, base, chain, residue_num, x, y, z, element of atom_site rows; fields are split, so of any width."""
    part = F.split("value", " ")
    cell = lambda k, kind="string": F.get(part, F.lit(k)).cast(kind)
    rows = spark.read.text(path).where("value like 'ATOM %'")
    return rows.select(cell(1, "long").alias("serial"), F.regexp_replace(cell(3), '"', "").alias("atom"), cell(5).alias("base"), cell(6).alias("chain"), cell(8, "int").alias("residue_num"), *[cell(10 + k, "double").alias(a) for k, a in enumerate("xyz")], cell(2).alias("element"))
