"""Queries that write a document or a grid, read it again and return its rows; contracts and counters of inputs.

The files lie below the session's checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import grid, placement, restraints, selection, spatial
from ..session import shared_folder, table
from ..sources import maps, readers, writers
from .adapters import CELLS, CHAINS, PAIRS, cells, chains, scored_pairs
from .model_jobs import _PLACED, _framed
from .registry import query

_LETTER = "chr(CAST(65 + chain AS INT))"
_ROWS = ", ".join(f"round(a{a}, 3) + 0.0 AS {a}" for a in "xyz")


def _placed(spark, sf_dir):
    p = placement.place_templates(_framed(spark, sf_dir)).withColumn("order", F.col("chain") * 1_000_000 + F.col("residue_num")).withColumn("chain", F.expr("char(65 + chain)"))
    for a in "xyz":
        p = p.withColumn(f"a{a}", rounded(F.col(f"a{a}"), 3))
    return p


@query(f"WITH {_PLACED} SELECT CAST(row_number() OVER (ORDER BY chain, residue_num, atom_ord) AS INT) AS serial, atom, base, {_LETTER} AS chain, residue_num, {_ROWS}, substring(atom, 1, 1) AS element FROM placed")
def atoms_round_trip(spark, sf_dir):
    """Atoms without caps as fixed-width lines, copied as they are, and read again.

    The format has five columns for serials and four for residues; larger ones are hybrid-36.
    """
    first, second = shared_folder(spark), shared_folder(spark)
    writers.write_lines(placement.pdb_lines(restraints.strip_caps(_placed(spark, sf_dir)), ["order", "atom_ord"]), first, head=("REMARK model",))
    writers.copy_structure(spark, first, second)
    return readers.read_atoms(spark, second).drop("path")


@query(f"WITH {_PLACED} SELECT row_number() OVER (PARTITION BY chain ORDER BY residue_num, atom_ord) AS serial, atom, base, {_LETTER} AS chain, residue_num, {_ROWS}, substring(atom, 1, 1) AS element FROM placed")
def atom_site_round_trip(spark, sf_dir):
    """K2, K5: atoms without caps as atom_site rows, and read again."""
    path = shared_folder(spark)
    writers.write_lines(placement.mmcif_rows(restraints.strip_caps(_placed(spark, sf_dir)), ["order", "atom_ord"]), path, head=("data_model", "loop_"), tail=("#",))
    return readers.read_atom_site(spark, path)


@query(f"WITH {CHAINS}, t(base, n) AS (VALUES ('A', 22), ('C', 20), ('G', 23), ('U', 20)) SELECT chain, c.residue_num, c.base, CAST(n AS INT) AS atoms FROM chains c JOIN t USING (base)")
def nested_models(spark, sf_dir):
    """K3, K9: a nested document for each chain, parsed again: residues with their number of atoms."""
    model = "n_residues int, residues array<struct<residue_num:int,base:string,atoms:array<struct<name:string>>>>"
    docs = writers.nested_model(placement.place_templates(_framed(spark, sf_dir)), ["chain"])
    residue = docs.select("chain", F.explode(F.from_json("json", model)["residues"]).alias("r"))
    return residue.select("chain", "r.residue_num", "r.base", F.size("r.atoms").alias("atoms"))


def _by_chain(documents, path):
    """One file for each chain, whose number is the folder's."""
    documents.repartition("chain").write.partitionBy("chain").text(path)


def _chain():
    return F.regexp_extract("path", "chain=([^/]+)", 1).cast("int").alias("chain")


@query(f"WITH {CHAINS} SELECT chain, residue_num, base, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y, round(z, 3) + 0.0 AS z FROM chains WHERE residue_num % 7 <> 0")
def backbone_round_trip(spark, sf_dir):
    """K7, S3: registered sites of each chain as a document, and read again."""
    c, path = chains(spark, sf_dir), shared_folder(spark)
    _by_chain(writers.registration_document(c.where("residue_num % 7 <> 0"), c.select("chain", "residue_num"), ["chain"]), path)
    return readers.read_backbone(spark, path).select(_chain(), "residue_num", "base", *[rounded(F.get("position", F.lit(k)), 3).alias(a) for k, a in enumerate("xyz")])


@query(f"WITH {PAIRS} SELECT chain, CAST(row_number() OVER (PARTITION BY chain ORDER BY i, j) - 1 AS INT) AS at, i + 1 AS i, j + 1 AS j, prob, i % 2 = 0 AS canonical, 'N' AS base_i FROM scored")
def pairs_round_trip(spark, sf_dir):
    """Pairs of each chain as a document, and read again with numbers from 1; without a sequence bases are N."""
    path = shared_folder(spark)
    p = scored_pairs(spark, sf_dir).withColumn("type", F.lit("cis")).withColumn("canonical", F.expr("i % 2 = 0"))
    _by_chain(writers.pair_document(p, ["chain"]), path)
    return readers.read_pairs(spark, path).select(_chain(), "at", "i", "j", "prob", "canonical", "base_i")


@query(f"WITH {CHAINS} SELECT chain, string_agg(base, '' ORDER BY residue_num) AS sequence FROM chains GROUP BY chain")
def sequence_files(spark, sf_dir):
    """A headed, lower-case file for each chain, and read again."""
    path = shared_folder(spark)
    letters = F.transform(F.array_sort(F.collect_list(F.struct("residue_num", "base"))), lambda r: r["base"])
    whole = chains(spark, sf_dir).groupBy("chain").agg(F.array_join(letters, "").alias("s"))
    _by_chain(whole.select("chain", F.concat(F.lit(">chain\n"), F.lower("s")).alias("value")), path)
    return readers.read_sequences(spark, path).select(_chain(), "sequence")


@query(f"WITH {CELLS} SELECT kind, z, y, x, round(density, 6) AS density FROM cells")
def grid_round_trip(spark, sf_dir):
    """The grid of each kind in blocks of planes, and read again."""
    path = shared_folder(spark)
    writers.write_grid(cells(spark, sf_dir).withColumnRenamed("kind", "map_id"), path)
    return spark.read.parquet(path).select(F.col("map_id").alias("kind"), "z", "y", "x", F.round("density", 6).alias("density"))


@query("SELECT DISTINCT p_brand AS pdb_id, p_size AS emd_id, CAST(p_size % 5 AS DOUBLE) AS resolution, CAST(p_size % 3 AS DOUBLE) AS contour FROM part")
def catalogue_rows(spark, sf_dir):
    """A catalogue with repeated rows, read with its forced schema; each row once."""
    path = shared_folder(spark)
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("PDB-ID"), F.col("p_size").alias("EMD-ID"), (F.col("p_size") % 5).alias("resolution"), (F.col("p_size") % 3).alias("contour"))
    p.write.csv(path, header=True)
    return readers.read_catalogue(spark, path).toDF("pdb_id", "emd_id", "resolution", "contour")


@query("SELECT CAST(p_partkey AS STRING) AS path, sha256(p_type) AS found, sha256(p_name) AS digest FROM part WHERE p_partkey % 3 = 0 AND p_type <> p_name")
def digest_mismatches(spark, sf_dir):
    """Contents whose digest is not the expected one."""
    p = table(spark, sf_dir, "part").withColumn("path", F.col("p_partkey").cast("string"))
    expected = p.select("path", F.sha2(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.col("p_type")), 256).alias("digest"))
    return readers.verified(p.select("path", F.col("p_type").cast("binary").alias("content")), expected)


@query(
    "SELECT 'embeddings' AS source, count(*) AS rows, 'finite' AS \"check\", count(*) FILTER (len(list_filter(embedding, lambda v: NOT isfinite(v))) > 0) AS failed FROM embeddings "
    "UNION ALL SELECT 'embeddings', count(*), 'shape', count(*) FILTER (len(embedding) <> 64) FROM embeddings "
    "UNION ALL SELECT 'lineitem', count(*), 'positive', count(*) FILTER (NOT l_quantity > 1) FROM lineitem "
    "UNION ALL SELECT 'lineitem', count(*), 'domain', count(*) FILTER (l_returnflag NOT IN ('A', 'N')) FROM lineitem "
    "UNION ALL SELECT 'lineitem', count(*), 'ordered', count(*) FILTER (NOT l_partkey < l_suppkey) FROM lineitem"
)
def input_contracts(spark, sf_dir):
    """finite vectors of one shape, positive numbers, a domain of labels and ordered pairs."""
    finite = F.forall("embedding", lambda v: ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    e = selection.violations(table(spark, sf_dir, "embeddings"), {"finite": finite, "shape": F.size("embedding") == 64})
    l = selection.violations(table(spark, sf_dir, "lineitem"), {"positive": F.col("l_quantity") > 1, "domain": F.col("l_returnflag").isin("A", "N"), "ordered": F.col("l_partkey") < F.col("l_suppkey")})
    return e.withColumn("source", F.lit("embeddings")).unionByName(l.withColumn("source", F.lit("lineitem")))


@query(f"WITH {CHAINS} SELECT chain, count(*) AS n, count(*) FILTER (base IN ('A', 'G')) AS purines, count(*) FILTER (base IN ('C', 'U')) AS pyrimidines, count(*) FILTER (x > 0) AS ahead FROM chains GROUP BY chain")
def chain_counters(spark, sf_dir):
    """Counters of each chain."""
    return selection.counters(chains(spark, sf_dir), ["chain"], {"purines": F.col("base").isin("A", "G"), "pyrimidines": F.col("base").isin("C", "U"), "ahead": F.col("x") > 0})


@query("SELECT o_custkey AS chain, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 50 END, 0), o_orderkey) - 1 AS at FROM orders")
def residue_order(spark, sf_dir):
    """Sites of a chain by residue, those without a number first."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chain"), F.col("o_orderkey").alias("id"), F.expr("case when o_orderkey % 3 <> 0 then o_orderkey % 50 end").alias("residue_num"))
    return selection.in_order(o, ["chain"], "residue_num", "id").select("chain", "id", F.col("at").cast("long").alias("at"))


@query(
    f"WITH {CELLS} SELECT a.z, a.y, a.x, count(*) AS n FROM cells a JOIN cells b ON b.kind = 'view' AND abs(a.z - b.z) <= 3 AND abs(a.y - b.y) <= 3 AND abs(a.x - b.x) <= 3 "
    "AND ((b.z - a.z) / 2.0) * ((b.z - a.z) / 2.0) + ((b.y - a.y) / 3.0) * ((b.y - a.y) / 3.0) + ((b.x - a.x) / 1.5) * ((b.x - a.x) / 1.5) <= 1.0 WHERE a.kind = 'purchase' GROUP BY 1, 2, 3"
)
def ellipsoid_cells(spark, sf_dir):
    """how many cells of one class lie in an ellipsoid around each cell of another."""
    c = cells(spark, sf_dir).select("z", "y", "x", "kind")
    d = {a: F.col("r")[a] - F.col("l")[a] for a in "zyx"}
    near = grid.box_join(c.where("kind = 'purchase'"), c.where("kind = 'view'"), 3).where(spatial.inside_ellipsoid(d["z"], d["y"], d["x"], (2.0, 3.0, 1.5)))
    return near.groupBy("l.z", "l.y", "l.x").agg(F.count("*").alias("n"))


@query(f"WITH {CHAINS}, t AS (SELECT chain, residue_num, unnest(['P', 'HO5''', 'O5''']) AS atom FROM chains) SELECT chain, residue_num, atom FROM t WHERE NOT (atom = 'HO5''' AND residue_num % 4 = 1)")
def spurious_hydrogens(spark, sf_dir):
    """residues with a phosphate in front lose their terminal hydrogen."""
    c = chains(spark, sf_dir)
    atoms = c.select("chain", "residue_num", F.explode(F.array(*[F.lit(a) for a in ("P", "HO5'", "O5'")])).alias("atom"))
    return restraints.drop_spurious_hydrogens(atoms, c.where("residue_num % 4 = 1"), ["chain"]).select("chain", "residue_num", "atom")


_STORED = f"{CELLS}, s AS (SELECT kind, z // 5 AS part, z % 5 AS z, y, x, [0, 1, 2, 6, 12][(z // 5) % 5 + 1] AS mode, density FROM cells), stored AS (SELECT kind || '-' || part AS map_id, CAST(z AS INT) AS z, y, x, CASE WHEN mode = 2 THEN round(density, 2) ELSE least(floor(round(density, 6)), CASE WHEN mode = 0 THEN 127 ELSE 2000 END) END AS density FROM s)"


def _stored_maps(spark, sf_dir) -> str:
    """The folder of a map for each class and five days, in turn of every mode, axis order and byte order."""
    part = F.expr("z div 5")
    mode = F.element_at(F.array(*[F.lit(m) for m in (0, 1, 2, 6, 12)]), (part % 5 + 1).cast("int"))
    c = cells(spark, sf_dir).withColumns({"map_id": F.concat_ws("-", "kind", part), "part": part, "mode": mode})
    whole = F.least(F.floor(F.round("density", 6)).cast("double"), F.when(F.col("mode") == 0, 127.0).otherwise(2000.0))
    v = c.select("map_id", "part", "kind", "mode", (F.col("z") % 5).cast("int").alias("z"), "y", "x", F.when(F.col("mode") == 2, F.round("density", 2)).otherwise(whole).alias("density"))
    orders = F.array(*[F.array(*[F.lit(a) for a in o]) for o in ((1, 2, 3), (1, 3, 2), (2, 1, 3), (2, 3, 1), (3, 1, 2), (3, 2, 1))])
    constant = {"nz": F.lit(5), "nx": F.lit(24), "axes": F.element_at(orders, ((F.col("part") + F.length("kind")) % 6 + 1).cast("int")), "origin": F.array(*[F.lit(k) for k in (1.5, -2.0, 0.25)]), "spacing": F.array(*[F.lit(0.5)] * 3), "big": F.col("part") % 2 == 1}
    rows = table(spark, sf_dir, "events").agg((F.greatest(F.max("user_id"), F.lit(1)) + 1).cast("int").alias("ny"))
    m = v.select("map_id", "part", "kind", "mode").distinct().join(F.broadcast(rows)).withColumns(constant).drop("part", "kind")
    path = shared_folder(spark)
    maps.write_maps(m, v, path)
    return path


def _voxels(rows):
    return rows.select(F.regexp_extract("path", r"([^/]+)\.mrc$", 1).alias("map_id"), "z", "y", "x", F.round(F.col("density").cast("double"), 2).alias("density"))


@query(f"WITH {_STORED} SELECT map_id, z, y, x, round(density, 2) AS density FROM stored WHERE density > 0")
def map_round_trip(spark, sf_dir):
    """The grid as map files of every mode, axis order and byte order, read again by ranges of sections."""
    return _voxels(maps.read_maps(spark, _stored_maps(spark, sf_dir), window=16384))


@query(f"WITH {_STORED} SELECT map_id, z, y, x, round(density, 2) AS density FROM stored WHERE density > 0 AND z BETWEEN 1 AND 3 AND y >= 5 AND x BETWEEN 6 AND 17")
def map_box(spark, sf_dir):
    """A box of each map file; sections and rows outside it are not read."""
    return _voxels(maps.read_maps(spark, _stored_maps(spark, sf_dir), box={"z": (1, 3), "y": (5, 2**31 - 1), "x": (6, 17)}))
