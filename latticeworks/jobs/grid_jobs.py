"""Queries over grid cells."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import first_argmax, rounded
from ..operators import graph, grid, preparation
from ..session import table
from .adapters import CELLS, CLOUD, CONTOUR, cells, cloud
from .registry import query

_BOUND = f"bound AS (SELECT quantile_cont(density, 0.95) AS upper FROM cells WHERE density > {CONTOUR})"
_NORM = f"greatest(0.0, least(1.0, (density - {CONTOUR}) / (upper - {CONTOUR})))"


@query(f"WITH {CELLS}, {_BOUND} SELECT z, y, x, kind, round({_NORM}, 6) + 0.0 AS normalized FROM cells, bound")
def grid_normalize(spark, sf_dir):
    """Density above the contour on a 0..1 scale."""
    return grid.normalize_density(cells(spark, sf_dir), CONTOUR).select("z", "y", "x", "kind", rounded(F.col("normalized")).alias("normalized"))


@query(
    f"WITH {CELLS}, {_BOUND}, n AS (SELECT *, {_NORM} AS w FROM cells, bound) "
    "SELECT kind, count(*) AS n, round(sum(w * z) / sum(w), 6) AS cz, round(sum(w * y) / sum(w), 6) AS cy, round(sum(w * x) / sum(w), 6) AS cx FROM n WHERE w > 0 GROUP BY kind"
)
def class_centroid(spark, sf_dir):
    """Weighted centroid and volume of each class."""
    n = grid.normalize_density(cells(spark, sf_dir), CONTOUR).where("normalized > 0")
    return grid.weighted_centroids(n, ["kind"], "normalized").select("kind", "n", *[rounded(F.col(c)).alias(c) for c in ("cz", "cy", "cx")])


@query(
    f"WITH {CLOUD} SELECT id, CAST(trunc((x + 0.7) / 0.5) AS INT) AS vx, CAST(trunc((y + 0.7) / 0.5) AS INT) AS vy, CAST(trunc((z + 0.7) / 0.5) AS INT) AS vz, "
    "round(trunc((x + 0.7) / 0.5) * 0.5 - 0.7, 6) + 0.0 AS wx, round((x + 0.7) / 0.5, 6) + 0.0 AS fx FROM cloud"
)
def voxel_coordinates(spark, sf_dir):
    """World to voxel (truncated and not) and back, origin -0.7 and spacing 0.5."""
    c = cloud(spark, sf_dir)
    v = {a: grid.world_to_voxel(F.col(a), -0.7, 0.5) for a in "xyz"}
    return c.select("id", *[v[a].alias(f"v{a}") for a in "xyz"], rounded(grid.voxel_to_world(v["x"], -0.7, 0.5)).alias("wx"), rounded((F.col("x") + 0.7) / 0.5).alias("fx"))


def _shape(c):
    return c.agg((F.max("z") + 1).alias("nz"), (F.max("y") + 1).alias("ny"), F.lit(24).alias("nx"))


_SHAPE = "shape AS (SELECT max(z) + 1 AS nz, max(y) + 1 AS ny, 24 AS nx FROM cells)"
_STARTS = "unnest(range(CASE WHEN {n} <= 16 THEN 1 ELSE CAST(ceil(({n} - 16) / 8.0) AS INT) + 1 END)) * 8"
_TILES = (
    f"iz AS (SELECT nz, {_STARTS.format(n='nz')} AS ib FROM shape), iy AS (SELECT ny, {_STARTS.format(n='ny')} AS jb FROM shape), ix AS (SELECT nx, {_STARTS.format(n='nx')} AS kb FROM shape), "
    "tiles AS (SELECT ib, least(ib + 16, nz) AS ie, jb, least(jb + 16, ny) AS je, kb, least(kb + 16, nx) AS ke, row_number() OVER (ORDER BY ib, jb, kb) - 1 AS patch FROM iz, iy, ix)"
)


@query(f"WITH {CELLS}, {_SHAPE}, {_TILES} SELECT CAST(ib AS INT) AS ib, CAST(ie AS INT) AS ie, CAST(jb AS INT) AS jb, CAST(je AS INT) AS je, CAST(kb AS INT) AS kb, CAST(ke AS INT) AS ke, patch FROM tiles")
def patch_tiles(spark, sf_dir):
    """Overlapping windows over the grid, size 16, overlap 8."""
    return grid.patches(_shape(cells(spark, sf_dir)), 16, 8).select("ib", "ie", "jb", "je", "kb", "ke", "patch")


@query(f"WITH {CELLS}, {_SHAPE}, {_TILES} SELECT patch, count(*) AS n, round(sum(density), 4) AS density FROM cells JOIN tiles ON z >= ib AND z < ie AND y >= jb AND y < je AND x >= kb AND x < ke GROUP BY patch")
def patch_contents(spark, sf_dir):
    """The cells of each patch."""
    c = cells(spark, sf_dir)
    return grid.assign_patches(c, _shape(c), 16, 8).groupBy("patch").agg(F.count("*").alias("n"), F.round(F.sum("density"), 4).alias("density"))


_PROB = "((z * 31 + y * 17 + x * 7 + patch * 13) % 101) / 100.0"


@query(
    f"WITH {CELLS}, {_SHAPE}, {_TILES}, v AS (SELECT DISTINCT z, y, x FROM cells), p AS (SELECT z, y, x, patch, {_PROB} AS prob FROM v JOIN tiles ON z >= ib AND z < ie AND y >= jb AND y < je AND x >= kb AND x < ke), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY z, y, x ORDER BY round(abs(prob - 0.5), 9) DESC, patch) AS k FROM p) SELECT z, y, x, patch, prob FROM r WHERE k = 1"
)
def patch_merge(spark, sf_dir):
    """Certainty-max merge of overlapping patches."""
    c = cells(spark, sf_dir)
    v = c.select("z", "y", "x").distinct()
    p = grid.assign_patches(v, _shape(c), 16, 8).withColumn("prob", F.expr(_PROB).cast("double"))
    certain = p.withColumn("certain", F.round(F.abs(F.col("prob") - 0.5), 9))
    return grid.keep_best(certain, ["z", "y", "x"], F.col("certain"), "patch").select("z", "y", "x", "patch", "prob")


@query(
    f"WITH {CELLS}, {_SHAPE}, {_TILES}, v AS (SELECT DISTINCT z, y, x FROM cells), p AS (SELECT z, y, x, patch, (z * 3 + patch * 5) % 11 AS a, (y * 7 + patch) % 11 AS b, (x * 2 + patch * 3) % 11 AS c FROM v JOIN tiles ON z >= ib AND z < ie AND y >= jb AND y < je AND x >= kb AND x < ke), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY z, y, x ORDER BY greatest(a, b, c) DESC, patch) AS k FROM p) SELECT z, y, x, patch, CAST(CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS INT) AS cls FROM r WHERE k = 1"
)
def patch_confidence_merge(spark, sf_dir):
    """The class vector with the largest maximum wins, first patch first."""
    c = cells(spark, sf_dir)
    v = c.select("z", "y", "x").distinct()
    vector = F.expr("array(cast((z * 3 + patch * 5) % 11 as double), cast((y * 7 + patch) % 11 as double), cast((x * 2 + patch * 3) % 11 as double))")
    p = grid.assign_patches(v, _shape(c), 16, 8).withColumn("probs", vector)
    return grid.merge_by_confidence(p).select("z", "y", "x", "patch", first_argmax(F.col("probs")).alias("cls"))


@query(
    "WITH s AS (SELECT vec_id AS id, CAST((CAST(embedding[1] AS DOUBLE) * 0.5 + CAST(embedding[2] AS DOUBLE) * 0.5) AS FLOAT) AS p, [CAST(embedding[3 + k] AS DOUBLE) * 0.5 + CAST(embedding[7 + k] AS DOUBLE) * 0.5 for k in range(4)] AS g FROM embeddings) "
    "SELECT id, CAST(CASE WHEN p > CAST(0.02 AS FLOAT) THEN list_position(g, list_max(g)) ELSE 0 END AS INT) AS label FROM s"
)
def ensemble_argmax(spark, sf_dir):
    """Mean of two probability maps against a threshold, first largest mean class."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    label = grid.ensemble_label(F.get("e", F.lit(0)), F.get("e", F.lit(1)), F.slice("e", 3, 4), F.slice("e", 7, 4), 0.02)
    return e.select("id", label.alias("label"))


@query(
    f"WITH {CELLS} SELECT z, y, x, kind, round(density, 6) AS density FROM cells a WHERE NOT EXISTS (SELECT 1 FROM cells b WHERE b.kind = a.kind AND abs(a.z - b.z) <= 2 AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 AND round(b.density, 6) > round(a.density, 6))"
)
def local_maxima(spark, sf_dir):
    """Cells that are the largest of their class in a cube of radius 2; plateaus stay."""
    c = cells(spark, sf_dir).withColumn("density", F.round("density", 6))
    return grid.local_maxima(c, 2, keys=("kind",)).select("z", "y", "x", "kind", "density")


@query(
    f"WITH {CELLS}, m AS (SELECT z, y, x, kind, round(density, 6) AS density FROM cells a WHERE NOT EXISTS (SELECT 1 FROM cells b WHERE b.kind = a.kind AND abs(a.z - b.z) <= 2 AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 AND round(b.density, 6) > round(a.density, 6))), "
    "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY density DESC, z, y, x) AS INT) AS rank FROM m) SELECT z, y, x, kind, density, rank FROM r WHERE rank <= 50"
)
def ranked_maxima(spark, sf_dir):
    """The first fifty maxima of each class in (-density, z, y, x)."""
    from ..operators.selection import ranked_peaks

    return ranked_peaks(local_maxima(spark, sf_dir), ["kind"], 50)


_ID = "(CAST(z AS BIGINT) * ny + y) * 32 + x"


@query(
    f"WITH RECURSIVE {CELLS}, v AS (SELECT kind, z, y, x, {_ID} AS id FROM cells, (SELECT max(y) + 1 AS ny FROM cells) WHERE density > {CONTOUR}), "
    "e AS (SELECT a.kind, a.id AS a, b.id AS b FROM v a JOIN v b ON a.kind = b.kind AND b.z BETWEEN a.z - 1 AND a.z + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) BETWEEN 1 AND 2), "
    "r AS (SELECT kind, id, id AS hop FROM v UNION SELECT r.kind, r.id, e.b FROM r JOIN e ON e.kind = r.kind AND e.a = r.hop), c AS (SELECT kind, id, min(hop) AS component FROM r GROUP BY 1, 2) "
    "SELECT kind, component, count(*) AS volume FROM c GROUP BY 1, 2"
)
def grid_components(spark, sf_dir):
    """18-connected components of each class above the contour, with their volumes.

    Ids count the cells of the measured extents, class by class; the classes are those that the table has.
    """
    c = cells(spark, sf_dir)
    extent = c.agg((F.max("y") + 1).alias("ny"), ((F.max("z") + 1).cast("long") * (F.max("y") + 1) * 32).alias("size"))
    codes = c.select("kind").distinct().withColumn("code", F.row_number().over(Window.orderBy("kind")).cast("long"))
    v = c.where(F.col("density") > CONTOUR).join(F.broadcast(extent)).join(codes, "kind").withColumn("id", F.col("code") * F.col("size") + F.expr(_ID)).drop("code", "ny")
    labels = graph.connected_components(v, grid.grid_edges(v, 18, keys=("kind",)))
    return v.join(labels, "id").groupBy("kind", (F.col("component") % F.col("size")).alias("component")).agg(F.count("*").alias("volume"))


@query()
def extract(spark, sf_dir):
    """Sites in maps of blocks of the grid (three by four cells, 16 rows), one for 40 blocks, with the way each was
    placed and the phase in which it moved.

    More users give more maps, not larger ones. Tests hold the job against a plain version.
    """
    from .extract import extract_sites

    place = [F.expr("y div 16").alias("map"), F.expr("z div 3").alias("z"), "y", F.expr("x div 4").alias("x")]
    v = cells(spark, sf_dir).where(F.col("density") > CONTOUR).select("kind", *place, "density")
    v = v.groupBy("kind", "map", *[F.col(a).cast("int").alias(a) for a in "zyx"]).agg(F.round(F.max("density"), 6).alias("density"))
    expected = v.groupBy("kind", "map").agg(F.ceil(F.count("*") / 40).alias("target"))
    out = extract_sites(v, expected, ["kind", "map"])
    return out.select("kind", "map", "id", *[rounded(F.col(a), 4).alias(a) for a in "zyx"], rounded(F.col("density")).alias("density"), "way", "phase", "usable")


@query()
def flood_basins(spark, sf_dir):
    """Basins of the spaced maxima of each class of cells, flooded block by block."""
    from ..operators import peaks

    v = cells(spark, sf_dir).select("kind", "z", "y", "x", F.round("density", 6).alias("density"))
    seeds = peaks.spaced_maxima(v, ["kind"], 6.0)
    numbered = seeds.withColumn("seed", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("density"), "z", "y", "x"))).select("kind", "z", "y", "x", "seed")
    ground = v.join(numbered, ["kind", "z", "y", "x"], "left").withColumn("level", F.floor(-F.col("density") * 1000).cast("long"))
    basins = peaks.flood(ground, ["kind"])
    return basins.groupBy("kind", "basin").agg(F.count("*").alias("volume"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))


@query(
    f"WITH RECURSIVE {CELLS}, v AS (SELECT kind, z, y, x, density, {_ID} AS id FROM cells, (SELECT max(y) + 1 AS ny FROM cells) WHERE density > {CONTOUR}), "
    "e AS (SELECT a.kind, a.id AS a, b.id AS b FROM v a JOIN v b ON a.kind = b.kind AND b.z BETWEEN a.z - 1 AND a.z + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) BETWEEN 1 AND 2), "
    "r AS (SELECT kind, id, id AS hop FROM v UNION SELECT r.kind, r.id, e.b FROM r JOIN e ON e.kind = r.kind AND e.a = r.hop), c AS (SELECT kind, id, min(hop) AS component FROM r GROUP BY 1, 2), "
    "w AS (SELECT v.*, component FROM v JOIN c USING (kind, id)), g AS (SELECT kind, component FROM w GROUP BY 1, 2 HAVING greatest(max(z) - min(z) + 1, max(y) - min(y) + 1, (max(x) - min(x) + 1) * 0.5) >= 2) "
    "SELECT kind, z, y, x, round(density, 6) AS density FROM w JOIN g USING (kind, component)"
)
def map_dust(spark, sf_dir):
    """Cells above the contour in pieces at least two days or users or four hours long."""
    kept = preparation.without_dust(cells(spark, sf_dir), ["kind"], CONTOUR, 2.0, (1.0, 1.0, 0.5))
    return kept.select("kind", "z", "y", "x", F.round("density", 6).alias("density"))


def _unnested(axis: str, step: float, rest: str) -> str:
    return f"SELECT *, unnest(range(greatest(CAST(ceil(({axis} - 1) / {step}) AS BIGINT), 0), CAST(floor(({axis} + 1) / {step}) AS BIGINT) + 1)) AS o{axis} FROM ({rest})"


_SHARE = " * ".join(f"(1 - abs(o{a} * {s} - {a}))" for a, s in (("z", 0.75), ("y", 1.5), ("x", 0.5)))


@query(
    f"WITH {CELLS}, last AS (SELECT kind, max(z) AS lz, max(y) AS ly, max(x) AS lx FROM cells GROUP BY kind), near AS ({_unnested('z', 0.75, _unnested('y', 1.5, _unnested('x', 0.5, 'SELECT kind, z, y, x, round(density, 2) AS density FROM cells')))}) "
    f"SELECT kind, CAST(oz AS INT) AS z, CAST(oy AS INT) AS y, CAST(ox AS INT) AS x, round(sum(density * {_SHARE}), 8) AS density FROM near JOIN last USING (kind) WHERE oz * 0.75 <= lz AND oy * 1.5 <= ly AND ox * 0.5 <= lx AND {_SHARE.replace('(1 - ', '(1 > ').replace(' * (1 >', ' AND (1 >')} GROUP BY 1, 2, 3, 4 HAVING sum(density * {_SHARE}) > 0"
)
def map_resample(spark, sf_dir):
    """The grid of each class at three quarters of a day, one and a half users and half an hour."""
    v = cells(spark, sf_dir).withColumn("density", F.round("density", 2))
    sizes = v.groupBy("kind").agg(*[(F.max(a) + 1).alias(f"n{a}") for a in "zyx"])
    fine = preparation.resample(v, sizes, ["kind"], (0.75, 1.5, 0.5))
    return fine.select("kind", "z", "y", "x", F.round("density", 8).alias("density"))


@query()
def reconstruction(spark, sf_dir):
    """O1: maps of blocks of the grid (as in ``extract``) and sequences to atoms, by stages in a folder of their own.

    The grid goes through map files; a rule on the density stands in for the trained labels, and hairpins for the pairs.
    """
    from ..session import shared_folder
    from ..sources import maps
    from .reconstruct import reconstruct

    v = cells(spark, sf_dir).where(F.col("density") > CONTOUR)
    v = v.groupBy(F.concat_ws("-", "kind", F.expr("y div 16")).alias("map_id"), F.expr("cast(z div 3 as int)").alias("z"), F.expr("cast(y % 16 as int)").alias("y"), F.expr("cast(x div 4 as int)").alias("x"))
    v = v.agg(F.round(F.max("density"), 2).alias("density"))
    sequences = v.groupBy("map_id").agg((F.ceil(F.count("*") / 60) + 1).cast("int").alias("n"))
    letter = lambda k: F.substring(F.lit("GCAUUCGA"), (F.crc32("map_id") + k * 3) % 8 + 1, F.lit(1))
    sequences = sequences.select("map_id", F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), letter), "").alias("sequence"))
    constant = {"nz": F.lit(10), "ny": F.lit(16), "nx": F.lit(6), "mode": F.lit(2), "axes": F.array(*[F.lit(a) for a in (1, 2, 3)]), "origin": F.array(*[F.lit(k) for k in (4.0, -8.0, 2.0)]), "spacing": F.array(*[F.lit(2.0)] * 3), "big": F.lit(False)}
    path = shared_folder(spark)
    maps.write_maps(sequences.select("map_id").withColumns(constant), v, path)
    kinds = F.array(*[F.lit(k) for k in (1, 1, 1, 2, 3, 4)])

    def predict(prepared):
        return prepared.withColumn("label", F.element_at(kinds, (F.floor(F.round("density", 4) * 5000) % 6 + 1).cast("int")))

    def pair(rows):
        n = F.length("sequence")
        return rows.where(n >= 5).select("map_id", F.explode(F.sequence(F.lit(1), F.floor((n - 3) / 2).cast("int"))).alias("i"), n.alias("n")).select("map_id", "i", (F.col("n") + 1 - F.col("i")).alias("j"))

    atoms = reconstruct(spark, shared_folder(spark), path, sequences, predict, pair, contour=CONTOUR, size=4.0, target=2.0, whole=False)["atoms"]
    return atoms.select("map_id", "residue_num", "base", "atom", *[rounded(F.col(a), 3).alias(a) for a in "xyz"])
