"""The extraction job: components of a grid's class, volumes, allocation, peaks, fallback and repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import allocation, graph, grid, kernels, peaks, spatial
from ..session import shared_folder, written

PLACE = ("z", "y", "x")


def clusters(voxels: DataFrame, keys: list[str]) -> DataFrame:
    """``voxels`` (keys, z, y, x, density) with cluster: the struct (z, y, x) of the first voxel of its 18-connected one."""
    placed = voxels.withColumn("id", F.struct(*keys, F.struct(*PLACE).alias("first")))
    labels = graph.connected_components(placed, grid.grid_edges(placed, 18, keys=tuple(keys)))
    return placed.join(labels, "id").withColumn("cluster", F.col("component.first")).drop("id", "component")


def shares(clustered: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cluster, n, volume: how many of a map's sites (``expected``: keys, target) each cluster gets.

    The volume of a site is that of all clusters of ten voxels or more over the target. Smaller clusters get none.
    """
    volumes = clustered.groupBy(*keys, "cluster").agg(F.count("*").alias("volume"))
    total = volumes.where(F.col("volume") >= allocation.MIN_VOLUME).groupBy(*keys).agg(F.sum("volume").alias("voxels"))
    rows = volumes.join(total, keys).join(expected.select(*keys, F.col("target").cast("long").alias("target")).where("target > 0"), keys).withColumn("unit", F.col("voxels") / F.col("target"))
    rows = rows.withColumn("alloc", allocation.first_allocation(F.col("volume"), F.col("unit")))
    return allocation.adjust_allocation(rows, keys).where("final > 0").select(*keys, "cluster", F.col("final").cast("int").alias("n"), "volume")


def _close_keys(sites: DataFrame, keys: list[str], size: float) -> DataFrame:
    """Keys of which two sites are nearer than 2.5."""
    near = spatial.radius_join(sites, sites, peaks.LEAST_SITES / size, keys=tuple(keys)).where((F.col("l.id") < F.col("r.id")) & (F.col("d") * size < peaks.LEAST_SITES - 1e-6))
    return near.select(*[F.col("l")[k].alias(k) for k in keys]).distinct()


def extract_sites(voxels: DataFrame, expected: DataFrame, keys: list[str], size: float = 1.0, edge: int = peaks.BLOCK) -> DataFrame:
    """keys, id, z, y, x (in voxels), density, cluster, way, phase, usable: the sites ``expected`` (keys, target) of each
    map, shared out among its 18-connected clusters.

    ``voxels``: keys, z, y, x, density of one class; ``size``: their edge. Each cluster's share is placed by
    :func:`peaks.cluster_sites` (``way``). A map with all its sites of which two are nearer than 2.5 takes its strongest
    suppressed maxima instead, if there are enough (way suppression). Then sites move as :func:`kernels.repair_positions`
    says (``phase``). ``usable`` is false for maps of which two sites are still nearer than 2.5: see :func:`checked`. A
    site's density is that of its voxel, 0 outside the class. Maps without a cluster of ten voxels, or that ``expected``
    does not name, give no row.
    """
    folder = shared_folder(voxels.sparkSession)
    keep = lambda df, name: written(df, f"{folder}/{name}")
    clustered = keep(clusters(voxels.select(*keys, *PLACE, "density"), keys), "clustered")
    named = clustered.join(shares(clustered, expected, keys), [*keys, "cluster"]).withColumn("name", F.to_json("cluster"))
    placed = peaks.cluster_sites(named.select(*keys, "name", *PLACE, "density", "n"), [*keys, "name"], size, edge)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("cluster", "peak")).cast("long")
    first = placed.withColumn("cluster", F.from_json("name", "z int, y int, x int")).withColumn("id", number).select(*keys, "id", *PLACE, "cluster", "way")
    at = clustered.select(*keys, *[F.col(a).alias(f"v{a}") for a in PLACE], "density")
    first = first.withColumns({f"v{a}": F.col(a).cast("int") for a in PLACE}).join(at, [*keys, *(f"v{a}" for a in PLACE)], "left")
    first = keep(first.select(*keys, "id", *PLACE, F.coalesce("density", F.lit(0.0)).alias("density"), "cluster", "way"), "placed")

    full = first.groupBy(*keys).agg(F.count("*").alias("n")).join(expected.select(*keys, "target"), keys).where("n = target and target > 1").select(*keys)
    colliding = keep(full.join(_close_keys(first, keys, size), keys, "left_semi").join(expected.select(*keys, "target"), keys), "colliding")
    apart = peaks.mask_candidates(clustered.join(colliding, keys, "left_semi"), keys, peaks.LEAST_SITES, size, edge)
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("density"), *PLACE)).cast("long")
    strict = apart.withColumn("id", best).join(colliding, keys).where("id <= target")
    enough = strict.groupBy(*keys).agg(F.count("*").alias("n"), F.first("target").alias("target")).where("n = target").select(*keys)
    strict = strict.join(enough, keys, "left_semi").join(clustered.select(*keys, *PLACE, "cluster"), [*keys, *PLACE])
    strict = strict.select(*keys, "id", *[F.col(a).cast("double").alias(a) for a in PLACE], "density", "cluster", F.lit("suppression").alias("way"))
    chosen = keep(first.join(strict.select(*keys).distinct(), keys, "left_anti").unionByName(strict), "chosen")

    free = peaks.mask_candidates(clustered.join(chosen.select(*keys).distinct(), keys, "left_semi"), keys, kernels.VACANT, size, edge)
    sites = chosen.select(*keys, "id", *PLACE, "density", F.xxhash64(F.to_json("cluster")).alias("cluster"))
    free = free.select(*keys, *[F.col(a).cast("double").alias(a) for a in PLACE], "density")
    moved = keep(kernels.repair_positions(sites, free, keys, size=size), "moved")
    bad = _close_keys(moved, keys, size).withColumn("usable", F.lit(False))
    out = moved.join(chosen.select(*keys, "id", "cluster", "way"), [*keys, "id"]).join(bad, keys, "left")
    return keep(out.select(*keys, "id", *PLACE, "density", "cluster", "way", "phase", F.coalesce("usable", F.lit(True)).alias("usable")), "sites")


def checked(sites: DataFrame, keys: list[str]) -> DataFrame:
    """``sites`` of :func:`extract_sites`, or an error that names ten of the maps whose sites are too near to each other."""
    bad = sites.where("not usable").select(*keys).distinct().limit(10).collect()
    if bad:
        raise ValueError(f"sites nearer than {peaks.LEAST_SITES} in maps " + ", ".join(str(tuple(r)) for r in bad))
    return sites
