"""Peaks of grids that are cut into blocks: greedy maxima, flooding, and the ways to place sites in a cluster.

Greedy suppression and flooding each have one solution that every voxel's neighbours determine. Blocks are solved on
their own, given what their neighbours last said of the voxels at their faces, until no block says anything new: that is
the solution of the whole grid, and no task holds more than a block.
"""

from __future__ import annotations

import heapq
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import by_group, delete, shared_folder, written
from . import grid, kernels, spatial

AXES = ("z", "y", "x")
#: Edge of a block in voxels.
BLOCK = 48
_OFFSETS = np.array([d for d in product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, d)) < 3])


def _blocked(rows: DataFrame, edge: int) -> DataFrame:
    return rows.withColumns({f"b{a}": F.floor(F.col(a) / edge).cast("int") for a in AXES})


def _to_neighbours(rows: DataFrame, edge: int, reach: float) -> DataFrame:
    """Each row of a block (bz, by, bx) once for every other block that lies within ``reach`` of it along all axes."""
    out = rows.withColumns({f"h{a}": F.col(f"b{a}") for a in AXES})
    for a in AXES:
        inside = F.col(a) - F.col(f"b{a}") * edge
        near = F.array_compact(F.array(F.when(inside < reach, F.col(f"b{a}") - 1), F.col(f"b{a}"), F.when(edge - 1 - inside < reach, F.col(f"b{a}") + 1)))
        out = out.withColumn(f"b{a}", F.explode(near))
    return out.where(" or ".join(f"b{a} <> h{a}" for a in AXES)).drop(*[f"h{a}" for a in AXES])


def _types(frame: DataFrame, columns: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema}
    return ", ".join(f"{c} {kinds[c]}" for c in columns)


def spaced_maxima(voxels: DataFrame, keys: list[str], separation: float, edge: int = BLOCK, rounds: list | None = None) -> DataFrame:
    """keys, z, y, x, density of a greedy choice per key: voxels in the order (-density, z, y, x), each at least
    ``separation`` from all that were chosen before.

    A block chooses among its own voxels, given its neighbours' chosen ones within reach; a choice only depends on
    voxels that come before, so the rounds end with the choice of a single sequence. ``edge`` must not be below
    ``separation``; ``rounds``, if given, takes a row count for each round.
    """
    if edge < separation:
        raise ValueError("blocks must be as long as the separation")
    folder, columns = shared_folder(voxels.sparkSession), [*keys, *AXES, "density"]
    blocks = [*keys, *(f"b{a}" for a in AXES)]
    own = written(_blocked(voxels.select(*columns), edge), f"{folder}/voxels")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        p, other = pdf[list(AXES)].to_numpy(float), pdf["other"].to_numpy(bool)
        alive, kept = ~other, np.zeros(len(p), bool)
        for k in np.flatnonzero(other):
            alive[k + 1 :] &= ((p[k + 1 :] - p[k]) ** 2).sum(axis=1) >= separation**2 - 1e-9
        left = np.flatnonzero(alive)
        while len(left):
            kept[left[0]] = True
            left = left[1:][((p[left[1:]] - p[left[0]]) ** 2).sum(axis=1) >= separation**2 - 1e-9]
        return pdf.loc[kept, [*blocks, *AXES, "density"]]

    schema, kept, n = _types(own, [*blocks, *AXES, "density"]), None, 0
    while True:
        rows = own.withColumn("other", F.lit(False))
        if kept is not None:
            rows = rows.unionByName(_to_neighbours(kept, edge, separation).withColumn("other", F.lit(True)))
        new = written(by_group(rows, blocks, choose, schema, (F.desc("density"), *AXES)), f"{folder}/kept-{n}")
        same = kept is not None and new.join(kept, [*blocks, *AXES], "left_anti").isEmpty() and kept.join(new, [*blocks, *AXES], "left_anti").isEmpty()
        if rounds is not None:
            rounds.append(n)
        if same:
            return new.select(*columns)
        kept, n = new, n + 1


def flood(voxels: DataFrame, keys: list[str], edge: int = BLOCK, rounds: list | None = None) -> DataFrame:
    """keys, z, y, x, basin: each voxel's seed when water rises from the seeds through 18 neighbours.

    ``voxels``: keys, z, y, x, level (a whole number, the height of the ground), seed (1, 2, ... or null). A voxel is
    reached at the lowest level that some path from a seed needs, then by the fewest steps since the water stood that
    high, and takes the smallest seed among the neighbours that reach it so. Voxels that no seed reaches have no row. A
    block floods from its seeds and from what its neighbours' faces hold; only blocks next to a changed face flood again.
    """
    folder, blocks = shared_folder(voxels.sparkSession), [*keys, *(f"b{a}" for a in AXES)]
    own = written(_blocked(voxels.select(*keys, *AXES, F.col("level").cast("long").alias("level"), F.coalesce(F.col("seed").cast("int"), F.lit(0)).alias("seed")), edge), f"{folder}/voxels")
    state_columns = [*blocks, *AXES, "height", "steps", "basin"]

    def rise(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[list(AXES)].to_numpy(np.int64)
        low, shape = p.min(axis=0) - 1, p.max(axis=0) - p.min(axis=0) + 3
        place = np.full(shape.prod(), -1)
        at = np.ravel_multi_index(tuple((p - low).T), tuple(shape))
        place[at] = np.arange(len(p))
        around = place[at[:, None] + (_OFFSETS @ np.array([shape[1] * shape[2], shape[2], 1]))[None, :]].tolist()
        other, level, seed = pdf["other"].to_numpy(bool).tolist(), pdf["level"].tolist(), pdf["seed"].tolist()
        best, done = [None] * len(p), [False] * len(p)
        for k, (h, s, b) in enumerate(zip(pdf["height"].tolist(), pdf["steps"].tolist(), pdf["basin"].tolist(), strict=True)):
            if other[k]:
                best[k] = (h, s, b)
            elif seed[k]:
                best[k] = (level[k], 0, seed[k])
        queue = [(*b, k) for k, b in enumerate(best) if b is not None]
        heapq.heapify(queue)
        while queue:
            h, s, b, k = heapq.heappop(queue)
            if done[k]:
                continue
            done[k] = True
            for j in around[k]:
                if j >= 0 and not done[j] and not other[j] and not seed[j]:
                    new = (level[j], 0, b) if level[j] > h else (h, s + 1, b)
                    if best[j] is None or new < best[j]:
                        best[j] = new
                        heapq.heappush(queue, (*new, j))
        reached = [k for k in range(len(p)) if best[k] is not None and not other[k]]
        out = pdf.iloc[reached][[*blocks, *AXES]].copy()
        for c, values in zip(("height", "steps", "basin"), zip(*(best[k] for k in reached), strict=True) if reached else ([], [], []), strict=True):
            out[c] = np.array(values, np.int64)
        return out

    schema = _types(own, [*blocks, *AXES]) + ", height long, steps long, basin long"
    nothing = {c: F.lit(0).cast("long") for c in ("height", "steps", "basin")}
    state, dirty, n = None, None, 0
    while True:
        mine = own if dirty is None else own.join(dirty, blocks, "left_semi")
        rows = mine.withColumns({**nothing, "other": F.lit(False)})
        if state is not None:
            faces = _to_neighbours(state, edge, 1).withColumns({"level": F.lit(0).cast("long"), "seed": F.lit(0), "other": F.lit(True)})
            rows = rows.unionByName(faces.join(dirty, blocks, "left_semi"))
        solved = by_group(rows, blocks, rise, schema).select(*state_columns)
        new = written(solved if state is None else solved.unionByName(state.join(dirty, blocks, "left_anti")), f"{folder}/state-{n}")
        changed = _to_neighbours(new if state is None else new.join(state, state_columns, "left_anti"), edge, 1)
        dirty = written(changed.select(*blocks).distinct().join(own.select(*blocks).distinct(), blocks, "left_semi"), f"{folder}/dirty-{n}")
        if rounds is not None:
            rounds.append(n)
        if state is not None:
            delete(voxels.sparkSession, f"{folder}/state-{n - 1}")
        state, n = new, n + 1
        if dirty.isEmpty():
            return state.select(*keys, *AXES, "basin")


# What the nearest two centres of a flooded cluster, the expected step along a chain, and two sites at all
# must be apart; how far a chosen peak excludes others, as a share of the step; the range of whole levels.
LEAST_CENTRES, STEP, LEAST_SITES, EXCLUDED, LEVELS = 3.5, 5.9, 2.5, 0.45, 60_000


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumn("peak", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("density"), *AXES)))


def flooded_centres(voxels: DataFrame, keys: list[str], size: float = 1.0, edge: int = BLOCK) -> DataFrame:
    """keys, peak, z, y, x: density-weighted centres of the basins around n (a column) seeds of each cluster.

    Seeds are the first n spaced maxima, max(3, 3.5 / ``size``) voxels apart; levels run from 0 at the densest voxel to
    60,000. Clusters with fewer seeds, without positive density or with two centres nearer than 3.5 give no row.
    """
    folder = shared_folder(voxels.sparkSession)
    apart = max(3, int(LEAST_CENTRES / size))
    counts = voxels.groupBy(*keys).agg(F.first("n").alias("n"), F.max("density").alias("top"))
    seeds = _numbered(spaced_maxima(voxels, keys, apart, max(edge, apart)), keys).join(counts, keys).where("peak <= n")
    enough = seeds.groupBy(*keys).agg(F.count("*").alias("found"), F.first("n").alias("n"), F.first("top").alias("top")).where("found = n and top > 0").select(*keys, "top")
    seeds = written(seeds.select(*keys, *AXES, F.col("peak").alias("seed")), f"{folder}/seeds")
    level = F.floor((F.col("top") - F.col("density")) / F.col("top") * LEVELS).cast("long")
    ground = voxels.join(enough, keys).join(seeds, [*keys, *AXES], "left").select(*keys, *AXES, level.alias("level"), "seed")
    basins = flood(ground, keys, edge).join(voxels.select(*keys, *AXES, "density"), [*keys, *AXES])
    centres = grid.weighted_centroids(basins.withColumnRenamed("basin", "peak"), [*keys, "peak"], "density")
    centres = written(centres.select(*keys, F.col("peak").cast("int").alias("peak"), *[F.col(f"c{a}").alias(a) for a in AXES]), f"{folder}/centres")
    named = centres.withColumn("id", F.col("peak"))
    near = spatial.radius_join(named, named, LEAST_CENTRES / size, keys=tuple(keys)).where((F.col("l.id") != F.col("r.id")) & (F.col("d") * size < LEAST_CENTRES))
    return centres.join(near.select(*[F.col("l")[k].alias(k) for k in keys]).distinct(), keys, "left_anti")


def cluster_sites(voxels: DataFrame, keys: list[str], size: float = 1.0, edge: int = BLOCK) -> DataFrame:
    """keys, peak, z, y, x, way: n (a column) sites for each cluster of ``voxels`` (keys, z, y, x, density, n).

    One site is the weighted centre. More come from flooding; clusters that it leaves take the first n spaced maxima
    max(2, 0.45 * 5.9 / ``size``) voxels apart; clusters that have too few of these go to weighted k-means. Each way runs
    over the clusters that the ones before it left. Positions are in voxels.
    """
    folder = shared_folder(voxels.sparkSession)
    keep = lambda df, name: written(df, f"{folder}/{name}")
    single = grid.weighted_centroids(voxels.where("n = 1"), keys, "density").select(*keys, F.lit(1).alias("peak"), *[F.col(f"c{a}").alias(a) for a in AXES])
    many = keep(voxels.where("n > 1"), "many")
    flooded = keep(flooded_centres(many, keys, size, edge), "flooded")
    rest = keep(many.join(flooded.select(*keys).distinct(), keys, "left_anti"), "rest")
    reach = max(2, int(STEP * EXCLUDED / size))
    spaced = _numbered(spaced_maxima(rest, keys, reach, max(edge, reach)), keys).join(rest.select(*keys, "n").distinct(), keys).where("peak <= n")
    full = spaced.groupBy(*keys).agg(F.count("*").alias("found"), F.first("n").alias("n")).where("found = n").select(*keys)
    spaced = keep(spaced.join(full, keys, "left_semi").select(*keys, "peak", *[F.col(a).cast("double").alias(a) for a in AXES]), "spaced")
    last = rest.join(spaced.select(*keys).distinct(), keys, "left_anti")
    means = kernels.weighted_kmeans(last.select(*keys, "density", F.col("n").cast("int").alias("n"), *AXES), keys).withColumn("peak", F.col("peak") + 1)
    parts = {"centre": single, "flood": flooded, "exclusion": spaced, "k-means": means}
    out = [p.select(*keys, F.col("peak").cast("int").alias("peak"), *AXES, F.lit(name).alias("way")) for name, p in parts.items()]
    return keep(out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]), "sites")


def mask_candidates(voxels: DataFrame, keys: list[str], separation: float, size: float = 1.0, edge: int = BLOCK) -> DataFrame:
    """keys, z, y, x, density: local maxima in a cube of separation / ``size`` voxels around, suppressed greedily to
    ``separation``."""
    maxima = grid.local_maxima(voxels.select(*keys, *AXES, "density"), max(1, int(separation / size)), keys=tuple(keys))
    return spaced_maxima(maxima, keys, separation / size, max(edge, int(separation / size) + 1))
