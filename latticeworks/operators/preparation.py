"""Preparing a map: small pieces removed, resampled to another spacing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import by_group, shared_folder, written
from . import graph, grid

AXES = ("z", "y", "x")
#: Voxels of the new grid along each edge of the block that one group makes.
EDGE = 32


def without_dust(voxels: DataFrame, keys: list[str], contour: float, size: float, spacing: tuple[Column | float, ...] = (1.0, 1.0, 1.0), connectivity: int = 18) -> DataFrame:
    """The rows of ``voxels`` (keys, z, y, x, density) above ``contour`` in pieces whose longest edge is ``size`` or more.

    A piece is a component of ``connectivity`` neighbours; its edges are those of its box, whole voxels of ``spacing``
    (z, y, x; numbers or columns that are constant in a map). Rows with a null density go. A place must come once in a map.
    """
    above = voxels.where(F.col("density") > contour).withColumn("id", F.struct(*keys, *AXES))
    named = above.join(graph.connected_components(above, grid.grid_edges(above, connectivity, keys=tuple(keys))), "id")
    edges = [(F.max(a) - F.min(a) + 1) * F.max(F.lit(s)) for a, s in zip(AXES, spacing, strict=True)]
    large = named.groupBy("component").agg(F.greatest(*edges).alias("edge")).where(F.col("edge") >= size)
    return named.join(large.select("component"), "component", "left_semi").select(*voxels.columns)


def _blocks(place: Column, last: Column, step: Column, edge: int) -> Column:
    """Blocks of the new grid with a place less than one old voxel from ``place``; none of them may be left."""
    first = F.greatest(F.ceil((place - 1) / step), F.lit(0))
    end = F.least(F.floor((place + 1) / step), F.floor((last - 1) / step + 1e-9))
    return F.when(first <= end, F.sequence(F.floor(first / edge), F.floor(end / edge)))


def resample(voxels: DataFrame, sizes: DataFrame, keys: list[str], step: tuple[Column | float, ...], edge: int = EDGE) -> DataFrame:
    """keys, z, y, x, density (double, not 0) of the grid whose voxel k lies at k times ``step`` (z, y, x) old voxels; a step is a
    number or a column of ``sizes``.

    Densities are interpolated along each axis between the old voxels around a place; absent and null ones count as 0.
    ``sizes`` (keys, nz, ny, nx) says how far a map goes: places beyond its last voxel are left out, and so are maps that
    it does not name. A voxel goes to the blocks that it touches, nearly always one, and each block, at most
    (edge * step + 2) old voxels along an axis, is made on its own. A place must come once in a map.
    """
    rows = voxels.where("density <> 0").select(*keys, *AXES, F.col("density").cast("double").alias("density"))
    rows = rows.join(sizes.select(*keys, "nz", "ny", "nx", *[F.lit(s).cast("double").alias(f"s{a}") for a, s in zip(AXES, step, strict=True)]), keys)
    for a in AXES:
        rows = rows.withColumn(f"b{a}", F.explode(_blocks(F.col(a), F.col(f"n{a}"), F.col(f"s{a}"), edge)))

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[0]
        by = [float(head[f"s{a}"]) for a in AXES]
        first = [int(head[f"b{a}"]) * edge for a in AXES]
        ends = [min(f + edge, int(np.floor((head[f"n{a}"] - 1) / s + 1e-9)) + 1) for f, a, s in zip(first, AXES, by, strict=True)]
        places = [np.arange(f, e) * s for f, e, s in zip(first, ends, by, strict=True)]
        low = [int(p[0]) for p in places]
        box = np.zeros([int(p[-1]) - lo + 2 for p, lo in zip(places, low, strict=True)])
        at = [pdf[a].to_numpy() - lo for a, lo in zip(AXES, low, strict=True)]
        inside = np.logical_and.reduce([(k >= 0) & (k < n) for k, n in zip(at, box.shape, strict=True)])
        box[tuple(k[inside] for k in at)] = pdf["density"].to_numpy()[inside]
        for axis, (p, lo) in enumerate(zip(places, low, strict=True)):
            below = np.floor(p).astype(int)
            part = (p - below).reshape([-1 if k == axis else 1 for k in range(3)])
            box = np.take(box, below - lo, axis) * (1 - part) + np.take(box, below - lo + 1, axis) * part
        found = np.nonzero(box)
        out = {k: head[k] for k in keys} | {a: (k + f).astype(np.int32) for a, k, f in zip(AXES, found, first, strict=True)}
        return pd.DataFrame(out | {"density": box[found]})

    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField(a, T.IntegerType()) for a in AXES] + [T.StructField("density", T.DoubleType())])
    return by_group(rows, [*keys, "bz", "by", "bx"], make, schema)


def prepare(voxels: DataFrame, sizes: DataFrame, keys: list[str], contour: float, spacing: tuple[float, float, float], size: float = 25.0, target: float = 0.5, edge: int = EDGE) -> DataFrame:
    """keys, z, y, x, density of maps without dust, resampled to ``target`` and again without dust.

    ``spacing`` (z, y, x) is that of ``voxels``. What lies in no piece is 0 before it is resampled. Written once, since
    components read it several times.
    """
    folder = shared_folder(voxels.sparkSession)
    masked = without_dust(voxels.select(*keys, *AXES, "density"), keys, contour, size, spacing)
    fine = written(resample(masked, sizes, keys, tuple(target / s for s in spacing), edge), f"{folder}/fine")
    return without_dust(fine, keys, contour, size, (target, target, target))
