"""Sparse three-dimensional grids: voxel(z, y, x, ...), one row per cell that is not empty."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, first_argmax


#: Rows among which a quantile is taken in one task; more are narrowed first.
QUANTILE_ROWS = 100_000


def exact_quantile(rows: DataFrame, value: str, quantile: float) -> DataFrame:
    """One row, ``upper``: the exact quantile, interpolated between the two ranks around it; null without any value.

    Approximate quantiles a little below and above it bound the values that matter, and counts tell how many lie under
    them; each round, run while the plan is built, leaves about a hundredth of the rows. What is left, at most
    QUANTILE_ROWS or rounds that no longer help (few distinct values), is counted by value, so no task holds a map of
    all values.
    """
    own = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    n = own.count()
    at = quantile * max(n - 1, 0)
    first, last, below, left = int(at), min(int(at) + 1, max(n - 1, 0)), 0, n
    while left > QUANTILE_ROWS:
        share = [max(0.0, (first - below) / left - 0.005), min(1.0, (last - below) / left + 0.005)]
        low, high = own.agg(F.percentile_approx("v", share, 2000)).first()[0]
        counts = own.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v") <= high)).first()
        if not below + counts[0] <= first or not last < below + counts[1] or counts[1] - counts[0] >= left:
            break
        own, below, left = own.where(F.col("v").between(low, high)), below + counts[0], counts[1] - counts[0]
        if low == high:
            break
    until = F.sum("n").over(Window.orderBy("v"))
    ranked = own.groupBy("v").agg(F.count("*").alias("n")).withColumn("until", until + below)
    holds = lambda rank: F.min(F.when(F.col("until") > rank, F.col("v")))
    return ranked.agg(holds(first).alias("a"), holds(last).alias("b")).select((F.col("a") + (F.col("b") - F.col("a")) * (at - first)).alias("upper"))


def normalize_density(voxels: DataFrame, contour: float, density: str = "density", quantile: float = 0.95) -> DataFrame:
    """Adds ``normalized``: density above ``contour`` scaled so that its ``quantile`` is 1, clipped to 0..1.

    The quantile is exact; an upper bound that is not above the contour, or no foreground at all, raises an error when
    the plan runs.
    """
    bound = exact_quantile(voxels.where(F.col(density) > contour), density, quantile)
    upper = F.when(F.col("upper") > contour, F.col("upper")).otherwise(F.raise_error(F.lit("no density above the contour")).cast("double"))
    scaled = clip((F.col(density) - contour) / (upper - contour), 0.0, 1.0)
    return voxels.join(F.broadcast(bound)).withColumn("normalized", scaled).drop("upper")


def normalize_each(voxels: DataFrame, keys: list[str], contour: float, quantile: float = 0.95) -> DataFrame:
    """:func:`normalize_density` for each key by its own quantile, found by rank in a sort that spills.

    A key whose quantile is no higher than the contour is an error; one without density above the contour gives no row.
    """
    above = voxels.where(F.col("density") > contour).select(*keys, F.col("density").cast("double").alias("density"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("density")) - 1
    ranked = above.withColumn("at", rank).join(above.groupBy(*keys).agg(((F.count("*") - 1) * quantile).alias("place")), keys)
    ends = ranked.where((F.col("at") == F.floor("place")) | (F.col("at") == F.ceil("place"))).groupBy(*keys).agg(F.min("density").alias("low"), F.max("density").alias("high"), F.first("place").alias("place"))
    upper = F.col("low") + (F.col("high") - F.col("low")) * (F.col("place") - F.floor("place"))
    usable = F.when(upper > contour, upper).otherwise(F.raise_error(F.lit("a map has no usable density range")).cast("double"))
    scaled = (F.col("density") - contour) / (F.col("upper") - contour)
    return voxels.join(ends.select(*keys, usable.alias("upper")), keys).withColumn("normalized", F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))).drop("upper")


def world_to_voxel(world: Column, origin: Column | float, spacing: Column | float) -> Column:
    """Voxel index of a coordinate, truncated toward zero."""
    return ((world - origin) / spacing).cast("int")


def voxel_to_world(voxel: Column, origin: Column | float, spacing: Column | float) -> Column:
    return voxel * spacing + origin


def weighted_centroids(voxels: DataFrame, keys: list[str], weight: str, axes: tuple[str, ...] = ("z", "y", "x")) -> DataFrame:
    """Per key: count, and the mean of each axis weighted by max(weight, 0); the plain mean where no weight is left."""
    w = F.greatest(F.col(weight), F.lit(0.0))
    total = F.sum(w)
    centers = [F.when(total > 0, F.sum(w * F.col(a)) / total).otherwise(F.avg(a)).alias(f"c{a}") for a in axes]
    return voxels.groupBy(*keys).agg(F.count("*").alias("n"), *centers)


def window_count(length: Column, size: int, overlap: int) -> Column:
    """How many windows an axis has."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    return F.when(length <= size, F.lit(1)).otherwise((F.ceil((length - size) / (size - overlap)) + 1).cast("int"))


def window_starts(length: Column, size: int, overlap: int) -> Column:
    """Array of starts of windows along an axis; the last window is clipped, not shifted back."""
    return F.transform(F.sequence(F.lit(0), window_count(length, size, overlap) - 1), lambda k: k * (size - overlap))


def patches(shape: DataFrame, size: int, overlap: int) -> DataFrame:
    """patch (order z, y, x), ib, ie, jb, je, kb, ke for each row (nz, ny, nx) of ``shape``; other columns stay."""
    out = shape
    for begin, n in (("ib", "nz"), ("jb", "ny"), ("kb", "nx")):
        out = out.withColumn(begin, F.explode(window_starts(F.col(n), size, overlap)))
    for end, begin, n in (("ie", "ib", "nz"), ("je", "jb", "ny"), ("ke", "kb", "nx")):
        out = out.withColumn(end, F.least(F.col(begin) + size, F.col(n)).cast("int"))
    step = size - overlap
    per = lambda n: window_count(F.col(n), size, overlap)
    order = ((F.col("ib") / step) * per("ny") + F.col("jb") / step) * per("nx") + F.col("kb") / step
    return out.withColumn("patch", order.cast("long"))


def assign_patches(voxels: DataFrame, shape: DataFrame, size: int, overlap: int) -> DataFrame:
    """Each voxel with every patch that covers it: ib, jb, kb and patch, by arithmetic instead of a range join.

    Voxels outside ``shape`` lie in no patch and go.
    """
    step = size - overlap
    out = voxels.join(F.broadcast(shape))
    for begin, axis, n in (("ib", "z", "nz"), ("jb", "y", "ny"), ("kb", "x", "nx")):
        last = window_count(F.col(n), size, overlap) - 1
        low = F.greatest(F.lit(0), F.ceil((F.col(axis) - size + 1) / step).cast("int"))
        high = F.least(last, F.floor(F.col(axis) / step).cast("int"))
        out = out.withColumn(begin, F.explode(F.when(low <= high, F.transform(F.sequence(low, high), lambda k: k * step))))
    per = lambda n: window_count(F.col(n), size, overlap)
    order = ((F.col("ib") / step) * per("ny") + F.col("jb") / step) * per("nx") + F.col("kb") / step
    return out.withColumn("patch", order.cast("long")).drop("nz", "ny", "nx")


def keep_best(rows: DataFrame, keys: list[str], score: Column, tie: str) -> DataFrame:
    """One row per key, the one with the largest ``score``, then the smallest ``tie`` (a number).

    An aggregate, so that rows of one key meet before the shuffle; a null score loses to any other.
    """
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(score.isNotNull(), score, -F.col(tie))).alias("_row"))
    return best.select(*keys, "_row.*")


def merge_by_certainty(predictions: DataFrame, prob: str = "prob") -> DataFrame:
    """Of overlapping patches each voxel keeps the probability farthest from 0.5; the first patch wins ties."""
    return keep_best(predictions, ["z", "y", "x"], F.abs(F.col(prob) - 0.5), "patch")


def merge_by_confidence(predictions: DataFrame, probs: str = "probs") -> DataFrame:
    """Of overlapping patches each voxel keeps the class vector with the largest maximum; the first patch wins ties."""
    return keep_best(predictions, ["z", "y", "x"], F.array_max(probs), "patch")


def combine_labels(prob: Column, group: Column, threshold: Column | float) -> Column:
    """group + 1 where the probability is above the threshold, else 0."""
    return F.when(prob > threshold, group + 1).otherwise(0).cast("int")


def ensemble(a: Column, b: Column) -> Column:
    """Element-wise mean of two class vectors."""
    return F.zip_with(a, b, lambda x, y: x * 0.5 + y * 0.5)


def ensemble_label(prob_a: Column, prob_b: Column, groups_a: Column, groups_b: Column, threshold: float) -> Column:
    """Label of an ensemble: mean probability as float32 against the threshold, then the first largest mean class."""
    return combine_labels((prob_a * 0.5 + prob_b * 0.5).cast("float"), first_argmax(ensemble(groups_a, groups_b)), F.lit(threshold).cast("float"))


def _boxed(left: DataFrame, right: DataFrame, radius: int, axes: tuple[str, ...], keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame, list[str], Column]:
    """Both sides by box, the columns to join on, and the condition that l and r differ by ``radius`` at most."""
    edge = 2 * radius + 1
    home = lambda a: F.floor(F.col(a) / edge)
    l = left.select(F.struct(*left.columns).alias("l"), *[F.col(k).alias(f"k_{k}") for k in keys], *[home(a).alias(f"b_{a}") for a in axes])
    reach = [F.array_distinct(F.array(F.floor((F.col(a) - radius) / edge), F.floor((F.col(a) + radius) / edge))) for a in axes]
    r = right.select(F.struct(*right.columns).alias("r"), *[F.col(k).alias(f"k_{k}") for k in keys], *[x.alias(f"b_{a}") for x, a in zip(reach, axes, strict=True)])
    for a in axes:
        r = r.withColumn(f"b_{a}", F.explode(f"b_{a}"))
    near = F.lit(True)
    for a in axes:
        near = near & (F.abs(F.col("l")[a] - F.col("r")[a]) <= radius)
    return l, r, [*(f"k_{k}" for k in keys), *(f"b_{a}" for a in axes)], near


def box_join(left: DataFrame, right: DataFrame, radius: int, axes: tuple[str, ...] = ("z", "y", "x"), keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of left and right rows whose integer axes differ by ``radius`` at most, as structs l and r.

    Both sides go to boxes of edge 2 * radius + 1; the right side also to the neighbouring boxes that it can reach, so
    the join has equality keys and no cell is compared with the whole grid.
    """
    l, r, on, near = _boxed(left, right, radius, axes, keys)
    return l.join(r, on).where(near).select("l", "r")


def local_maxima(voxels: DataFrame, radius: int, value: str = "density", keys: tuple[str, ...] = ()) -> DataFrame:
    """Voxels whose value is the largest in the cube of ``radius`` around them; all cells of a plateau stay.

    One anti join by box: a voxel goes at the first higher one in its reach, and no pair leaves the join.
    """
    l, r, on, near = _boxed(voxels, voxels, radius, ("z", "y", "x"), keys)
    same = near & (F.col("r")[value] > F.col("l")[value])
    r = r.select("r", *[F.col(c).alias(f"_{c}") for c in on])
    for c in on:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return l.join(r, same, "left_anti").select("l.*")


def neighbour_offsets(connectivity: int) -> list[tuple[int, int, int]]:
    """Half of the 6, 18 or 26 neighbour offsets (each pair once)."""
    most = {6: 1, 18: 2, 26: 3}[connectivity]
    return [d for d in product((-1, 0, 1), repeat=3) if d > (0, 0, 0) and sum(map(abs, d)) <= most]


def grid_edges(voxels: DataFrame, connectivity: int, keys: tuple[str, ...] = (), identity: str = "id") -> DataFrame:
    """Edges a, b between neighbouring voxels of equal keys; each offset is one equality join side."""
    offsets = F.array(*[F.struct(F.lit(dz).alias("dz"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dz, dy, dx in neighbour_offsets(connectivity)])
    moved = voxels.withColumn("d", F.explode(offsets)).select(*keys, F.col(identity).alias("a"), *[(F.col(a) + F.col(f"d.d{a}")).alias(a) for a in "zyx"])
    return moved.join(voxels.select(*keys, "z", "y", "x", F.col(identity).alias("b")), [*keys, "z", "y", "x"]).select("a", "b")
