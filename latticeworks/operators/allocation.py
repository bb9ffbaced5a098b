"""Sharing out a whole number among clusters by their volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_even
from ..session import shared_folder, written

#: Smallest volume that counts, the volume without any cluster, share and least number of the cap.
MIN_VOLUME, DEFAULT_UNIT, CAP_RATIO, CAP_LEAST = 10, 400.0, 2, 2


def unit_volume(clusters: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the typical volume of one unit: the median of the volumes within 30 % of the modal bin's middle.

    Bins: the range over 50, ten at least; the last bin is closed; the first of equally full bins wins. Keys without a
    volume of MIN_VOLUME get DEFAULT_UNIT.
    """
    counted = clusters.groupBy(*keys, "volume").agg(F.count("*").alias("n"))
    large = F.col("volume") >= MIN_VOLUME
    limits = counted.groupBy(*keys).agg(F.min(F.when(large, F.col("volume"))).alias("lo"), F.max(F.when(large, F.col("volume"))).alias("hi"))
    bins = F.greatest(F.lit(10), ((F.col("hi") - F.col("lo")) / 50).cast("int"))
    limits = limits.withColumn("bins", bins).withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    place = F.when(F.col("width") == 0, F.lit(0)).otherwise(F.least(F.col("bins") - 1, F.floor((F.col("volume") - F.col("lo")) / F.col("width")).cast("int")))
    filled = counted.where(large).join(limits, keys).groupBy(*keys, place.alias("bin")).agg(F.sum("n").alias("n"))
    fullest = filled.groupBy(*keys).agg((-F.max(F.struct("n", (-F.col("bin")).alias("least")))["least"]).alias("bin"))
    mode = limits.join(fullest, keys, "left").select(*keys, (F.col("lo") + (F.col("bin") + 0.5) * F.col("width")).alias("peak"))
    near = counted.where(large).join(mode, keys).where(F.col("volume").between(F.col("peak") * 0.7, F.col("peak") * 1.3)).groupBy(*keys).agg(F.percentile("volume", F.lit(0.5), F.col("n")).alias("median"))
    return mode.join(near, keys, "left").select(*keys, F.coalesce("median", "peak", F.lit(DEFAULT_UNIT)).alias("unit"))


def first_allocation(volume: Column, unit: Column, cap: Column | None = None) -> Column:
    """Volume over unit, halves to even, one at least; 0 below MIN_VOLUME. ``cap`` limits what is CAP_RATIO times it."""
    count = F.when(volume < MIN_VOLUME, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), half_even(volume / unit)))
    if cap is None:
        return count
    return F.when((volume >= MIN_VOLUME) & (cap >= CAP_LEAST) & (count >= CAP_RATIO * cap), cap.cast("long")).otherwise(count)


def adjust_allocation(clusters: DataFrame, keys: list[str], identity: str = "cluster") -> DataFrame:
    """``final``: the allocation brought to the key's ``target``, from columns volume, unit, alloc and target.

    Too many: rounds of one less for all above one, smallest fraction first, then the smallest clusters go to 0. Too
    few: rounds of one more, largest fraction first. Rounds are counted from the histogram of allocations, not run; who
    still changes in the last one is counted bucket by bucket of its order, and ranked only within a bucket of the key.
    ``clusters`` are written once, as the facts and the buckets read them too.
    """
    clusters = written(clusters, shared_folder(clusters.sparkSession))
    live = F.col("alloc") > 0
    levels = clusters.groupBy(*keys, "alloc").agg(F.count("*").alias("n"), F.first("target").alias("t"))
    alive = lambda c: F.when(live, c)
    facts = levels.groupBy(*keys).agg(
        F.array_sort(F.collect_list(alive(F.struct((F.col("alloc") - 1).cast("long").alias("level"), "n")))).alias("levels"), F.sum(alive(F.col("n"))).alias("m"),
        F.sum(alive((F.col("alloc") - 1) * F.col("n"))).alias("spare"), (F.sum(alive(F.col("alloc") * F.col("n"))) - F.first("t")).alias("over"),
    )

    def lower(state, level):
        """Whole rounds until the next allocation is used up, or as many as ``over`` allows."""
        width = level["level"] - state["rounds"]
        go = F.when(state["full"], 0).otherwise(F.least(width, F.floor((F.col("over") - state["gone"]) / state["left"]))).cast("long")
        return F.struct((state["rounds"] + go).alias("rounds"), (state["gone"] + go * state["left"]).alias("gone"), (state["left"] - level["n"]).alias("left"), (state["full"] | (go < width)).alias("full"))

    none = F.lit(0).cast("long")
    less, drop, more = F.col("over") > 0, F.col("over") > F.col("spare"), F.col("over") < 0
    done = F.when(less, F.aggregate("levels", F.struct(none.alias("rounds"), none.alias("gone"), F.col("m").alias("left"), F.lit(False).alias("full")), lower))
    quota = F.when(drop, F.col("over") - F.col("spare")).when(less, F.col("over") - F.col("done.gone")).when(more, -F.col("over") % F.col("m"))
    facts = facts.withColumn("done", done).select(*keys, "m", "spare", "over", F.coalesce("done.rounds", none).alias("rounds"), quota.alias("quota"))

    exact = F.col("volume") / F.col("unit")
    frac = F.when(F.col("volume") >= MIN_VOLUME, exact - F.floor(exact)).otherwise(0.0)
    rows = clusters.join(facts, keys, "left").withColumn("_first", F.when(drop, F.col("volume").cast("double")).when(less, frac).otherwise(-frac)).withColumn("_second", F.when(drop, 0).otherwise(-F.col("volume")))
    rows = rows.withColumn("_open", F.coalesce(live & (F.col("quota") > 0) & (drop | more | (F.col("alloc") - 1 > F.col("rounds"))), F.lit(False)))
    rows = rows.withColumn("_bucket", F.when(F.col("_open"), F.when(drop, F.floor(F.log2(F.greatest("_first", F.lit(0.0)) + 1) * 64)).otherwise(F.floor(F.col("_first") * 1024))).otherwise(F.pmod(F.xxhash64(identity), F.lit(4096))))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    buckets = rows.where("_open").groupBy(*keys, "_bucket").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(before, none))
    rank = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(F.desc("_open"), "_first", "_second", identity))
    rows = rows.join(buckets.select(*keys, "_bucket", "_before"), [*keys, "_bucket"], "left").withColumn("_rank", rank)
    chosen = F.when(F.col("_open") & (F.col("_before") + F.col("_rank") <= F.col("quota")), 1).otherwise(0)
    lowered = F.col("alloc") - F.least(F.col("alloc") - 1, F.col("rounds")) - chosen
    final = F.when(~live, 0).when(drop, 1 - chosen).when(less, lowered).when(more, F.col("alloc") + F.floor(-F.col("over") / F.col("m")) + chosen).otherwise(F.col("alloc"))
    return rows.select(*clusters.columns, final.cast("long").alias("final"))
