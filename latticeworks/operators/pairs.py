"""Base pairs: decoding, normalising, stacks, satisfaction, partners and their dimension joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distances between which a pair's two sites count as paired.
PAIR_NEAR, PAIR_FAR = 15.0, 22.0
# Hydrogen bonds of ordered base pairs, atom names and distance.
HYDROGEN_BONDS = (
    ("A", "U", "N6", "O4", 2.95), ("A", "U", "N1", "N3", 2.82),
    ("U", "A", "O4", "N6", 2.95), ("U", "A", "N3", "N1", 2.82),
    ("G", "C", "O6", "N4", 2.91), ("G", "C", "N1", "N3", 2.95), ("G", "C", "N2", "O2", 2.86),
    ("C", "G", "N4", "O6", 2.91), ("C", "G", "N3", "N1", 2.95), ("C", "G", "O2", "N2", 2.86),
    ("G", "U", "O6", "N3", 2.8), ("G", "U", "N1", "O2", 2.84),
    ("U", "G", "N3", "O6", 2.8), ("U", "G", "O2", "N1", 2.84),
)


def decode_pairs(scored: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Greedy matching per key: pairs (i, j, prob) above ``threshold`` in the order (-prob, i, j), each end once.

    A key's pairs are folded in that order over one sorted array; keys are sequences, whose pairs are few.
    """
    order = F.sort_array(F.collect_list(F.struct((-F.col("prob")).alias("q"), "i", "j")))
    state = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<i:int,j:int,prob:double>>").alias("kept"))

    def take(s, p):
        free = ~F.array_contains(s["used"], p["i"]) & ~F.array_contains(s["used"], p["j"])
        new = F.struct(p["i"].cast("int").alias("i"), p["j"].cast("int").alias("j"), (-p["q"]).alias("prob"))
        return F.when(free, F.struct(F.concat(s["used"], F.array(p["i"].cast("int"), p["j"].cast("int"))).alias("used"), F.array_append(s["kept"], new).alias("kept"))).otherwise(s)

    folded = scored.where(F.col("prob") > threshold).groupBy(*keys).agg(order.alias("o")).select(*keys, F.aggregate("o", state, take)["kept"].alias("kept"))
    return folded.select(*keys, F.explode("kept").alias("_pair")).select(*keys, "_pair.i", "_pair.j", "_pair.prob")


def normalize_pairs(pairs: DataFrame, keys: list[str], length: int) -> DataFrame:
    """i < j, both in 1..length, each pair once."""
    ends = pairs.select(*keys, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    return ends.where((F.col("i") >= 1) & (F.col("j") <= length) & (F.col("i") != F.col("j"))).distinct()


def stacks(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b) with (c, d) = (a + 1, b - 1), both pairs of the key; keys are called none of a, b, c, d."""
    outer = pairs.select(*keys, F.col("i").alias("a"), F.col("j").alias("b"), (F.col("i") + 1).alias("c"), (F.col("j") - 1).alias("d"))
    inner = pairs.select(*keys, F.col("i").alias("c"), F.col("j").alias("d"))
    return outer.join(inner, [*keys, "c", "d"]).select(*keys, "a", "b", "c", "d")


def pair_distance_ok(d: Column) -> Column:
    return d.between(PAIR_NEAR, PAIR_FAR)


def pair_distances(pairs: DataFrame, sites: DataFrame, keys: list[str]) -> DataFrame:
    """``pairs`` whose two residues have a site (keys, residue_num, x, y, z), with their distance d."""
    end = lambda k: sites.select(*keys, F.col("residue_num").alias(k), *[F.col(a).alias(f"{k}{a}") for a in "xyz"])
    joined = pairs.join(end("i"), [*keys, "i"]).join(end("j"), [*keys, "j"])
    square = sum(((F.col(f"i{a}") - F.col(f"j{a}")) * (F.col(f"i{a}") - F.col(f"j{a}")) for a in "yz"), (F.col("ix") - F.col("jx")) * (F.col("ix") - F.col("jx")))
    return joined.select(*pairs.columns, F.sqrt(square).alias("d"))


def satisfaction(pairs: DataFrame, sites: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: total pairs with both sites, satisfied ones, and their ratio (null without pairs)."""
    d = pair_distances(pairs, sites, keys)
    ok = F.sum(F.when(pair_distance_ok(F.col("d")), 1).otherwise(0))
    return d.groupBy(*keys).agg(F.count("*").alias("total"), ok.alias("satisfied")).withColumn("ratio", F.try_divide(F.col("satisfied"), F.col("total")))


def stacks_satisfied(stack: DataFrame, pairs_with_d: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the number of stacks of which both pairs are satisfied."""
    good = pairs_with_d.where(pair_distance_ok(F.col("d"))).select(*keys, "i", "j")
    both = stack.join(good.select(*keys, F.col("i").alias("a"), F.col("j").alias("b")), [*keys, "a", "b"]).join(good.select(*keys, F.col("i").alias("c"), F.col("j").alias("d")), [*keys, "c", "d"])
    return both.groupBy(*keys).agg(F.count("*").alias("stacks"))


def partners(pairs: DataFrame, keys: list[str], order: str, canonical_only: bool = True, missing_is_canonical: bool = False) -> DataFrame:
    """residue_num, partner in both directions; of several partners the last in ``order`` stays."""
    flag = F.coalesce("canonical", F.lit(missing_is_canonical))
    rows = pairs.where(flag) if canonical_only else pairs
    one = rows.select(*keys, F.col("i").alias("residue_num"), F.col("j").alias("partner"), F.struct(F.col(order), F.lit(0)).alias("o"))
    two = rows.select(*keys, F.col("j").alias("residue_num"), F.col("i").alias("partner"), F.struct(F.col(order), F.lit(1)).alias("o"))
    return one.union(two).groupBy(*keys, "residue_num").agg(F.max_by("partner", "o").alias("partner"))


def orientation_score(assigned: DataFrame, base_pairs: DataFrame, sites: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the satisfied pairs of its path read forward and backward: orientation, total, satisfied, ratio.

    The path of a key ends at its largest residue_num. Keys without pairs have no row.
    """
    length = assigned.groupBy(*keys).agg(F.max("residue_num").alias("length"))
    forward = assigned.select(*keys, F.lit("forward").alias("orientation"), "residue_num", "site")
    backward = assigned.join(length, keys).select(*keys, F.lit("reverse").alias("orientation"), (F.col("length") + 1 - F.col("residue_num")).alias("residue_num"), "site")
    placed = forward.union(backward).join(sites, [*keys, "site"]).select(*keys, "orientation", "residue_num", "x", "y", "z")
    both = base_pairs.withColumn("orientation", F.explode(F.array(F.lit("forward"), F.lit("reverse"))))
    return satisfaction(both, placed, [*keys, "orientation"])


def group_agreement(pairs: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the sum of confidences of residues whose group agrees with the expected one, minus the others'."""
    signed = F.when((F.col("grp") == 0) | (F.col("expected") == 0), 0.0).when(F.col("grp") == F.col("expected"), F.col("conf")).otherwise(-F.col("conf"))
    return pairs.join(groups, [*keys, "residue_num"]).groupBy(*keys).agg(F.sum(signed).alias("score"))


def anchor_agreement(anchored: DataFrame, assigned: DataFrame, keys: list[str]) -> DataFrame:
    """Per key how many anchored (site, residue_num) the assignment has too: matched, total, ratio, percent."""
    a = assigned.select(*keys, "site", "residue_num", F.lit(1).alias("hit"))
    joined = anchored.join(a, [*keys, "site", "residue_num"], "left").groupBy(*keys).agg(F.count("*").alias("total"), F.count("hit").alias("matched"))
    ratio = F.col("matched") / F.col("total")
    return joined.select(*keys, "matched", "total", ratio.alias("ratio"), F.bround(ratio * 100, 1).alias("percent"))


def take_unused(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows (site, residue_num) in ``order`` whose site and residue no earlier kept row has, per key."""
    seq = F.sort_array(F.collect_list(F.struct(order, "site", "residue_num")))
    state = F.struct(F.array().cast("array<struct<site:long,residue_num:long>>").alias("kept"))

    def take(s, r):
        seen = F.exists(s["kept"], lambda k: (k["site"] == r["site"]) | (k["residue_num"] == r["residue_num"]))
        new = F.struct(r["site"].cast("long").alias("site"), r["residue_num"].cast("long").alias("residue_num"))
        return F.when(seen, s).otherwise(F.struct(F.array_append(s["kept"], new).alias("kept")))

    folded = rows.groupBy(*keys).agg(seq.alias("o")).select(*keys, F.explode(F.aggregate("o", state, take)["kept"]).alias("_pick"))
    return folded.select(*keys, "_pick.site", "_pick.residue_num")


def hydrogen_bonds(spark) -> DataFrame:
    """The dimension table base_i, base_j, atom_i, atom_j, target."""
    return spark.createDataFrame(list(HYDROGEN_BONDS), "base_i string, base_j string, atom_i string, atom_j string, target double")


def bond_restraints(pairs: DataFrame, atoms: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each hydrogen bond of each pair (i, j, base_i, base_j) whose two atoms exist (residue_num, atom)."""
    specs = pairs.join(F.broadcast(hydrogen_bonds(pairs.sparkSession)), ["base_i", "base_j"])
    end = lambda k: atoms.select(*keys, F.col("residue_num").alias(k), F.col("atom").alias(f"atom_{k}"))
    return specs.join(end("i"), [*keys, "i", "atom_i"], "left_semi").join(end("j"), [*keys, "j", "atom_j"], "left_semi")


def adjacent_bonds(chain: DataFrame, bonded: DataFrame, keys: list[str], longest: float) -> DataFrame:
    """Neighbouring residues of a chain whose o (ox, oy, oz) and next p (px, py, pz) are near and not bonded yet."""
    order = Window.partitionBy(*keys).orderBy("residue_num")
    nxt = chain.withColumn("next", F.lead("residue_num").over(order))
    for a in "xyz":
        nxt = nxt.withColumn(f"n{a}", F.lead(f"p{a}").over(order))
    d = F.sqrt(sum(((F.col(f"o{a}") - F.col(f"n{a}")) * (F.col(f"o{a}") - F.col(f"n{a}")) for a in "yz"), (F.col("ox") - F.col("nx")) * (F.col("ox") - F.col("nx"))))
    near = nxt.withColumn("d", d).where((F.col("next").isNotNull()) & (F.col("d") <= longest))
    return near.join(bonded, [*keys, "residue_num"], "left_anti").select(*keys, "residue_num", "next", "d")
