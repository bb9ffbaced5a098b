"""Atom groups, density targets, layout inference and structure edits as projections, joins and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .placement import cap_position
from .spatial import box_means

# Atoms by group, and residue names by base.
P_GROUP = ("P", "OP1", "OP2")
SUGAR_GROUP = ("O5'", "C5'", "C4'", "O4'", "C3'", "O3'", "C2'", "O2'", "C1'")
BASE_GROUP = ("N9", "N7", "C8", "N1", "C2", "C6", "N3", "C4", "C5", "N6", "O6", "N2", "O2", "N4", "O4")
RESIDUE_NAMES = {"A": ("A", "ADE", "RA", "DA"), "C": ("C", "CYT", "RC", "DC"), "G": ("G", "GUA", "RG", "DG"), "U": ("U", "URA", "RU", "DU", "DT", "T")}
PURINES, PYRIMIDINES = ("A", "G"), ("C", "U")


def canonical_base(name: Column) -> Column:
    """A, C, G or U of a residue name; a terminal 3 or 5 counts behind a single base letter only. Null for others."""
    plain = F.regexp_replace(F.upper(name), "^([ACGU])[35]$", "$1")
    out = F.lit(None).cast("string")
    for base, names in RESIDUE_NAMES.items():
        out = F.when(plain.isin(*names), base).otherwise(out)
    return out


def group_classes(atom: Column, residue: Column, typed: Column) -> Column:
    """Classes of the label grid in which an atom may lie: an array, null for an atom of no group.

    p group 1, sugar 2; the base group is 3 in the four-class layout, 3 or 4 by residue in the typed one, and both for
    an unknown residue.
    """
    base = canonical_base(residue)
    of_base = F.when(~typed, F.array(F.lit(3))).when(base.isin(*PURINES), F.array(F.lit(3))).when(base.isin(*PYRIMIDINES), F.array(F.lit(4))).otherwise(F.array(F.lit(3), F.lit(4)))
    return F.when(atom.isin(*P_GROUP), F.array(F.lit(1))).when(atom.isin(*SUGAR_GROUP), F.array(F.lit(2))).when(atom.isin(*BASE_GROUP), of_base)


def layout(schema: Column, class_names: Column, n_classes: Column, largest: Column) -> Column:
    """typed or four: by an explicit schema, else by class names, else by their number, else by the largest label."""
    named = lambda *names: F.array_size(F.array_intersect(class_names, F.array(*map(F.lit, names)))) == len(names)
    by_schema = F.when(schema.contains("pyrimidine"), "typed").when(schema.contains("base"), "four")
    by_names = F.when(named("purine", "pyrimidine"), "typed").when(class_names.isNotNull() & (F.array_size(class_names) > 0) & F.array_contains(class_names, "base"), "four")
    by_count = F.when(n_classes == 5, "typed").when(n_classes == 4, "four")
    return F.coalesce(by_schema, by_names, by_count, F.when(largest >= 4, "typed"), F.lit("four"))


def density_targets(atoms: DataFrame, voxels: DataFrame, half: float = 6.0) -> DataFrame:
    """id, target tx, ty, tz: mean of the voxel centres of the atom's classes in the box around it; atoms without any go.

    ``atoms``: id, classes, x, y, z; ``voxels``: class, x, y, z. Phosphorus atoms are kept in place elsewhere.
    """
    each = atoms.select("id", "x", "y", "z", F.explode("classes").alias("class"))
    m = box_means(each, voxels, half, keys=("class",))
    total = m.groupBy("id").agg(F.sum("n").alias("n"), *[F.sum(F.col(f"m{a}") * F.col("n")).alias(f"s{a}") for a in "xyz"])
    return total.where("n > 0").select("id", "n", *[(F.col(f"s{a}") / F.col("n")).alias(f"t{a}") for a in "xyz"])


def position_restraints(atoms: DataFrame, weight: float = 100000.0) -> DataFrame:
    """Harmonic restraints of the phosphorus atoms at their place: id, weight, targets in nm."""
    return atoms.where("atom = 'P'").select("id", F.lit(weight).alias("weight"), *[(F.col(a) / 10).alias(f"{a}_nm") for a in "xyz"])


# Residue and atom name of a cap.
CAP_RESIDUE, CAP_ATOM = "P5", "OP3"


def add_caps(atoms: DataFrame, keys: list[str], name: str = "base") -> DataFrame:
    """A row for each chain whose first residue has a known base and P, OP1, OP2 and O5': keys, residue_num, the residue
    name of a cap in the column ``name``, its atom, and the cap position.

    Caps form a chain of their own (the chain's name and ``_cap``) wherever they are written. A chain whose first
    residue lacks an atom, or has another name, has no cap.
    """
    first = atoms.join(atoms.groupBy(*keys).agg(F.min("residue_num").alias("residue_num")), [*keys, "residue_num"]).where(canonical_base(F.col(name)).isNotNull())
    names = {"P": "p", "OP1": "a", "OP2": "b", "O5'": "c"}
    wide = first.groupBy(*keys, "residue_num").agg(*[F.max(F.when(F.col("atom") == n, F.col(a))).alias(f"{k}{a}") for n, k in names.items() for a in "xyz"])
    whole = wide.where(" and ".join(f"{k}x is not null" for k in names.values()))
    point = cap_position(*[V.vec(*(f"{k}{a}" for a in "xyz")) for k in names.values()])
    return whole.select(*keys, "residue_num", F.lit(CAP_RESIDUE).alias(name), F.lit(CAP_ATOM).alias("atom"), *[c.alias(a) for c, a in zip(point, "xyz", strict=True)])


def strip_caps(atoms: DataFrame, name: str = "base") -> DataFrame:
    """Rows whose residue is no cap; an atom that merely bears a cap's name stays."""
    return atoms.where(~F.col(name).eqNullSafe(CAP_RESIDUE))


def drop_spurious_hydrogens(atoms: DataFrame, capped: DataFrame, keys: list[str]) -> DataFrame:
    """``atoms`` without HO5' in the residues of ``capped``."""
    return atoms.join(capped.select(*keys, "residue_num", F.lit("HO5'").alias("atom")), [*keys, "residue_num", "atom"], "left_anti")


def rename_last(residues: DataFrame, keys: list[str]) -> DataFrame:
    """``name``: the base, with a 3 behind it for the last residue of each chain."""
    order = Window.partitionBy(*keys).orderBy(F.desc("residue_num"))
    return residues.withColumn("name", F.when(F.row_number().over(order) == 1, F.concat("base", F.lit("3"))).otherwise(F.col("base")))
