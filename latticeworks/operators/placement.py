"""Residue frames, rigid placement of templates, orientation scans and fixed-width output."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

# Atoms of one nucleotide, coordinates relative to its phosphorus; the first twelve are every base's.
BACKBONE = (
    ("P", 0.0, 0.0, 0.0), ("OP1", 0.16, 0.83, -1.22), ("OP2", -1.17, -0.9, 0.01), ("O5'", 1.33, -0.84, 0.25), ("C5'", 2.56, 0.0, 0.3), ("C4'", 3.66, -0.99, 0.63),
    ("O4'", 3.43, -1.55, 1.95), ("C3'", 3.71, -2.16, -0.33), ("O3'", 4.33, -1.88, -1.58), ("C2'", 4.5, -3.2, 0.48), ("O2'", 5.9, -3.03, 0.6), ("C1'", 3.81, -2.93, 1.82),
)
BASES = {
    "A": (("N9", 2.58, -3.72, 2.02), ("C8", 1.31, -3.23, 2.26), ("N7", 0.37, -4.11, 2.4), ("C5", 1.02, -5.34, 2.25), ("C6", 0.51, -6.65, 2.28), ("N6", -0.79, -6.92, 2.47), ("N1", 1.37, -7.69, 2.07), ("C2", 2.65, -7.45, 1.88), ("N3", 3.22, -6.26, 1.84), ("C4", 2.35, -5.23, 2.04)),
    "G": (("N9", 2.58, -3.72, 2.02), ("C8", 1.31, -3.23, 2.26), ("N7", 0.37, -4.11, 2.4), ("C5", 1.02, -5.34, 2.25), ("C6", 0.51, -6.65, 2.28), ("O6", -0.69, -6.92, 2.47), ("N1", 1.37, -7.69, 2.07), ("C2", 2.65, -7.45, 1.88), ("N2", 3.35, -8.58, 1.68), ("N3", 3.22, -6.26, 1.84), ("C4", 2.35, -5.23, 2.04)),
    "C": (("N1", 2.58, -3.72, 2.02), ("C2", 1.56, -4.69, 2.09), ("O2", 0.39, -4.37, 2.24), ("N3", 1.91, -5.97, 1.95), ("C4", 3.18, -6.33, 1.74), ("N4", 3.45, -7.62, 1.61), ("C5", 4.21, -5.33, 1.68), ("C6", 3.87, -4.05, 1.82)),
    "U": (("N1", 2.58, -3.72, 2.02), ("C2", 1.56, -4.69, 2.09), ("O2", 0.39, -4.37, 2.24), ("N3", 1.91, -5.97, 1.95), ("C4", 3.18, -6.33, 1.74), ("O4", 3.45, -7.52, 1.61), ("C5", 4.21, -5.33, 1.68), ("C6", 3.87, -4.05, 1.82)),
}
#: The atoms that should point at a base's partner.
KEY_ATOMS = {"A": ("N1", "N6"), "G": ("N1", "O6"), "C": ("N3", "N4"), "U": ("N3", "O4")}


def templates(spark: SparkSession) -> DataFrame:
    """base, atom_ord, atom, element, tx, ty, tz: 22, 23, 20 and 20 atoms."""
    rows = [(base, k, name, name[0], x, y, z) for base, own in BASES.items() for k, (name, x, y, z) in enumerate(BACKBONE + own)]
    return spark.createDataFrame(rows, "base string, atom_ord int, atom string, element string, tx double, ty double, tz double")


def template_frame() -> tuple[tuple[float, ...], tuple[float, ...], tuple[float, ...]]:
    """Axes of the template: toward O3', toward C1' made orthogonal, and their cross product; the same for all bases."""
    at = {name: (x, y, z) for name, x, y, z in BACKBONE}
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    unit = lambda a: tuple(p / (math.sqrt(dot(a, a)) + V.EPS) for p in a)
    x = unit(at["O3'"])
    c1 = at["C1'"]
    y = unit(tuple(c - dot(c1, x) * a for c, a in zip(c1, x, strict=True)))
    z = unit((x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0]))
    return x, y, z


def local_frames(chain: DataFrame, keys: list[str]) -> DataFrame:
    """``chain`` (keys, residue_num, x, y, z, optional partner qx, qy, qz) with frame structs fx, fy, fz.

    fx runs from the previous to the next residue in order (one-sided at the ends, the x axis alone); fy is the
    partner's direction orthogonal to fx if the partner is over 1 away and that part over 0.3, else an up vector that is
    not near fx; fz completes the frame. The order is that of rows, not of residue numbers' distance.
    """
    order = Window.partitionBy(*keys).orderBy("residue_num")
    here = V.vec("x", "y", "z")
    shifted = lambda f: tuple(f(a).over(order) for a in ("x", "y", "z"))
    rows = chain.withColumn("_p", V.packed(shifted(F.lag))).withColumn("_n", V.packed(shifted(F.lead)))
    p, n = V.unpacked(F.col("_p")), V.unpacked(F.col("_n"))
    both, next_only, prev_only = p[0].isNotNull() & n[0].isNotNull(), n[0].isNotNull(), p[0].isNotNull()
    along = V.pick(both, V.sub(n, p), V.pick(next_only, V.sub(n, here), V.pick(prev_only, V.sub(here, p), V.const(1, 0, 0))))
    rows = rows.withColumn("fx", V.packed(V.unit(along)))
    fx = V.unpacked(F.col("fx"))
    if "qx" in chain.columns:
        toward = V.sub(V.vec("qx", "qy", "qz"), here)
        far = V.norm(toward)
        rows = rows.withColumn("_q", V.packed(V.scale(toward, 1 / far))).withColumn("_far", F.coalesce(far > 1.0, F.lit(False)))
        q = V.unpacked(F.col("_q"))
        rows = rows.withColumn("_across", V.packed(V.sub(q, V.scale(fx, V.dot(q, fx)))))
        size = V.norm(V.unpacked(F.col("_across")))
        use, partner_y = F.col("_far") & (size > 0.3), V.scale(V.unpacked(F.col("_across")), 1 / size)
    else:
        use, partner_y = F.lit(False), V.const(0, 0, 0)
    steep = F.abs(fx[2]) > 0.9
    up = V.pick(steep, V.pick(F.abs(fx[1]) > 0.9, V.const(1, 0, 0), V.const(0, 1, 0)), V.const(0, 0, 1))
    plain_y = V.unit(V.sub(up, V.scale(fx, V.dot(up, fx))))
    rows = rows.withColumn("fy", V.packed(V.pick(use, partner_y, plain_y)))
    rows = rows.withColumn("fz", V.packed(V.unit(V.cross(fx, V.unpacked(F.col("fy"))))))
    return rows.drop("_p", "_n", "_q", "_far", "_across")


def place_templates(framed: DataFrame) -> DataFrame:
    """Every atom of each framed residue (base, x, y, z, fx, fy, fz): atom_ord, atom, element, ax, ay, az.

    A base outside the templates is an error. The template table is a constant of 85 rows and is broadcast.
    """
    t = templates(framed.sparkSession)
    source = template_frame()
    joined = framed.join(F.broadcast(t), "base", "left")
    known = F.when(F.col("atom").isNull(), F.raise_error(F.concat(F.lit("no template for base "), F.col("base"))).cast("string")).otherwise(F.col("atom"))
    local = [sum((F.col(f"t{a}") * F.lit(axis[k]) for k, a in enumerate("xyz")), F.lit(0.0)) for axis in source]
    frame = [V.unpacked(F.col(f)) for f in ("fx", "fy", "fz")]
    placed = V.add(V.add(V.add(V.scale(frame[0], local[0]), V.scale(frame[1], local[1])), V.scale(frame[2], local[2])), V.vec("x", "y", "z"))
    return joined.withColumn("atom", known).select(*framed.columns, "atom_ord", "atom", "element", *[c.alias(f"a{a}") for c, a in zip(placed, "xyz", strict=True)])


def best_angle(placed: DataFrame, keys: list[str], partner: tuple[str, str, str] = ("qx", "qy", "qz"), step: int = 15) -> DataFrame:
    """Per residue the rotation about fx, in degrees, that turns its key atoms most toward the partner; the first best."""
    key = F.lit(False)
    for base, atoms in KEY_ATOMS.items():
        key = key | ((F.col("base") == base) & F.col("atom").isin(*atoms))
    center = V.vec("x", "y", "z")
    rows = placed.where(key & F.col(partner[0]).isNotNull()).withColumn("degrees", F.explode(F.sequence(F.lit(0), F.lit(359), F.lit(step))))
    turned = V.rotated(V.vec("ax", "ay", "az"), V.unpacked(F.col("fx")), center, F.radians("degrees"))
    cosine = V.dot(V.unit(V.sub(turned, center)), V.unit(V.sub(V.vec(*partner), center)))
    scores = rows.groupBy(*keys, "degrees").agg(F.sum(cosine).alias("score"))
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), "degrees")
    return scores.withColumn("_at", F.row_number().over(order)).where("_at = 1").select(*keys, "degrees", "score")


def best_angle_by_features(placed: DataFrame, keys: list[str], weight: float = 0.75, step: int = 10) -> DataFrame:
    """Per residue the rotation about fx that brings base and sugar centroids nearest to their anchors' directions.

    ``placed`` has anchors (bx, by, bz for the base, sx, sy, sz for the sugar) that may be null, and the partner q. The
    loss is weight * (1 - cos base) + weight / 2 * (1 - cos sugar) + (1 - weight) * (1 - cos of the pairing edge).
    """
    center = V.vec("x", "y", "z")
    rows = placed.withColumn("degrees", F.explode(F.sequence(F.lit(0), F.lit(359), F.lit(step))))
    turned = V.rotated(V.vec("ax", "ay", "az"), V.unpacked(F.col("fx")), center, F.radians("degrees"))
    rows = rows.withColumn("_t", V.packed(V.sub(turned, center)))
    edge = F.lit(False)
    for base, atoms in {"A": ("N6", "N1"), "U": ("O4", "N3"), "G": ("O6", "N1", "N2"), "C": ("N4", "N3")}.items():
        edge = edge | ((F.col("base") == base) & F.col("atom").isin(*atoms))
    parts = {"b": F.col("atom_ord") >= len(BACKBONE), "s": F.col("atom_ord").between(5, len(BACKBONE) - 1), "q": edge}
    means = [F.avg(F.when(of, F.col("_t")[a])).alias(f"{k}_{a}") for k, of in parts.items() for a in "xyz"]
    targets = [F.first(f"{k}{a}").alias(f"{k}{a}") for k in "bsq" for a in "xyz"]
    grouped = rows.groupBy(*keys, "degrees").agg(*means, *targets, *[F.first(a).alias(a) for a in "xyz"])
    loss = F.lit(0.0)
    for k, w in (("b", weight), ("s", weight * 0.5), ("q", 1 - weight)):
        mean, goal = V.vec(*(f"{k}_{a}" for a in "xyz")), V.sub(V.vec(*(f"{k}{a}" for a in "xyz")), center)
        usable = (V.norm(mean) > 1e-6) & (V.norm(goal) > 1.0)
        loss = loss + F.coalesce(F.when(usable, w * (1 - V.dot(mean, goal) / (V.norm(mean) * V.norm(goal)))), F.lit(0.0))
    order = Window.partitionBy(*keys).orderBy(F.asc(F.round("loss", 9)), "degrees")
    return grouped.withColumn("loss", loss).withColumn("_at", F.row_number().over(order)).where("_at = 1").select(*keys, "degrees", "loss")


def orientation_hint(p: V.Vec, base: V.Vec, sugar: V.Vec, confidence: Column, least: float = 0.75) -> Column:
    """Unit vector 0.7 toward the base anchor and 0.3 toward the sugar anchor; null below the confidence or without one."""
    part = lambda anchor, w: V.pick(F.coalesce(V.norm(V.sub(anchor, p)) > 1.0, F.lit(False)), V.scale(V.sub(anchor, p), F.lit(w) / V.norm(V.sub(anchor, p))), V.const(0, 0, 0))
    total = V.add(part(base, 0.7), part(sugar, 0.3))
    ok = (confidence.isNull() | (confidence >= least)) & (V.norm(total) > 1e-6)
    return F.when(ok, V.packed(V.scale(total, 1 / V.norm(total))))


def cap_position(p: V.Vec, op1: V.Vec, op2: V.Vec, o5: V.Vec, bond: float = 1.5) -> V.Vec:
    """Where a fourth substituent of p stands: opposite the sum of the unit vectors to the other three."""
    total = V.add(V.add(V.unit(V.sub(op1, p)), V.unit(V.sub(op2, p))), V.unit(V.sub(o5, p)))
    n = V.norm(total)
    flat = F.when(n > 1e-6, n).otherwise(F.raise_error(F.lit("cap direction is not defined")).cast("double"))
    return V.sub(p, V.scale(total, F.lit(bond) / flat))


def hybrid36(value: Column, width: int) -> Column:
    """A whole number in ``width`` columns: decimal as far as it goes, then hybrid-36 (A000 to ZZZZ, a000 to zzzz for four
    columns), as fixed-width structure files use. A number beyond that is an error when the plan runs."""
    tens, letters, head = 10**width, 26 * 36 ** (width - 1), 10 * 36 ** (width - 1)
    digits = lambda v: F.conv(v.cast("string"), 10, 36)
    v = value.cast("long")
    far = F.raise_error(F.concat(F.lit(f"no {width} columns hold "), v.cast("string"))).cast("string")
    return (
        F.when((v > -(tens // 10)) & (v < tens), F.lpad(v.cast("string"), width, " "))
        .when((v >= tens) & (v < tens + letters), F.upper(digits(v - tens + head)))
        .when((v >= tens + letters) & (v < tens + 2 * letters), F.lower(digits(v - tens - letters + head)))
        .otherwise(F.when(v.isNotNull(), far))
    )


def from_hybrid36(text: Column, width: int) -> Column:
    """The number that :func:`hybrid36` wrote; plain decimals read as they are."""
    letters, shift = 26 * 36 ** (width - 1), 10**width - 10 * 36 ** (width - 1)
    t = F.trim(text)
    number = F.conv(t, 36, 10).cast("long") + shift
    return F.when(t.rlike("^[A-Z]"), number).when(t.rlike("^[a-z]"), number + letters).otherwise(F.when(~t.rlike("^[A-Za-z]"), t).cast("long")).cast("int")


def pdb_lines(atoms: DataFrame, order: list[str], widen: bool = False) -> DataFrame:
    """serial and line: fixed-width ATOM records of atoms (atom, base, chain, residue_num, ax, ay, az, element).

    Occupancy is 1 and the temperature factor 20. Serials are ranks over ``order``; they are counted per range of
    residues first, so that no task sorts all atoms of a large table. Serials beyond 99,999 and residues beyond 9,999 are
    hybrid-36, which keeps the columns; with ``widen`` they are longer decimals that shift what follows.
    """
    block = F.floor(F.col(order[0]) / 1000)
    counts = atoms.groupBy(block.alias("block")).agg(F.count("*").alias("n"))
    starts = counts.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    rows = atoms.withColumn("block", block).join(F.broadcast(starts), "block").withColumn("serial", (F.col("start") + F.row_number().over(Window.partitionBy("block").orderBy(*order))).cast("int"))
    name = F.when(F.length("atom") < 4, F.concat(F.lit(" "), F.rpad("atom", 3, " "))).otherwise(F.rpad("atom", 4, " "))
    number = (lambda c, n: F.format_string(f"%{n}d", F.col(c).cast("int"))) if widen else (lambda c, n: hybrid36(F.col(c), n))
    text = F.format_string("ATOM  %5s %4s %3s %1s%4s    %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", number("serial", 5), name, "base", "chain", number("residue_num", 4), "ax", "ay", "az", F.lit(1.0), F.lit(20.0), "element")
    return rows.select("serial", text.alias("line"))


def mmcif_rows(atoms: DataFrame, order: list[str]) -> DataFrame:
    """serial (per chain) and line: atom_site rows of 21 columns, primed atom names quoted."""
    numbered = atoms.withColumn("serial", F.row_number().over(Window.partitionBy("chain").orderBy(*order)))
    quoted = F.when(F.col("atom").contains("'"), F.concat(F.lit('"'), "atom", F.lit('"'))).otherwise(F.col("atom"))
    number = lambda c: F.format_string("%.3f", c)
    cells = [F.lit("ATOM"), F.col("serial").cast("string"), F.col("element"), quoted, F.lit("."), F.col("base"), F.col("chain"), F.lit("1"), F.col("residue_num").cast("string"), F.lit("?"), number("ax"), number("ay"), number("az"), F.lit("1.00"), F.lit("20.00"), F.lit("?"), F.col("residue_num").cast("string"), F.col("base"), F.col("chain"), quoted, F.lit("1")]
    return numbered.select("serial", F.concat_ws(" ", *cells).alias("line"))
