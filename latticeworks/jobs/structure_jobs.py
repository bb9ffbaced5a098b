"""Queries over volumes, sequences, pairs, gaps and placed residues."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.numeric import half_even, rounded
from ..operators import allocation, flips, gaps, pairs, placement, restraints, selection, sequences
from ..session import shared_folder, table
from .adapters import CHAINS, CLOUD, PAIRS, chains, cloud, scored_pairs
from .registry import query

_VOL = "vol AS (SELECT p_brand AS grp, p_partkey AS cluster, CAST(floor(p_retailprice) AS BIGINT) % 400 + p_size AS volume FROM part)"


def _volumes(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("cluster"), (F.floor("p_retailprice") % 400 + F.col("p_size")).cast("long").alias("volume"))


_UNIT = (
    "v AS (SELECT * FROM vol WHERE volume >= 10), b AS (SELECT grp, min(volume) AS lo, max(volume) AS hi, greatest(10, CAST(floor((max(volume) - min(volume)) / 50.0) AS INT)) AS bins FROM v GROUP BY grp), "
    "h AS (SELECT v.grp, v.volume, lo, (hi - lo) / bins AS width, CASE WHEN hi = lo THEN 0 ELSE least(bins - 1, CAST(floor((volume - lo) / ((hi - lo) / bins)) AS INT)) END AS bin FROM v JOIN b ON v.grp = b.grp), "
    "c AS (SELECT grp, bin, any_value(lo) AS lo, any_value(width) AS width, count(*) AS n FROM h GROUP BY 1, 2), m AS (SELECT grp, lo + (bin + 0.5) * width AS peak FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, bin) AS k FROM c) WHERE k = 1), "
    "md AS (SELECT v.grp, quantile_cont(CAST(volume AS DOUBLE), 0.5) AS med FROM v JOIN m ON v.grp = m.grp WHERE volume BETWEEN peak * 0.7 AND peak * 1.3 GROUP BY v.grp), "
    "unit AS (SELECT g.grp, coalesce(md.med, m.peak, 400.0) AS unit FROM (SELECT DISTINCT grp FROM vol) g LEFT JOIN m ON m.grp = g.grp LEFT JOIN md ON md.grp = g.grp)"
)


@query(f"WITH {_VOL}, {_UNIT} SELECT grp, round(unit, 6) AS unit FROM unit")
def volume_mode_median(spark, sf_dir):
    """A2: typical volume of one unit per group."""
    return allocation.unit_volume(_volumes(spark, sf_dir), ["grp"]).select("grp", rounded(F.col("unit")).alias("unit"))


_ALLOC = (
    "a AS (SELECT vol.*, unit, CASE WHEN volume < 10 THEN 0 ELSE greatest(1, CAST(round_even(volume / unit, 0) AS BIGINT)) END AS base, cluster % 5 AS cap FROM vol JOIN unit ON vol.grp = unit.grp), "
    "al AS (SELECT *, CASE WHEN volume >= 10 AND cap >= 2 AND base >= 2 * cap THEN cap ELSE base END AS alloc FROM a)"
)


@query(f"WITH {_VOL}, {_UNIT}, {_ALLOC} SELECT grp, cluster, CAST(alloc AS BIGINT) AS alloc FROM al")
def volume_allocation(spark, sf_dir):
    """A3: units per cluster, halves to even, capped by counted peaks."""
    v = _volumes(spark, sf_dir)
    rows = v.join(F.broadcast(allocation.unit_volume(v, ["grp"])), "grp")
    return rows.select("grp", "cluster", allocation.first_allocation(F.col("volume"), F.col("unit"), F.col("cluster") % 5).alias("alloc"))


_LR = (
    f"WITH {_VOL}, {_UNIT}, {_ALLOC}, t AS (SELECT grp, CASE WHEN CAST(substring(grp, length(grp)) AS INT) % 2 = 0 THEN count(*) // 2 + 3 ELSE sum(alloc) + 17 END AS target FROM al GROUP BY grp), "
    "f AS (SELECT al.*, t.target, CASE WHEN volume >= 10 THEN volume / unit - floor(volume / unit) ELSE 0 END AS frac FROM al JOIN t ON al.grp = t.grp), "
    "g AS (SELECT grp, sum(alloc) - any_value(target) AS over, sum(alloc - 1) FILTER (alloc > 0) AS spare, max(alloc - 1) FILTER (alloc > 0) AS top, count(*) FILTER (alloc > 0) AS m FROM f GROUP BY grp), "
    "ks AS (SELECT g.grp, k, sum(least(alloc - 1, k)) AS removed FROM g JOIN f ON f.grp = g.grp AND alloc > 0, unnest(range(CAST(top AS BIGINT) + 1)) AS u(k) GROUP BY 1, 2), "
    "kk AS (SELECT g.grp, max(k) AS rounds, max(removed) AS removed FROM g JOIN ks ON ks.grp = g.grp WHERE removed <= over GROUP BY 1), "
    "r AS (SELECT f.*, over, spare, m, coalesce(rounds, 0) AS rounds, over - coalesce(removed, 0) AS rest, "
    "row_number() OVER (PARTITION BY f.grp ORDER BY (alloc > 0 AND alloc - 1 > coalesce(rounds, 0)) DESC, frac, volume DESC, cluster) AS r_less, row_number() OVER (PARTITION BY f.grp ORDER BY (alloc > 0) DESC, volume, cluster) AS r_drop, "
    "row_number() OVER (PARTITION BY f.grp ORDER BY (alloc > 0) DESC, frac DESC, volume DESC, cluster) AS r_more FROM f JOIN g ON f.grp = g.grp LEFT JOIN kk ON kk.grp = f.grp) "
    "SELECT grp, cluster, CAST(CASE WHEN alloc = 0 THEN 0 WHEN over > spare THEN CASE WHEN r_drop <= over - spare THEN 0 ELSE 1 END "
    "WHEN over > 0 THEN alloc - least(alloc - 1, rounds) - CASE WHEN alloc - 1 > rounds AND r_less <= rest THEN 1 ELSE 0 END "
    "WHEN over < 0 THEN alloc + (-over) // m + CASE WHEN r_more <= (-over) % m THEN 1 ELSE 0 END ELSE alloc END AS BIGINT) AS final FROM r"
)


@query(_LR)
def largest_remainder(spark, sf_dir):
    """A4: allocations brought to an exact total per group, half of the groups down, half up."""
    v = _volumes(spark, sf_dir)
    rows = v.join(F.broadcast(allocation.unit_volume(v, ["grp"])), "grp").withColumn("alloc", allocation.first_allocation(F.col("volume"), F.col("unit"), F.col("cluster") % 5))
    even = F.right("grp", F.lit(1)).cast("int") % 2 == 0
    t = rows.groupBy("grp").agg(F.count("*").alias("n"), F.sum("alloc").alias("s")).select("grp", F.when(even, F.floor(F.col("n") / 2) + 3).otherwise(F.col("s") + 17).cast("long").alias("target"))
    return allocation.adjust_allocation(rows.join(t, "grp"), ["grp"]).select("grp", "cluster", "final")


_RNA = "rna AS (SELECT doc_id, translate(regexp_replace(upper(text), '[^ACGTU]', '', 'g'), 'T', 'U') AS sequence FROM documents)"


@query(f"WITH {_RNA} SELECT doc_id, CAST(length(sequence) AS INT) AS n, sha256(sequence) AS digest, CAST(length(replace(replace(sequence, 'C', ''), 'U', '')) AS INT) AS purines FROM rna WHERE length(sequence) >= 2")
def sequence_clean(spark, sf_dir):
    """RNA letters of each text, at least two, with the number of purines."""
    d = table(spark, sf_dir, "documents").select("doc_id", sequences.letters_only(F.coalesce("text", F.lit(""))).alias("s")).where(F.length("s") >= 2)
    clean = sequences.clean_sequence(F.split("s", "\n"))
    return d.select("doc_id", clean.alias("s")).select("doc_id", F.length("s").alias("n"), F.sha2("s", 256).alias("digest"), F.length(F.translate("s", "CU", "")).alias("purines"))


@query(f"WITH {_RNA}, r AS (SELECT doc_id, unnest(string_split(sequence, '')) AS base FROM rna WHERE length(sequence) >= 2) SELECT doc_id, base, count(*) AS n, CAST(any_value(CASE WHEN base IN ('A', 'G') THEN 1 ELSE -1 END) AS INT) AS grp FROM r WHERE base <> '' GROUP BY 1, 2")
def base_groups(spark, sf_dir):
    """Residues by base with their group."""
    d = table(spark, sf_dir, "documents").select("doc_id", sequences.letters_only(F.coalesce("text", F.lit(""))).alias("sequence")).where(F.length("sequence") >= 2)
    return sequences.residues(d).groupBy("doc_id", "base").agg(F.count("*").alias("n")).withColumn("grp", sequences.base_group(F.col("base")))


@query("WITH d AS (SELECT DISTINCT o_custkey AS k, CAST(o_orderkey // 7 AS BIGINT) AS v FROM orders), m AS (SELECT k, v, v - row_number() OVER (PARTITION BY k ORDER BY v) AS g FROM d) SELECT k, min(v) AS first, max(v) AS last, count(*) AS length FROM m GROUP BY k, g")
def contiguous_runs(spark, sf_dir):
    """Runs of consecutive integers per key."""
    d = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.floor(F.col("o_orderkey") / 7).alias("v")).distinct()
    return sequences.runs(d, ["k"], "v")


@query(
    "WITH p AS (SELECT c_custkey AS k, CAST(c_custkey % 97 + 1 AS INT) AS n_path, CAST(c_custkey % 53 + 1 AS INT) AS n_seq FROM customer), w AS (SELECT *, least(24, n_path, n_seq) AS win FROM p), "
    "s AS (SELECT DISTINCT k, win, n_path, start FROM (SELECT k, win, n_path, unnest(list_append(range(0, greatest(1, n_path - win + 1), 2), greatest(0, n_path - win))) AS start FROM w)) "
    "SELECT k, CAST(start AS INT) AS start, CAST(least(win, n_path - start) AS INT) AS length FROM s WHERE least(win, n_path - start) >= greatest(4, win // 2)"
)
def path_windows(spark, sf_dir):
    """Windows along paths of many lengths, with a tail window."""
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 97 + 1).cast("int").alias("n"), (F.col("c_custkey") % 53 + 1).cast("int").alias("m"))
    return p.select("k", F.explode(sequences.path_windows(F.col("n"), F.col("m"), 24, 2)).alias("w")).select("k", "w.start", "w.length")


_FREE = "len(list_filter(s.used, lambda u: u = o.i OR u = o.j)) = 0"
_DECODED = (
    f"{PAIRS}, o AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY prob DESC, i, j) AS k FROM scored WHERE prob > 0.5), n AS (SELECT chain, max(k) AS n FROM o GROUP BY chain), "
    "s AS (SELECT chain, CAST(0 AS BIGINT) AS k, CAST([] AS INT[]) AS used, CAST([] AS STRUCT(i INT, j INT, prob DOUBLE)[]) AS kept FROM n UNION ALL "
    f"SELECT s.chain, o.k, CASE WHEN {_FREE} THEN list_concat(s.used, [o.i, o.j]) ELSE s.used END, CASE WHEN {_FREE} THEN list_append(s.kept, {{'i': o.i, 'j': o.j, 'prob': o.prob}}) ELSE s.kept END FROM s JOIN o ON o.chain = s.chain AND o.k = s.k + 1), "
    "decoded AS (SELECT s.chain, q.i, q.j, q.prob FROM s JOIN n ON n.chain = s.chain AND s.k = n.n, unnest(s.kept) AS t(q))"
)


@query(f"WITH RECURSIVE {_DECODED}, z AS (SELECT chain, i, j, prob, substring('ACGU', CAST(i % 4 + 1 AS INT), 1) || substring('ACGU', CAST(j % 4 + 1 AS INT), 1) AS p FROM decoded) SELECT chain, i, j, prob, p IN ('AU', 'UA', 'GC', 'CG', 'GU', 'UG') AS canonical FROM z")
def pair_decode(spark, sf_dir):
    """Greedy matching of scored pairs, each with its canonical tag."""
    d = pairs.decode_pairs(scored_pairs(spark, sf_dir), ["chain"])
    base = lambda c: F.substring(F.lit("ACGU"), F.col(c) % 4 + 1, F.lit(1))
    return d.select("chain", "i", "j", "prob", sequences.is_canonical(base("i"), base("j")).alias("canonical"))


_NORMAL = "normal AS (SELECT DISTINCT CAST(l_orderkey % 40 AS INT) AS chain, CAST(least(l_partkey % 60, l_suppkey % 60) AS INT) AS i, CAST(greatest(l_partkey % 60, l_suppkey % 60) AS INT) AS j FROM lineitem WHERE least(l_partkey % 60, l_suppkey % 60) >= 1 AND greatest(l_partkey % 60, l_suppkey % 60) <= 50 AND l_partkey % 60 <> l_suppkey % 60)"


def _normal(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 40).cast("int").alias("chain"), (F.col("l_partkey") % 60).cast("int").alias("i"), (F.col("l_suppkey") % 60).cast("int").alias("j"))
    return pairs.normalize_pairs(raw, ["chain"], 50)


@query(f"WITH {_NORMAL} SELECT * FROM normal")
def pair_normalize(spark, sf_dir):
    """Ordered distinct pairs inside a range."""
    return _normal(spark, sf_dir)


@query(f"WITH {_NORMAL} SELECT p.chain, p.i AS a, p.j AS b, q.i AS c, q.j AS d FROM normal p JOIN normal q ON p.chain = q.chain AND q.i = p.i + 1 AND q.j = p.j - 1")
def pair_stacks(spark, sf_dir):
    """Stacked pairs."""
    return pairs.stacks(_normal(spark, sf_dir), ["chain"])


_SITES = CHAINS + ", sites AS (SELECT chain, residue_num, x * 2.0 AS x, y * 2.0 AS y, z * 2.0 AS z FROM chains)"
_PD = f"{_SITES}, {_NORMAL}, pd AS (SELECT n.chain, n.i, n.j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM normal n JOIN sites a ON a.chain = n.chain AND a.residue_num = n.i JOIN sites b ON b.chain = n.chain AND b.residue_num = n.j)"


def _sites(spark, sf_dir):
    return chains(spark, sf_dir).select("chain", "residue_num", *[(F.col(a) * 2.0).alias(a) for a in "xyz"])


@query(f"WITH {_PD} SELECT chain, count(*) AS total, count(*) FILTER (d BETWEEN 15 AND 22) AS satisfied, round(count(*) FILTER (d BETWEEN 15 AND 22) / count(*), 6) AS ratio FROM pd GROUP BY chain")
def pair_satisfaction(spark, sf_dir):
    """Pairs whose two sites lie at a pairing distance."""
    s = pairs.satisfaction(_normal(spark, sf_dir), _sites(spark, sf_dir), ["chain"])
    return s.select("chain", "total", "satisfied", rounded(F.col("ratio")).alias("ratio"))


@query(f"WITH {_PD}, g AS (SELECT * FROM pd WHERE d BETWEEN 15 AND 22) SELECT p.chain, count(*) AS stacks FROM g p JOIN g q ON p.chain = q.chain AND q.i = p.i + 1 AND q.j = p.j - 1 GROUP BY p.chain")
def stacks_satisfied(spark, sf_dir):
    """Stacks of which both pairs are satisfied."""
    n = _normal(spark, sf_dir)
    return pairs.stacks_satisfied(pairs.stacks(n, ["chain"]), pairs.pair_distances(n, _sites(spark, sf_dir), ["chain"]), ["chain"])


_ORI = "b AS (SELECT DISTINCT chain, i, j FROM normal), m AS (SELECT chain, max(residue_num) AS m FROM sites GROUP BY 1), w AS (SELECT chain, 'forward' AS orientation, residue_num AS r, x, y, z FROM sites UNION ALL SELECT chain, 'reverse', m + 1 - residue_num, x, y, z FROM sites JOIN m USING (chain))"


@query(f"WITH {_SITES}, {_NORMAL}, {_ORI}, d AS (SELECT b.chain, p.orientation, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)) AS d FROM b JOIN w p ON p.chain = b.chain AND p.r = b.i JOIN w q ON q.chain = b.chain AND q.r = b.j AND q.orientation = p.orientation) SELECT chain, orientation, count(*) AS total, count(*) FILTER (d BETWEEN 15 AND 22) AS satisfied FROM d GROUP BY 1, 2")
def path_orientation(spark, sf_dir):
    """Pairs satisfied by the path of each chain read forward and backward."""
    s = chains(spark, sf_dir).select("chain", "residue_num", F.col("id").alias("site"), *[(F.col(a) * 2.0).alias(a) for a in "xyz"])
    out = pairs.orientation_score(s.select("chain", "residue_num", "site"), _normal(spark, sf_dir).select("chain", "i", "j").distinct(), s.select("chain", "site", "x", "y", "z"), ["chain"])
    return out.select("chain", "orientation", "total", "satisfied")


@query(
    f"WITH {PAIRS}, u AS (SELECT chain, i AS residue_num, j AS partner, i * 100 + j AS o, 0 AS s FROM scored WHERE prob > 0.6 UNION ALL SELECT chain, j, i, i * 100 + j, 1 FROM scored WHERE prob > 0.6), r AS (SELECT *, row_number() OVER (PARTITION BY chain, residue_num ORDER BY o DESC, s DESC) AS k FROM u) SELECT chain, residue_num, partner FROM r WHERE k = 1"
)
def partner_symmetric(spark, sf_dir):
    """Both directions of each pair, the last one of a residue stays."""
    p = scored_pairs(spark, sf_dir).withColumn("canonical", F.when(F.col("prob") > 0.6, True)).withColumn("o", F.col("i") * 100 + F.col("j"))
    return pairs.partners(p, ["chain"], "o")


@query(f"WITH {CHAINS}, g AS (SELECT chain, CASE WHEN base IN ('A', 'G') THEN 1 ELSE -1 END AS grp, CASE WHEN id % 3 = 0 THEN 1 WHEN id % 3 = 1 THEN -1 ELSE 0 END AS expected, (id % 10) / 10.0 AS conf FROM chains) SELECT chain, round(sum(CASE WHEN expected = 0 THEN 0 WHEN grp = expected THEN conf ELSE -conf END), 6) + 0.0 AS score FROM g GROUP BY chain")
def group_agreement(spark, sf_dir):
    """Signed agreement of base groups."""
    c = chains(spark, sf_dir)
    expected = c.select("chain", "residue_num", F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, -1).otherwise(0).alias("expected"))
    g = c.select("chain", "residue_num", sequences.base_group(F.col("base")).alias("grp"), ((F.col("id") % 10) / 10.0).alias("conf"))
    return pairs.group_agreement(expected, g, ["chain"]).select("chain", rounded(F.col("score")).alias("score"))


_ANCH = "an AS (SELECT o_custkey % 20 AS k, o_orderkey AS site, o_orderkey % 100 AS residue_num FROM orders), asg AS (SELECT k, site, residue_num FROM an WHERE site % 7 <> 0)"


@query(f"WITH {_ANCH} SELECT an.k, count(asg.site) AS matched, count(*) AS total, round(count(asg.site) / count(*), 6) AS ratio, round_even(100.0 * count(asg.site) / count(*), 1) AS percent FROM an LEFT JOIN asg ON an.k = asg.k AND an.site = asg.site AND an.residue_num = asg.residue_num GROUP BY an.k")
def anchor_agreement(spark, sf_dir):
    """How many anchored sites an assignment keeps."""
    a = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("k"), F.col("o_orderkey").alias("site"), (F.col("o_orderkey") % 100).alias("residue_num"))
    out = pairs.anchor_agreement(a, a.where("site % 7 <> 0"), ["k"])
    return out.select("k", "matched", "total", rounded(F.col("ratio")).alias("ratio"), "percent")


@query(
    "WITH RECURSIVE b AS (SELECT o_custkey AS k, o_orderkey AS ord, o_orderkey % 5 AS site, o_orderkey % 4 AS residue_num FROM orders), o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord, site, residue_num) AS n FROM b), m AS (SELECT k, max(n) AS n FROM o GROUP BY k), "
    "s AS (SELECT k, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(site BIGINT, residue_num BIGINT)[]) AS kept FROM m UNION ALL SELECT s.k, o.n, CASE WHEN len(list_filter(s.kept, lambda q: q.site = o.site OR q.residue_num = o.residue_num)) = 0 THEN list_append(s.kept, {'site': o.site, 'residue_num': o.residue_num}) ELSE s.kept END FROM s JOIN o ON o.k = s.k AND o.n = s.n + 1) "
    "SELECT s.k, q.site, q.residue_num FROM s JOIN m ON m.k = s.k AND m.n = s.n, unnest(s.kept) AS t(q)"
)
def take_unused(spark, sf_dir):
    """Greedy flattening, each site and residue once."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 5).alias("site"), (F.col("o_orderkey") % 4).alias("residue_num"))
    return pairs.take_unused(o, ["k"], "ord")


_HB = ", ".join(f"('{a}', '{b}', '{p}', '{q}', {d})" for a, b, p, q, d in pairs.HYDROGEN_BONDS)


@query(
    f"WITH {CHAINS}, {_NORMAL}, hb(base_i, base_j, atom_i, atom_j, target) AS (VALUES {_HB}), p AS (SELECT n.chain, n.i, n.j, a.base AS base_i, b.base AS base_j FROM normal n JOIN chains a ON a.chain = n.chain AND a.residue_num = n.i JOIN chains b ON b.chain = n.chain AND b.residue_num = n.j) "
    "SELECT p.chain, p.i, p.j, base_i, base_j, atom_i, atom_j, CAST(target AS DOUBLE) AS target FROM p JOIN hb USING (base_i, base_j) WHERE NOT (p.i % 7 = 0 AND atom_i = 'N1') AND NOT (p.j % 7 = 0 AND atom_j = 'N1')"
)
def restraint_lookup(spark, sf_dir):
    """Hydrogen-bond restraints whose two atoms exist."""
    c = chains(spark, sf_dir)
    end = lambda k: c.select("chain", F.col("residue_num").alias(k), F.col("base").alias(f"base_{k}"))
    p = _normal(spark, sf_dir).join(end("i"), ["chain", "i"]).join(end("j"), ["chain", "j"])
    t = placement.templates(spark).select("base", "atom")
    atoms = c.select("chain", "residue_num", "base").join(F.broadcast(t), "base").where("not (residue_num % 7 = 0 and atom = 'N1')").select("chain", "residue_num", "atom")
    return pairs.bond_restraints(p, atoms, ["chain"]).select("chain", "i", "j", "base_i", "base_j", "atom_i", "atom_j", "target")


_ADJ = f"{CHAINS}, q AS (SELECT chain, residue_num, x + 1 AS ox, y AS oy, z AS oz, lead(residue_num) OVER w AS nxt, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz FROM chains WINDOW w AS (PARTITION BY chain ORDER BY residue_num)), e AS (SELECT chain, residue_num, nxt AS next, sqrt((ox - nx) * (ox - nx) + (oy - ny) * (oy - ny) + (oz - nz) * (oz - nz)) AS d FROM q WHERE nxt IS NOT NULL)"


@query(f"WITH {_ADJ} SELECT chain, residue_num, next, round(d, 6) AS d FROM e WHERE d <= 8 AND residue_num % 5 <> 0")
def bond_adjacent(spark, sf_dir):
    """Bonds between neighbouring residues that are near and not there yet."""
    c = chains(spark, sf_dir).select("chain", "residue_num", (F.col("x") + 1).alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"), *[F.col(a).alias(f"p{a}") for a in "xyz"])
    out = pairs.adjacent_bonds(c, c.where("residue_num % 5 = 0").select("chain", "residue_num"), ["chain"], 8.0)
    return out.select("chain", "residue_num", "next", rounded(F.col("d")).alias("d"))


_GAP = (
    f"{CHAINS}, g AS (SELECT chain, residue_num, CASE WHEN residue_num % 9 > 5 OR residue_num <= 2 THEN NULL ELSE x END AS x, y, z FROM chains), h AS (SELECT * FROM g WHERE x IS NOT NULL), "
    "p AS (SELECT g.chain, g.residue_num, (SELECT max(residue_num) FROM h WHERE h.chain = g.chain AND h.residue_num < g.residue_num) AS pr, (SELECT min(residue_num) FROM h WHERE h.chain = g.chain AND h.residue_num > g.residue_num) AS nr FROM g WHERE x IS NULL)"
)


@query(
    f"WITH {_GAP} SELECT p.chain, p.residue_num, 'interpolate' AS method, round(a.x + (b.x - a.x) * ((p.residue_num - pr) / (nr - pr)), 6) + 0.0 AS x, round(a.y + (b.y - a.y) * ((p.residue_num - pr) / (nr - pr)), 6) + 0.0 AS y FROM p JOIN h a ON a.chain = p.chain AND a.residue_num = pr JOIN h b ON b.chain = p.chain AND b.residue_num = nr "
    "UNION ALL SELECT p.chain, p.residue_num, 'extrapolate_3p', round(a.x + 6.0 * (p.residue_num - pr) * (a.x - c.x) / sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y) + (a.z - c.z) * (a.z - c.z)), 6) + 0.0, round(a.y + 6.0 * (p.residue_num - pr) * (a.y - c.y) / sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y) + (a.z - c.z) * (a.z - c.z)), 6) + 0.0 FROM p JOIN h a ON a.chain = p.chain AND a.residue_num = pr JOIN h c ON c.chain = p.chain AND c.residue_num = pr - 1 WHERE nr IS NULL "
    "UNION ALL SELECT p.chain, p.residue_num, 'extrapolate_5p', round(b.x + 6.0 * (nr - p.residue_num) * (b.x - c.x) / sqrt((b.x - c.x) * (b.x - c.x) + (b.y - c.y) * (b.y - c.y) + (b.z - c.z) * (b.z - c.z)), 6) + 0.0, round(b.y + 6.0 * (nr - p.residue_num) * (b.y - c.y) / sqrt((b.x - c.x) * (b.x - c.x) + (b.y - c.y) * (b.y - c.y) + (b.z - c.z) * (b.z - c.z)), 6) + 0.0 FROM p JOIN h b ON b.chain = p.chain AND b.residue_num = nr JOIN h c ON c.chain = p.chain AND c.residue_num = nr + 1 WHERE pr IS NULL"
)
def gap_interpolate(spark, sf_dir):
    """Positions for residues without a site."""
    c = chains(spark, sf_dir)
    have = c.where("not (residue_num % 9 > 5 or residue_num <= 2)").select("chain", "residue_num", "x", "y", "z")
    out = gaps.fill_gaps(have, c.select("chain", "residue_num"), ["chain"])
    return out.select("chain", "residue_num", "method", rounded(F.col("x")).alias("x"), rounded(F.col("y")).alias("y"))


@query(f"WITH {CHAINS}, s AS (SELECT chain, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS step FROM chains WINDOW w AS (PARTITION BY chain ORDER BY residue_num)) SELECT chain, round(-sum((step - 6) * (step - 6)), 4) AS score, round(max(step), 6) AS max_step, round(avg(step), 6) AS mean_step FROM s GROUP BY chain")
def gap_geometry(spark, sf_dir):
    """How evenly spaced a chain is."""
    g = gaps.gap_geometry(chains(spark, sf_dir).withColumn("at", F.col("residue_num")), ["chain"], 6.0)
    return g.select("chain", F.round("score", 4).alias("score"), rounded(F.col("max_step")).alias("max_step"), rounded(F.col("mean_step")).alias("mean_step"))


@query("SELECT k, v, src FROM (SELECT o_custkey AS k, max(o_orderkey) AS v, 'late' AS src FROM orders GROUP BY 1) UNION ALL SELECT c_custkey, c_custkey * 10, 'base' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def overlay(spark, sf_dir):
    """U4: later rows win."""
    late = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v")).withColumn("src", F.lit("late"))
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") * 10).alias("v"), F.lit("base").alias("src"))
    return gaps.overlay(base, late, ["k"])


@query("SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def coverage_anti(spark, sf_dir):
    """Expected keys that nothing covers."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return selection.missing(c, table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")), ["k"])


def _gap_inputs(spark, sf_dir):
    """Anchors of six residues in every twelve, the path of all sites but some, sizes and the anchored sites."""
    c = chains(spark, sf_dir).withColumn("anchored", F.expr("(residue_num - 1) % 12 < 6"))
    place = Window.partitionBy("chain").orderBy("residue_num")
    kept = c.where("anchored or id % 3 <> 0").withColumn("path_pos", F.row_number().over(place) - 1)
    path = kept.select("chain", "path_pos", F.col("id").alias("atom"), "x", "y", "z", F.expr("case when id % 5 < 2 then 1 when id % 5 < 4 then -1 else 0 end").alias("grp"), ((F.col("id") % 10) / 10.0).alias("conf"))
    block = F.floor((F.col("residue_num") - 1) / 12)
    anchors = kept.where("anchored").groupBy("chain", block.alias("block")).agg(F.min("residue_num").alias("residue_start"), F.max("residue_num").alias("residue_end"), F.min("path_pos").alias("path_start")).withColumn("direction", F.lit(1))
    sizes = c.groupBy("chain").agg(F.count_if(F.expr("anchored or id % 3 <> 0")).alias("n_path"), F.max("residue_num").alias("n_sequence"))
    fixed = kept.where("anchored").select("chain", "residue_num", F.col("id").alias("atom"), "x", "y", "z")
    return c, path, anchors, sizes, fixed


_GAPS = (
    f"{CHAINS}, k AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY residue_num) - 1 AS path_pos FROM chains WHERE (residue_num - 1) % 12 < 6 OR id % 3 <> 0), "
    "z AS (SELECT c.chain, max(c.residue_num) AS n_sequence, max(k.path_pos) + 1 AS n_path FROM chains c LEFT JOIN k ON k.chain = c.chain AND k.residue_num = c.residue_num GROUP BY c.chain), "
    "a AS (SELECT chain, (residue_num - 1) // 12 AS block, min(residue_num) AS rs, max(residue_num) AS re, min(path_pos) AS ps, max(path_pos) AS pe FROM k WHERE (residue_num - 1) % 12 < 6 GROUP BY 1, 2), "
    "g AS (SELECT a.chain, re + 1 AS residue_lo, coalesce(lead(rs) OVER w - 1, n_sequence) AS residue_hi, pe + 1 AS path_lo, coalesce(lead(ps) OVER w, n_path) - 1 AS path_hi FROM a JOIN z ON z.chain = a.chain WINDOW w AS (PARTITION BY a.chain ORDER BY block))"
)


@query(f"WITH {_GAPS} SELECT chain, residue_lo, residue_hi, path_lo, path_hi FROM g WHERE residue_lo <= residue_hi")
def gap_ranges(spark, sf_dir):
    """Residues without an anchor and the free places of the path that face them."""
    _, _, anchors, sizes, _ = _gap_inputs(spark, sf_dir)
    return gaps.gap_candidates(anchors, sizes, ["chain"]).select("chain", "residue_lo", "residue_hi", "path_lo", "path_hi")


def _repaired(spark, sf_dir):
    c, path, anchors, sizes, fixed = _gap_inputs(spark, sf_dir)
    wanted = c.select("chain", "residue_num", sequences.base_group(F.col("base")).alias("grp"))
    shared_folder(spark)  # names the checkpoint folder; both tables are read several times
    problems = gaps.gap_problems(gaps.gap_candidates(anchors, sizes, ["chain"]), path, fixed, wanted, ["chain"]).checkpoint()
    return c, fixed, sizes, problems, gaps.repair_gaps(problems, ["chain"]).checkpoint()


@query()
def gap_repair(spark, sf_dir):
    """The best filling of each gap; tests hold it against trying all ways one by one."""
    r = _repaired(spark, sf_dir)[4]
    return r.select("chain", "gap", "residue_num", "atom", *[rounded(F.col(a)).alias(a) for a in "xyz"], "method")


@query(f"WITH {CHAINS} SELECT chain, residue_num, (residue_num - 1) % 12 < 6 AS anchored FROM chains")
def gap_splice(spark, sf_dir):
    """Each residue once, anchored ones with their own site and the others repaired or derived."""
    c, fixed, sizes, problems, repaired = _repaired(spark, sf_dir)
    out = gaps.splice(fixed, repaired, problems, c.select("chain", "residue_num", F.col("id").alias("atom")), sizes, ["chain"])
    return out.select("chain", "residue_num", (F.col("source") == "anchor").alias("anchored"))


@query()
def spliced_sites(spark, sf_dir):
    """The site of each residue, where it comes from and where it lies; tests hold it against a plain version."""
    c, fixed, sizes, problems, repaired = _repaired(spark, sf_dir)
    out = gaps.splice(fixed, repaired, problems, c.select("chain", "residue_num", F.col("id").alias("atom")), sizes, ["chain"])
    own = c.select("chain", F.col("id").alias("atom"), *[F.col(a).alias(f"own_{a}") for a in "xyz"])
    derived = F.col("source") == "derived"
    placed = out.join(own, ["chain", "atom"], "left")
    return placed.select("chain", "residue_num", "atom", "source", *[rounded(F.when(derived, F.col(a)).otherwise(F.col(f"own_{a}"))).alias(a) for a in "xyz"])
