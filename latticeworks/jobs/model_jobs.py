"""Queries over frames, placed atoms, restraints, selections, consensus and flips."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.numeric import rounded
from ..operators import flips, kernels, placement, registration, restraints, selection, sequences
from ..session import table
from .adapters import CHAINS, CLOUD, chains, cloud
from .registry import query

# The frame of each residue in SQL: neighbours by row order, the partner by residue (n + 1 - own number).
_FRAMES = (
    f"{CHAINS}, nn AS (SELECT chain, max(residue_num) AS n FROM chains GROUP BY chain), "
    "w AS (SELECT c.*, q.x AS qx, q.y AS qy, q.z AS qz, lag(c.x) OVER v AS px, lag(c.y) OVER v AS py, lag(c.z) OVER v AS pz, lead(c.x) OVER v AS nx, lead(c.y) OVER v AS ny, lead(c.z) OVER v AS nz FROM chains c JOIN nn ON nn.chain = c.chain LEFT JOIN chains q ON q.chain = c.chain AND q.residue_num = nn.n + 1 - c.residue_num AND q.residue_num <> c.residue_num WINDOW v AS (PARTITION BY c.chain ORDER BY c.residue_num)), "
    "a AS (SELECT *, " + ", ".join(f"CASE WHEN p{k} IS NOT NULL AND n{k} IS NOT NULL THEN n{k} - p{k} WHEN n{k} IS NOT NULL THEN n{k} - {k} WHEN p{k} IS NOT NULL THEN {k} - p{k} ELSE {1.0 if k == 'x' else 0.0} END AS a{k}" for k in "xyz") + " FROM w), "
    "b AS (SELECT *, ax / (sqrt(ax * ax + ay * ay + az * az) + 1e-8) AS xx, ay / (sqrt(ax * ax + ay * ay + az * az) + 1e-8) AS xy, az / (sqrt(ax * ax + ay * ay + az * az) + 1e-8) AS xz, sqrt((qx - x) * (qx - x) + (qy - y) * (qy - y) + (qz - z) * (qz - z)) AS far FROM a), "
    "c1 AS (SELECT *, (qx - x) / far AS ux, (qy - y) / far AS uy, (qz - z) / far AS uz FROM b), "
    "c2 AS (SELECT *, ux - (ux * xx + uy * xy + uz * xz) * xx AS tx, uy - (ux * xx + uy * xy + uz * xz) * xy AS ty, uz - (ux * xx + uy * xy + uz * xz) * xz AS tz, CASE WHEN abs(xz) > 0.9 AND abs(xy) > 0.9 THEN 1.0 ELSE 0.0 END AS gx, CASE WHEN abs(xz) > 0.9 AND abs(xy) <= 0.9 THEN 1.0 ELSE 0.0 END AS gy, CASE WHEN abs(xz) > 0.9 THEN 0.0 ELSE 1.0 END AS gz FROM c1), "
    "c3 AS (SELECT *, coalesce(far > 1.0 AND sqrt(tx * tx + ty * ty + tz * tz) > 0.3, false) AS use, gx - (gx * xx + gy * xy + gz * xz) * xx AS hx, gy - (gx * xx + gy * xy + gz * xz) * xy AS hy, gz - (gx * xx + gy * xy + gz * xz) * xz AS hz FROM c2), "
    "c4 AS (SELECT *, " + ", ".join(f"CASE WHEN use THEN t{k} / sqrt(tx * tx + ty * ty + tz * tz) ELSE h{k} / (sqrt(hx * hx + hy * hy + hz * hz) + 1e-8) END AS y{k}" for k in "xyz") + " FROM c3), "
    "c5 AS (SELECT *, xy * yz - xz * yy AS rx, xz * yx - xx * yz AS ry, xx * yy - xy * yx AS rz FROM c4), "
    "frames AS (SELECT chain, residue_num, id, base, x, y, z, qx, qy, qz, xx, xy, xz, yx, yy, yz, " + ", ".join(f"r{k} / (sqrt(rx * rx + ry * ry + rz * rz) + 1e-8) AS z{k}" for k in "xyz") + " FROM c5)"
)


def _framed(spark, sf_dir):
    c = chains(spark, sf_dir)
    n = c.groupBy("chain").agg(F.max("residue_num").alias("n"))
    q = c.select("chain", F.col("residue_num").alias("q"), *[F.col(a).alias(f"q{a}") for a in "xyz"])
    c = c.join(F.broadcast(n), "chain").withColumn("q", F.when(F.col("n") + 1 - F.col("residue_num") != F.col("residue_num"), F.col("n") + 1 - F.col("residue_num"))).join(q, ["chain", "q"], "left").drop("n", "q")
    return placement.local_frames(c, ["chain"])


@query(f"WITH {_FRAMES} SELECT chain, residue_num, " + ", ".join(f"round({k}, 6) + 0.0 AS {k}" for k in ("xx", "xy", "xz", "yx", "yy", "yz", "zx", "zy", "zz")) + " FROM frames")
def local_frames(spark, sf_dir):
    """The frame of each residue."""
    f = _framed(spark, sf_dir)
    return f.select("chain", "residue_num", *[rounded(F.col(f"f{k}")[a]).alias(f"{k}{a}") for k in "xyz" for a in "xyz"])


_ATOMS = ", ".join(f"('{base}', {k}, '{name.replace(chr(39), chr(39) * 2)}', {x}, {y}, {z})" for base, own in placement.BASES.items() for k, (name, x, y, z) in enumerate(placement.BACKBONE + own))
_LOCAL = ", ".join(f"tx * ({axis[0]!r}) + ty * ({axis[1]!r}) + tz * ({axis[2]!r}) AS l{k}" for k, axis in zip("xyz", placement.template_frame(), strict=True))
_PLACED = f"{_FRAMES}, t(base, atom_ord, atom, tx, ty, tz) AS (VALUES {_ATOMS}), l AS (SELECT base, atom_ord, atom, {_LOCAL} FROM t), placed AS (SELECT f.*, atom_ord, atom, x + xx * lx + yx * ly + zx * lz AS ax, y + xy * lx + yy * ly + zy * lz AS ay, z + xz * lx + yz * ly + zz * lz AS az FROM frames f JOIN l USING (base))"


@query(f"WITH {_PLACED} SELECT chain, residue_num, CAST(atom_ord AS INT) AS atom_ord, atom, round(ax, 5) + 0.0 AS ax, round(ay, 5) + 0.0 AS ay, round(az, 5) + 0.0 AS az FROM placed")
def template_place(spark, sf_dir):
    """Every atom of every residue."""
    p = placement.place_templates(_framed(spark, sf_dir))
    return p.select("chain", "residue_num", "atom_ord", "atom", *[rounded(F.col(f"a{a}"), 5).alias(f"a{a}") for a in "xyz"])


@query(
    f"WITH {_PLACED}, k AS (SELECT * FROM placed WHERE qx IS NOT NULL AND ((base = 'A' AND atom IN ('N1', 'N6')) OR (base = 'G' AND atom IN ('N1', 'O6')) OR (base = 'C' AND atom IN ('N3', 'N4')) OR (base = 'U' AND atom IN ('N3', 'O4')))), "
    "g AS (SELECT *, ax - x AS vx, ay - y AS vy, az - z AS vz, g.d AS degrees, radians(g.d) AS t FROM k, (SELECT unnest(range(0, 360, 15)) AS d) g), "
    "h AS (SELECT *, xx * vx + xy * vy + xz * vz AS dt FROM g), "
    "r AS (SELECT *, vx * cos(t) + (xy * vz - xz * vy) * sin(t) + xx * dt * (1 - cos(t)) AS ex, vy * cos(t) + (xz * vx - xx * vz) * sin(t) + xy * dt * (1 - cos(t)) AS ey, vz * cos(t) + (xx * vy - xy * vx) * sin(t) + xz * dt * (1 - cos(t)) AS ez FROM h), "
    "s AS (SELECT chain, residue_num, degrees, sum((ex * (qx - x) + ey * (qy - y) + ez * (qz - z)) / ((sqrt(ex * ex + ey * ey + ez * ez) + 1e-8) * (sqrt((qx - x) * (qx - x) + (qy - y) * (qy - y) + (qz - z) * (qz - z)) + 1e-8))) AS score FROM r GROUP BY 1, 2, 3), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY chain, residue_num ORDER BY round(score, 9) DESC, degrees) AS k FROM s) SELECT chain, residue_num, CAST(degrees AS INT) AS degrees, round(score, 5) + 0.0 AS score FROM o WHERE k = 1"
)
def angle_scan(spark, sf_dir):
    """The rotation of each residue that points its base at the partner."""
    best = placement.best_angle(placement.place_templates(_framed(spark, sf_dir)), ["chain", "residue_num"])
    return best.select("chain", "residue_num", "degrees", rounded(F.col("score"), 5).alias("score"))


@query()
def feature_scan(spark, sf_dir):
    """The rotation that fits base and sugar anchors (the next residue and the partner stand in for them)."""
    f = _framed(spark, sf_dir)
    order = Window.partitionBy("chain").orderBy("residue_num")
    for a in "xyz":
        f = f.withColumn(f"b{a}", F.lead(a).over(order)).withColumn(f"s{a}", F.lag(a).over(order))
    best = placement.best_angle_by_features(placement.place_templates(f), ["chain", "residue_num"])
    return best.select("chain", "residue_num", "degrees", rounded(F.col("loss"), 5).alias("loss"))


@query(
    f"WITH {_PLACED}, s AS (SELECT *, row_number() OVER (ORDER BY chain, residue_num, atom_ord) AS serial, CASE WHEN length(atom) < 4 THEN ' ' || rpad(atom, 3, ' ') ELSE atom END AS name FROM placed) "
    "SELECT CAST(serial AS INT) AS serial, printf('ATOM  %5d %4s %3s %1s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f          %2s', serial, name, base, 'A', residue_num, round(ax, 3) + 0.0, round(ay, 3) + 0.0, round(az, 3) + 0.0, 1.0, 20.0, substring(atom, 1, 1)) AS line FROM s"
)
def pdb_lines(spark, sf_dir):
    """Fixed-width atom records with global serials, which widen where five columns end."""
    p = placement.place_templates(_framed(spark, sf_dir))
    for a in "xyz":
        p = p.withColumn(f"a{a}", rounded(F.col(f"a{a}"), 3))
    lines = placement.pdb_lines(p.withColumn("order", F.col("chain") * 1_000_000 + F.col("residue_num")).withColumn("chain", F.lit("A")), ["order", "atom_ord"], widen=True)
    return lines


@query(f"WITH {CHAINS}, e AS (SELECT chain, residue_num, x, lag(x) OVER w AS sx, lag(y) OVER w AS sy, lag(z) OVER w AS sz, lead(x) OVER w AS wx, lead(y) OVER w AS wy, lead(z) OVER w AS wz, y, z, (id % 10) / 10.0 AS conf FROM chains WINDOW w AS (PARTITION BY chain ORDER BY residue_num)), "
    "d AS (SELECT *, sqrt(pow(wx - x, 2) + pow(wy - y, 2) + pow(wz - z, 2)) AS db, sqrt(pow(sx - x, 2) + pow(sy - y, 2) + pow(sz - z, 2)) AS ds FROM e), "
    "v AS (SELECT *, " + ", ".join(f"CASE WHEN coalesce(db, 0) > 1 THEN 0.7 * (w{k} - {k}) / db ELSE 0 END + CASE WHEN coalesce(ds, 0) > 1 THEN 0.3 * (s{k} - {k}) / ds ELSE 0 END AS v{k}" for k in "xyz") + " FROM d) "
    "SELECT chain, residue_num, round(vx / sqrt(vx * vx + vy * vy + vz * vz), 6) + 0.0 AS hx, round(vy / sqrt(vx * vx + vy * vy + vz * vz), 6) + 0.0 AS hy FROM v WHERE conf >= 0.75 AND sqrt(vx * vx + vy * vy + vz * vz) > 1e-6")
def orientation_hint(spark, sf_dir):
    """Direction of the weighted anchors where confidence allows."""
    order = Window.partitionBy("chain").orderBy("residue_num")
    c = chains(spark, sf_dir)
    for a in "xyz":
        c = c.withColumn(f"b{a}", F.lead(a).over(order)).withColumn(f"s{a}", F.lag(a).over(order))
    hint = placement.orientation_hint(V.vec("x", "y", "z"), V.vec("bx", "by", "bz"), V.vec("sx", "sy", "sz"), (F.col("id") % 10) / 10.0)
    return c.withColumn("h", hint).where("h is not null").select("chain", "residue_num", rounded(F.col("h.x")).alias("hx"), rounded(F.col("h.y")).alias("hy"))


_G = "CASE WHEN atom IN ('P', 'OP1', 'OP2') THEN [1] WHEN atom IN ('O5''', 'C5''', 'C4''', 'O4''', 'C3''', 'O3''', 'C2''', 'O2''', 'C1''') THEN [2] WHEN id % 3 = 2 THEN [3, 4] WHEN base IN ('A', 'G') THEN [3] ELSE [4] END"


@query(f"WITH {CHAINS}, t(base, atom_ord, atom, tx, ty, tz) AS (VALUES {_ATOMS}), c AS (SELECT chain, CAST(unnest({_G}) AS INT) AS class FROM chains JOIN t USING (base)) SELECT chain, class, count(*) AS n FROM c GROUP BY 1, 2")
def atom_classes(spark, sf_dir):
    """The label class of each atom in the typed layout; every third residue has a name of no base."""
    c = chains(spark, sf_dir).join(F.broadcast(placement.templates(spark)), "base")
    name = F.when(F.col("id") % 3 == 0, F.concat("base", F.lit("5"))).when(F.col("id") % 3 == 1, F.concat(F.lit("R"), "base")).otherwise(F.concat(F.lit("D"), "base", F.lit("5")))
    names = restraints.group_classes(F.col("atom"), name, F.lit(True))
    return c.select("chain", F.explode(names).alias("class")).groupBy("chain", "class").agg(F.count("*").alias("n"))


@query("SELECT kind, CASE WHEN kind LIKE 'c%' THEN 'typed' WHEN n = 5 THEN 'typed' WHEN n = 4 THEN 'four' WHEN top >= 4 THEN 'typed' ELSE 'four' END AS layout FROM (SELECT event_type AS kind, count(DISTINCT user_id % 6) AS n, max(user_id % 5) AS top FROM events GROUP BY 1)")
def layout_infer(spark, sf_dir):
    """The label layout by schema, names, number of classes or largest label."""
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.countDistinct(F.col("user_id") % 6).alias("n"), F.max(F.col("user_id") % 5).alias("top"))
    schema = F.when(F.col("kind").startswith("c"), "0bg_1p_2sugar_3purine_4pyrimidine")
    return e.select("kind", restraints.layout(schema, F.lit(None).cast("array<string>"), F.col("n"), F.col("top")).alias("layout"))


@query(
    "WITH c AS (SELECT o_custkey AS k, CASE WHEN o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) THEN 'base' ELSE 'c' || o_orderkey END AS name, (o_orderkey % 37) / 37.0 AS agreement, o_orderkey % 11 AS support, (o_orderkey % 23) / 23.0 AS pair_ratio, o_orderkey % 4 AS flips FROM orders), "
    "b AS (SELECT k, agreement AS a0, pair_ratio AS p0 FROM c WHERE name = 'base'), r AS (SELECT c.*, row_number() OVER (PARTITION BY c.k ORDER BY agreement DESC, support DESC, pair_ratio DESC, flips, name) AS n FROM c JOIN b ON b.k = c.k WHERE name = 'base' OR (agreement - a0 >= 0.10 - 1e-12 AND p0 - pair_ratio <= 0.15 + 1e-12)) "
    "SELECT k, name, support, flips FROM r WHERE n = 1"
)
def adaptive_select(spark, sf_dir):
    """The best eligible candidate of each key."""
    o = table(spark, sf_dir, "orders").withColumn("first", F.min("o_orderkey").over(Window.partitionBy("o_custkey")))
    c = o.select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") == F.col("first"), "base").otherwise(F.concat(F.lit("c"), F.col("o_orderkey").cast("string"))).alias("name"), ((F.col("o_orderkey") % 37) / 37.0).alias("agreement"), (F.col("o_orderkey") % 11).alias("support"), ((F.col("o_orderkey") % 23) / 23.0).alias("pair_ratio"), (F.col("o_orderkey") % 4).alias("flips"))
    return selection.choose_candidate(c, ["k"]).select("k", "name", "support", "flips")


@query("SELECT c_custkey AS k, c_custkey % 40 >= 24 AND ((c_custkey % 13) / 13.0 < 0.70 OR (c_custkey % 17 > 0 AND (c_custkey % 5) / (c_custkey % 17) < 0.65)) AS trigger FROM customer")
def adaptive_trigger(spark, sf_dir):
    """Whether a second registration is tried; no pairs, no ratio."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    ratio = F.try_divide(F.col("k") % 5, F.col("k") % 17)
    return c.select("k", selection.try_candidate(F.col("k") % 40, (F.col("k") % 13) / 13.0, ratio).alias("trigger"))


_PATH = (
    "ranked AS (SELECT label AS chain, vec_id AS id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INT) AS rn, CASE WHEN (vec_id * 13) % 11 < 5 THEN 1 ELSE -1 END AS g FROM embeddings), "
    "path AS (SELECT chain, rn - 1 AS path_pos, CASE WHEN id % 7 = 0 THEN 0 ELSE g END AS grp, 1.0 - (id % 4) * 0.25 AS conf FROM ranked), res AS (SELECT chain, rn - 3 AS residue_num, g AS grp FROM ranked WHERE rn > 3)"
)
_CONSENSUS = (
    f"{_PATH}, z AS (SELECT chain, (SELECT count(*) FROM path p WHERE p.chain = c.chain) AS np, (SELECT count(*) FROM res r WHERE r.chain = c.chain) AS ns FROM (SELECT DISTINCT chain FROM path) c), w AS (SELECT chain, np, ns, least(24, np, ns) AS win FROM z), "
    "st AS (SELECT DISTINCT chain, ns, win, np, unnest(list_append(range(0, greatest(1, np - win + 1), 2), greatest(0, np - win))) AS start FROM w), f AS (SELECT chain, ns, start, least(win, np - start) AS len FROM st WHERE least(win, np - start) >= greatest(4, win // 2)), "
    "pl AS (SELECT chain, start, len, 1 AS dir, unnest(range(1, ns - len + 2)) AS s0 FROM f UNION ALL SELECT chain, start, len, -1, unnest(range(len, ns + 1)) FROM f), "
    "sc AS (SELECT pl.chain, pl.start, pl.len, dir, s0, sum(CASE WHEN p.grp = r.grp THEN conf ELSE -conf END) AS score, count(*) AS known FROM pl JOIN path p ON p.chain = pl.chain AND p.path_pos >= pl.start AND p.path_pos < pl.start + pl.len AND p.grp <> 0 JOIN res r ON r.chain = pl.chain AND r.residue_num = s0 + dir * (p.path_pos - pl.start) AND r.grp <> 0 GROUP BY 1, 2, 3, 4, 5), "
    "bs AS (SELECT *, score / known AS norm, row_number() OVER (PARTITION BY chain, start ORDER BY score / known DESC, score DESC, s0 DESC, dir DESC, known DESC) AS k FROM sc), "
    "vt AS (SELECT chain, start + u.k AS path_pos, s0 + dir * u.k AS residue_num, greatest(0.001, norm + 1) AS weight, start FROM bs, unnest(range(len)) AS u(k) WHERE bs.k = 1), "
    "tv AS (SELECT chain, path_pos, residue_num, sum(weight) AS vote, min(start) AS first FROM vt GROUP BY 1, 2, 3), "
    "rk AS (SELECT *, row_number() OVER o AS k, coalesce(lead(vote) OVER o, 0) AS second, sum(vote) OVER (PARTITION BY chain, path_pos) AS total FROM tv WINDOW o AS (PARTITION BY chain, path_pos ORDER BY vote DESC, first, residue_num)), "
    "tp AS (SELECT chain, path_pos, residue_num, vote / total AS confidence, (vote - second) / total AS margin, total FROM rk WHERE k = 1), "
    "ok AS (SELECT *, row_number() OVER (PARTITION BY chain, residue_num ORDER BY confidence DESC, margin DESC, total DESC, path_pos) AS k FROM tp WHERE confidence >= 0.5 AND margin >= 0.3)"
)


def _consensus(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    r = e.select(F.col("label").alias("chain"), F.col("vec_id").alias("id"), rank.alias("rn"), F.when((F.col("vec_id") * 13) % 11 < 5, 1).otherwise(-1).alias("g"))
    path = r.select("chain", (F.col("rn") - 1).alias("path_pos"), F.when(F.col("id") % 7 == 0, 0).otherwise(F.col("g")).alias("grp"), (1.0 - (F.col("id") % 4) * 0.25).alias("conf"))
    return sequences.consensus(path, r.where("rn > 3").select("chain", (F.col("rn") - 3).alias("residue_num"), F.col("g").alias("grp")), ["chain"])


@query(f"WITH {_CONSENSUS} SELECT chain, CAST(path_pos AS INT) AS path_pos, CAST(residue_num AS INT) AS residue_num, round(confidence, 6) AS confidence, round(margin, 6) AS margin, round(total, 6) AS total_vote FROM ok WHERE k = 1")
def window_consensus(spark, sf_dir):
    """Windows of each path voted onto its sequence."""
    c = _consensus(spark, sf_dir)
    return c.select("chain", "path_pos", "residue_num", *[rounded(F.col(k)).alias(k) for k in ("confidence", "margin", "total_vote")])


_STEPS = "st AS (SELECT o_custkey AS k, CAST(row_number() OVER w AS INT) AS path_pos, CAST((o_orderkey // 3) % 3 + row_number() OVER w AS INT) AS residue_num FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))"


@query(
    f"WITH RECURSIVE {_STEPS}, r AS (SELECT k, path_pos, residue_num, CAST(0 AS BIGINT) AS run, 0 AS dir FROM st WHERE path_pos = 1 UNION ALL SELECT st.k, st.path_pos, st.residue_num, "
    "CASE WHEN abs(st.residue_num - r.residue_num) = 1 AND (r.dir = 0 OR r.dir = st.residue_num - r.residue_num) THEN r.run ELSE r.run + 1 END, CASE WHEN abs(st.residue_num - r.residue_num) = 1 AND (r.dir = 0 OR r.dir = st.residue_num - r.residue_num) THEN st.residue_num - r.residue_num ELSE 0 END FROM r JOIN st ON st.k = r.k AND st.path_pos = r.path_pos + 1) "
    "SELECT k, run, min(path_pos) AS first, count(*) AS length FROM r GROUP BY k, run HAVING count(*) >= 3"
)
def fragment_runs(spark, sf_dir):
    """Runs in one direction; the row that turns starts the next run."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    at = F.row_number().over(w)
    st = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), at.alias("path_pos"), (F.floor(F.col("o_orderkey") / 3) % 3 + at).cast("int").alias("residue_num"))
    return sequences.directed_runs(st, ["k"], "k long, path_pos int, residue_num int").groupBy("k", "run").agg(F.min("path_pos").alias("first"), F.count("*").alias("length")).where("length >= 3")


@query()
def fragment_anchors(spark, sf_dir):
    """Trimmed directed runs of the consensus with their statistics."""
    c = _consensus(spark, sf_dir).select("chain", "path_pos", "residue_num", "confidence", "margin")
    r = sequences.directed_runs(c, ["chain"], "chain int, path_pos int, residue_num int, confidence double, margin double")
    return sequences.anchors(r, ["chain"]).select("chain", "run", "path_start", "path_end", "residue_start", "residue_end", "length", "direction", *[rounded(F.col(x)).alias(x) for x in ("mean_confidence", "min_confidence", "mean_margin", "min_margin")])


_CELL = "sc AS (SELECT CAST(l_orderkey % 10 AS INT) AS k, CAST(l_partkey % 30 AS INT) AS a, CAST(l_suppkey % 30 AS INT) AS s, round(sum(l_discount - 0.05), 6) AS score FROM lineitem GROUP BY 1, 2, 3)"


@query(
    f"WITH {_CELL}, n AS (SELECT k, max(greatest(a, s)) + 1 AS n FROM sc GROUP BY k), ij AS (SELECT k, i, j FROM n, unnest(range(n)) AS t(i), unnest(range(n + 1)) AS u(j) WHERE j - i >= 2), "
    "got AS (SELECT ij.k, i, j, sum(score) AS got FROM ij JOIN sc ON sc.k = ij.k AND sc.a + sc.s = i + j - 1 AND least(sc.a, sc.s) >= i AND greatest(sc.a, sc.s) < j GROUP BY 1, 2, 3), "
    "had AS (SELECT ij.k, i, j, sum(score) AS had FROM ij JOIN sc ON sc.k = ij.k AND sc.a = sc.s AND sc.a >= i AND sc.a < j GROUP BY 1, 2, 3), "
    "g AS (SELECT ij.k, ij.i, ij.j, coalesce(got, 0) - coalesce(had, 0) AS gain FROM ij LEFT JOIN got USING (k, i, j) LEFT JOIN had USING (k, i, j)), b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(gain, 9) DESC, i, j) AS r FROM g WHERE gain > 1e-10) "
    "SELECT k, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(gain, 6) AS gain FROM b WHERE r = 1"
)
def flip_best(spark, sf_dir):
    """The reversal with the largest gain, in closed form."""
    l = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 10).cast("int").alias("k"), (F.col("l_partkey") % 30).cast("int").alias("atom_pos"), (F.col("l_suppkey") % 30).cast("int").alias("seq_pos")).agg(F.round(F.sum(F.col("l_discount") - 0.05), 6).alias("score"))
    best = flips.best_flip(flips.flip_gains(l, ["k"]), ["k"])
    return best.select("k", "i", "j", rounded(F.col("gain")).alias("gain"))


def _full_paths(spark, sf_dir):
    """Chains of 48 points in the order of their ids with hairpin pairs, some left out, groups and confidences."""
    c = cloud(spark, sf_dir).select(F.expr("id div 48").cast("int").alias("chain"), F.expr("id % 48").cast("int").alias("at"), "id", "x", "y", "z")
    grp = F.expr("case when id % 7 = 0 then 0 when id * 13 % 11 < 5 then 1 else -1 end")
    conf = F.expr("1.0D - (id % 4) * 0.25D")
    site = F.struct("at", F.col("id").alias("atom"), "x", "y", "z", grp.alias("grp"), conf.alias("conf"), F.lit(None).cast("int").alias("anchor"), F.when(F.col("id") % 2 == 0, 1).otherwise(-1).alias("wanted"))
    rows = c.groupBy("chain").agg(F.array_sort(F.collect_list(site)).alias("s"), F.collect_list(F.when(F.expr("at < 20 and id % 3 <> 0"), F.struct((F.col("at") + 1).alias("i"), (48 - F.col("at")).alias("j")))).alias("pairs"))
    path = F.transform("s", lambda p: F.struct(*[p[k].alias(k) for k in ("atom", "x", "y", "z", "grp", "conf", "anchor")]))
    return rows.select("chain", path.alias("path"), "pairs", F.transform("s", lambda p: p["wanted"]).alias("groups"))


_MOVED = "CASE WHEN {p} >= ij.i AND {p} < ij.j THEN ij.i + ij.j - 1 - {p} ELSE {p} END"
_FULL = (
    f"WITH {CLOUD}, c AS (SELECT id // 48 AS chain, CAST(id % 48 AS INT) AS p, id, x, y, z, CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END AS w, CASE WHEN id % 7 = 0 THEN 0 WHEN (id * 13) % 11 < 5 THEN 1 ELSE -1 END * (1.0 - (id % 4) * 0.25) AS g FROM cloud), "
    "d AS MATERIALIZED (SELECT a.chain, a.p, b.p AS q, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM c a JOIN c b ON a.chain = b.chain), o AS MATERIALIZED (SELECT *, CASE WHEN d BETWEEN 15 AND 22 THEN 1 ELSE 0 END AS ok FROM d), "
    "pr AS (SELECT a.chain, a.p AS a, b.p AS b FROM c a JOIN c b ON a.chain = b.chain AND b.p = 47 - a.p WHERE a.p < 20 AND a.id % 3 <> 0), "
    "n AS (SELECT chain, count(*) AS n FROM c GROUP BY chain), ij AS MATERIALIZED (SELECT chain, n, CAST(i AS INT) AS i, CAST(j AS INT) AS j FROM n, unnest(range(n)) AS t(i), unnest(range(n + 1)) AS u(j) WHERE j - i >= 20), "
    f"pm AS MATERIALIZED (SELECT ij.chain, ij.i, ij.j, pr.a, pr.b, {_MOVED.format(p='pr.a')} AS ma, {_MOVED.format(p='pr.b')} AS mb FROM ij JOIN pr ON pr.chain = ij.chain), pk AS MATERIALIZED (SELECT pm.*, n.ok AS now, w.ok AS was FROM pm JOIN o n ON n.chain = pm.chain AND n.p = ma AND n.q = mb JOIN o w ON w.chain = pm.chain AND w.p = a AND w.q = b), "
    "pg AS MATERIALIZED (SELECT chain, i, j, sum(now - was) AS g FROM pk GROUP BY 1, 2, 3), sg AS MATERIALIZED (SELECT l.chain, l.i, l.j, sum(l.now * r.now - l.was * r.was) AS g FROM pk l JOIN pk r ON r.chain = l.chain AND r.i = l.i AND r.j = l.j AND r.a = l.a + 1 AND r.b = l.b - 1 GROUP BY 1, 2, 3), "
    "bg AS MATERIALIZED (SELECT ij.chain, ij.i, ij.j, sum(s.w * a.g - s.w * s.g) AS g FROM ij JOIN c s ON s.chain = ij.chain AND s.p >= ij.i AND s.p < ij.j JOIN c a ON a.chain = ij.chain AND a.p = ij.i + ij.j - 1 - s.p GROUP BY 1, 2, 3), "
    "al AS (SELECT ij.chain, ij.i, ij.j, coalesce(pg.g, 0) + 0.3 * coalesce(sg.g, 0) + 2.0 * bg.g + 5.0 * (coalesce(d1.d, 0) - coalesce(d3.d, 0) + coalesce(d2.d, 0) - coalesce(d4.d, 0)) AS gain FROM ij LEFT JOIN pg USING (chain, i, j) LEFT JOIN sg USING (chain, i, j) JOIN bg USING (chain, i, j) "
    "LEFT JOIN d d1 ON d1.chain = ij.chain AND d1.p = ij.i - 1 AND d1.q = ij.i LEFT JOIN d d3 ON d3.chain = ij.chain AND d3.p = ij.i - 1 AND d3.q = ij.j - 1 LEFT JOIN d d2 ON d2.chain = ij.chain AND d2.p = ij.j - 1 AND d2.q = ij.j LEFT JOIN d d4 ON d4.chain = ij.chain AND d4.p = ij.i AND d4.q = ij.j), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY round(gain, 9) DESC, i, j) AS k FROM al WHERE gain > 1e-10) "
)


@query(f"{_FULL} SELECT CAST(chain AS INT) AS chain, i, j, round(gain, 6) AS gain FROM r WHERE k = 1")
def flip_full(spark, sf_dir):
    """The reversal that gains most by pairs, stacks, seams and bases, of twenty places at least."""
    best = flips.register_paths(_full_paths(spark, sf_dir), ["chain"], most_flips=1).where(F.size("flips") > 0)
    return best.select("chain", F.get("flips", F.lit(0))["i"].alias("i"), F.get("flips", F.lit(0))["j"].alias("j"), rounded(F.col("last_gain")).alias("gain"))


@query()
def flip_climb(spark, sf_dir):
    """All reversals of each chain until none gains; tests hold the climb against trying every one."""
    out = flips.register_paths(_full_paths(spark, sf_dir), ["chain"])
    return out.select("chain", F.array_join(F.col("atoms").cast("array<string>"), ",").alias("atoms"), F.to_json("flips").alias("flips"), "satisfied", "total")


def _registered(spark, sf_dir):
    """Chains of 60 points with hairpin pairs; other components of their vectors are labelled voxels around the chain."""
    e = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 60").cast("int").alias("chain"), F.expr("vec_id % 60").cast("long").alias("atom"), "embedding")
    part = lambda k: F.element_at("embedding", k).cast("double") * 50
    sites = e.select("chain", "atom", *[part(k + 1).alias(a) for k, a in enumerate("xyz")])
    residues = e.select("chain", (F.col("atom") + 1).cast("int").alias("residue_num"), F.element_at(F.array(*[F.lit(b) for b in "ACGU"]), F.expr("cast(atom * 7 % 11 % 4 + 1 as int)")).alias("base"))
    base_pairs = e.where("atom < 25 and atom % 4 <> 3").select("chain", (F.col("atom") + 1).cast("int").alias("i"), (60 - F.col("atom")).cast("int").alias("j"))
    base_pairs = base_pairs.join(residues.select("chain", F.col("residue_num").alias("j")), ["chain", "j"], "left_semi").select("chain", "i", "j")
    cells = e.select("chain", "atom", F.posexplode(F.transform(F.sequence(F.lit(4), F.lit(58), F.lit(3)), lambda k: F.transform(F.array(k, k + 1, k + 2), lambda c: F.floor(F.get("embedding", c - 1).cast("double") * 25).cast("int")))).alias("n", "c"))
    cells = cells.groupBy("chain", *[F.get("c", F.lit(k)).alias(f"c{a}") for k, a in enumerate("xyz")]).agg((F.max((F.col("atom") + F.col("n")) % 3) + 2).cast("int").alias("label"))
    voxels = cells.select("chain", "label", "cz", "cy", "cx", *[(F.col(f"c{a}") * 2.0).alias(a) for a in "xyz"])
    return sites, residues, base_pairs, voxels


@query()
def registration_documents(spark, sf_dir):
    """Positions, pairs and labels of each chain to its registration document."""
    sites, residues, base_pairs, voxels = _registered(spark, sf_dir)
    out = registration.register(sites, residues, base_pairs, voxels, ["chain"])
    featured = registration.attach_features(out.atoms, voxels, ["chain"])
    return registration.documents(out, featured, residues, sites, base_pairs, ["chain"])


@query("SELECT label AS k, array_to_string(list_concat(list_concat(a[1:2], list_reverse(a[3:5])), a[6:]), ',') AS path FROM (SELECT label, list(vec_id ORDER BY vec_id) AS a FROM embeddings GROUP BY label)")
def path_flip(spark, sf_dir):
    """A segment of each path reversed."""
    p = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("k")).agg(F.sort_array(F.collect_list("vec_id")).alias("path"))
    return p.select("k", F.array_join(flips.reversed_slice(F.col("path"), F.lit(2), F.lit(5)).cast("array<string>"), ",").alias("path"))


@query()
def path_trace(spark, sf_dir):
    """G20 (fallback): an open path through each class of points."""
    return kernels.open_path(cloud(spark, sf_dir).select("label", "id", "x", "y", "z"), ["label"])


@query()
def cluster_peaks(spark, sf_dir):
    """Three weighted centres of each class of points."""
    v = cloud(spark, sf_dir).withColumn("density", F.col("x") * F.col("x") + 1.0).withColumn("n", F.lit(3))
    out = kernels.weighted_kmeans(v.select("label", "density", "n", "z", "y", "x"), ["label"])
    return out.select("label", "peak", *[rounded(F.col(a), 4).alias(a) for a in "zyx"])


@query(
    f"WITH {CHAINS}, e AS (SELECT chain, min(residue_num) AS lo, max(residue_num) AS hi FROM chains GROUP BY chain) SELECT c.chain, c.residue_num, CASE WHEN c.residue_num = e.hi THEN base || '3' ELSE base END AS name FROM chains c JOIN e ON e.chain = c.chain"
)
def terminal_names(spark, sf_dir):
    """The last residue of each chain gets its terminal name."""
    return restraints.rename_last(chains(spark, sf_dir), ["chain"]).select("chain", "residue_num", "name")


@query(
    f"WITH {_PLACED}, f AS (SELECT * FROM placed WHERE residue_num = 1), u AS (SELECT chain, atom, ax - max(CASE WHEN atom = 'P' THEN ax END) OVER (PARTITION BY chain) AS vx, ay - max(CASE WHEN atom = 'P' THEN ay END) OVER (PARTITION BY chain) AS vy, az - max(CASE WHEN atom = 'P' THEN az END) OVER (PARTITION BY chain) AS vz, max(CASE WHEN atom = 'P' THEN ax END) OVER (PARTITION BY chain) AS px FROM f), "
    "s AS (SELECT chain, any_value(px) AS px, sum(vx / (sqrt(vx * vx + vy * vy + vz * vz) + 1e-8)) AS tx, sum(vy / (sqrt(vx * vx + vy * vy + vz * vz) + 1e-8)) AS ty, sum(vz / (sqrt(vx * vx + vy * vy + vz * vz) + 1e-8)) AS tz FROM u WHERE atom IN ('OP1', 'OP2', 'O5''') GROUP BY chain) SELECT chain, 'P5' AS base, 'OP3' AS atom, round(px - 1.5 * tx / sqrt(tx * tx + ty * ty + tz * tz), 5) + 0.0 AS x FROM s"
)
def chain_caps(spark, sf_dir):
    """A cap atom in front of each chain."""
    p = placement.place_templates(_framed(spark, sf_dir)).select("chain", "residue_num", "base", "atom", *[F.col(f"a{a}").alias(a) for a in "xyz"])
    return restraints.add_caps(restraints.strip_caps(p), ["chain"]).select("chain", "base", "atom", rounded(F.col("x"), 5).alias("x"))


@query(f"WITH {CHAINS} SELECT id, CAST(100000 AS DOUBLE) AS weight, round(x / 10, 6) + 0.0 AS x_nm, round(y / 10, 6) + 0.0 AS y_nm, round(z / 10, 6) + 0.0 AS z_nm FROM chains")
def position_restraints(spark, sf_dir):
    """Harmonic restraints in nm."""
    r = restraints.position_restraints(chains(spark, sf_dir).withColumn("atom", F.lit("P")))
    return r.select("id", "weight", *[rounded(F.col(f"{a}_nm")).alias(f"{a}_nm") for a in "xyz"])


@query(
    f"WITH {CHAINS}, v AS (SELECT CAST(id % 5 AS INT) AS class, x, y, z FROM chains), a AS (SELECT id, CASE WHEN base IN ('A', 'G') THEN 3 ELSE 4 END AS class, x, y, z FROM chains), "
    "m AS (SELECT a.id, count(*) AS n, avg(v.x) AS tx, avg(v.y) AS ty, avg(v.z) AS tz FROM a JOIN v ON v.class = a.class AND abs(v.x - a.x) <= 4 AND abs(v.y - a.y) <= 4 AND abs(v.z - a.z) <= 4 GROUP BY a.id) SELECT id, n, round(tx, 6) + 0.0 AS tx, round(ty, 6) + 0.0 AS ty, round(tz, 6) + 0.0 AS tz FROM m"
)
def density_targets(spark, sf_dir):
    """The mean of the matching class around each atom."""
    c = chains(spark, sf_dir)
    voxels = c.select((F.col("id") % 5).cast("int").alias("class"), "x", "y", "z")
    atoms = c.select("id", restraints.group_classes(F.lit("N9"), F.col("base"), F.lit(True)).alias("classes"), "x", "y", "z")
    t = restraints.density_targets(atoms, voxels, 4.0)
    return t.select("id", "n", *[rounded(F.col(f"t{a}")).alias(f"t{a}") for a in "xyz"])
