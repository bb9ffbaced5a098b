"""Queries over point clouds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.numeric import rounded
from ..operators import graph, kernels, spatial
from .adapters import CLOUD, cloud
from .registry import query

_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


@query(f"WITH {CLOUD} SELECT a.id AS a, b.id AS b, round({_D}, 6) AS d FROM cloud a JOIN cloud b ON a.id < b.id WHERE {_D} <= 2.0")
def radius_neighbors(spark, sf_dir):
    """All pairs within 2."""
    return spatial.radius_pairs(cloud(spark, sf_dir), 2.0).select("a", "b", rounded(F.col("d")).alias("d"))


_CENTERS = "centers AS (SELECT label AS target, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM cloud GROUP BY label)"


@query(
    f"WITH {CLOUD}, {_CENTERS}, p AS (SELECT a.id, b.target, round({_D}, 6) AS d, row_number() OVER (PARTITION BY a.id ORDER BY round({_D}, 6), b.target) AS k FROM cloud a, centers b WHERE {_D} <= 10) SELECT id, target, d FROM p WHERE k = 1"
)
def nearest_centroid(spark, sf_dir):
    """Each point's nearest class centre within 10, the lowest class in a tie."""
    c = cloud(spark, sf_dir)
    centers = c.groupBy(F.col("label").alias("target")).agg(*[F.avg(a).alias(a) for a in "xyz"])
    return spatial.nearest_of_few(c, centers, 10.0).select("id", "target", rounded(F.col("d")).alias("d"))


@query(
    f"WITH {CLOUD}, n AS (SELECT a.label, a.id, min(CASE WHEN {_D} <= 12 THEN {_D} END) AS nn FROM cloud a LEFT JOIN cloud b ON a.label = b.label AND a.id <> b.id GROUP BY 1, 2) "
    "SELECT label, count(*) AS n, round(avg(nn), 6) AS nn_mean, round(min(nn), 6) AS nn_min, round(max(nn), 6) AS nn_max, count(*) FILTER (nn BETWEEN 4 AND 8) AS n_typical, count(*) FILTER (nn < 2) AS n_close FROM n GROUP BY label"
)
def nn_stats(spark, sf_dir):
    """Nearest-neighbour distances of each class."""
    s = spatial.separation_stats(cloud(spark, sf_dir), 12.0, ("label",))
    return s.select("label", "n", *[rounded(F.col(c)).alias(c) for c in ("nn_mean", "nn_min", "nn_max")], "n_typical", "n_close")


@query(
    f"WITH {CLOUD}, e AS (SELECT *, CASE WHEN label < 5 THEN 'purine' ELSE 'pyrimidine' END AS kind FROM cloud), "
    f"v AS (SELECT a.id, count(*) FILTER (b.kind = 'purine') AS pu, count(*) FILTER (b.kind = 'pyrimidine') AS py FROM cloud a JOIN e b ON {_D} <= 4 GROUP BY a.id) "
    "SELECT id, pu AS purine, py AS pyrimidine, CASE WHEN pu + py >= 5 AND pu > py THEN 'purine' WHEN pu + py >= 5 AND py > pu THEN 'pyrimidine' ELSE 'unknown' END AS call, "
    "CASE WHEN pu + py >= 5 AND pu <> py THEN round(abs(pu - py) / (pu + py), 6) ELSE 0.0 END AS confidence FROM v"
)
def evidence_majority(spark, sf_dir):
    """Which of two kinds prevails around each point."""
    c = cloud(spark, sf_dir)
    e = c.withColumn("kind", F.when(F.col("label") < 5, "purine").otherwise("pyrimidine"))
    return spatial.majority_evidence(c, e, 4.0).withColumn("confidence", rounded(F.col("confidence")))


@query(
    f"WITH {CLOUD} SELECT a.id, count(b.id) AS n, round(avg(b.x), 6) + 0.0 AS mx, round(avg(b.y), 6) + 0.0 AS my, round(avg(b.z), 6) + 0.0 AS mz FROM cloud a LEFT JOIN cloud b ON b.label = (a.label + 1) % 10 AND abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3 AND abs(a.z - b.z) <= 3 GROUP BY a.id"
)
def box_mean_target(spark, sf_dir):
    """Mean point of the next class in a box around each point."""
    c = cloud(spark, sf_dir)
    left = c.withColumn("class", ((F.col("label") + 1) % 10).cast("int"))
    right = c.withColumn("class", F.col("label").cast("int"))
    m = spatial.box_means(left, right, 3.0, keys=("class",))
    return m.select("id", "n", *[rounded(F.col(k)).alias(k) for k in ("mx", "my", "mz")])


_REACH = "r AS (SELECT id, id AS hop FROM cloud UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.hop), c AS (SELECT id, min(hop) AS component FROM r GROUP BY id)"


@query(f"WITH RECURSIVE {CLOUD}, e AS (SELECT a.id AS a, b.id AS b FROM cloud a JOIN cloud b ON a.id <> b.id WHERE {_D} <= 2.5), {_REACH} SELECT component, count(*) AS size FROM c GROUP BY component")
def components_radius(spark, sf_dir):
    """Components of the radius graph with their sizes."""
    c = cloud(spark, sf_dir)
    labels = graph.connected_components(c, spatial.radius_pairs(c, 2.5))
    return labels.groupBy("component").agg(F.count("*").alias("size"))


def _threshold_sql(t: float) -> str:
    return f"SELECT * FROM (WITH RECURSIVE {CLOUD}, e AS (SELECT a.id AS a, b.id AS b FROM cloud a JOIN cloud b ON a.id <> b.id WHERE {_D} <= {t}), {_REACH} SELECT CAST({t} AS DOUBLE) AS threshold, count(DISTINCT component) AS components FROM c)"


@query(" UNION ALL ".join(map(_threshold_sql, (2.0, 3.0, 4.0))))
def connectivity_threshold(spark, sf_dir):
    """How many components each threshold leaves."""
    c = cloud(spark, sf_dir)
    return graph.first_connecting(spatial.radius_pairs(c, 4.0), c, [2.0, 3.0, 4.0])


@query(
    "SELECT count(*) FILTER (components <= 1) > 0 AS connected, coalesce(min(threshold) FILTER (components <= 1), max(threshold)) AS threshold, "
    f"coalesce(arg_min(components, threshold) FILTER (components <= 1), arg_max(components, threshold)) AS components FROM ({' UNION ALL '.join(map(_threshold_sql, (2.0, 4.0, 8.0, 12.0)))})"
)
def connectivity_report(spark, sf_dir):
    """The first threshold that connects all points, else the largest and the components it leaves."""
    c = cloud(spark, sf_dir)
    return graph.connected_at(spatial.connected_counts(c, [2.0, 4.0, 8.0, 12.0]))


@query(
    f"WITH RECURSIVE {CLOUD}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS k FROM cloud), n AS (SELECT label, max(k) AS n FROM o GROUP BY label), "
    "s AS (SELECT label, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(id BIGINT, x DOUBLE, y DOUBLE, z DOUBLE)[]) AS kept FROM n UNION ALL "
    "SELECT s.label, o.k, CASE WHEN len(list_filter(s.kept, lambda q: sqrt((q.x - o.x) * (q.x - o.x) + (q.y - o.y) * (q.y - o.y) + (q.z - o.z) * (q.z - o.z)) < 6.0 - 1e-9)) = 0 THEN list_append(s.kept, {'id': o.id, 'x': o.x, 'y': o.y, 'z': o.z}) ELSE s.kept END FROM s JOIN o ON o.label = s.label AND o.k = s.k + 1) "
    "SELECT s.label, q.id FROM s JOIN n ON n.label = s.label AND s.k = n.n, unnest(s.kept) AS t(q)"
)
def nms_greedy(spark, sf_dir):
    """Greedy suppression of each class, smallest id first, separation 6, in rounds of local winners."""
    c = cloud(spark, sf_dir)
    pairs = spatial.radius_pairs(c, 6.0, keys=("label",)).where(F.col("d") < 6.0 - 1e-9)
    return c.join(kernels.suppress_rounds(c.select("id", F.col("id").alias("rank")), pairs), "id").select("label", "id")


@query(
    f"WITH RECURSIVE {CLOUD}, s AS (SELECT * FROM cloud WHERE label = 0), near AS (SELECT a.id AS site, b.label, b.id, b.x, b.y, b.z, {_D} AS d FROM s a JOIN cloud b ON {_D} <= 6), "
    f"e AS (SELECT a.site, a.label, a.id AS a, b.id AS b FROM near a JOIN near b ON a.site = b.site AND a.label = b.label AND a.id <> b.id AND {_D} <= 3), "
    "r AS (SELECT site, label, id, id AS hop FROM near UNION SELECT r.site, r.label, r.id, e.b FROM r JOIN e ON e.site = r.site AND e.label = r.label AND e.a = r.hop), "
    "c AS (SELECT site, label, id, min(hop) AS component FROM r GROUP BY 1, 2, 3), "
    "g AS (SELECT c.site, c.label, c.component, count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM c JOIN near USING (site, label, id) GROUP BY 1, 2, 3 HAVING count(*) >= 2), "
    "k AS (SELECT g.*, sqrt((cx - s.x) * (cx - s.x) + (cy - s.y) * (cy - s.y) + (cz - s.z) * (cz - s.z)) AS distance FROM g JOIN s ON s.id = g.site), "
    "q AS (SELECT *, row_number() OVER (PARTITION BY site, label ORDER BY abs(distance - 3.8), n DESC, distance, component) AS rk FROM k) "
    "SELECT site, label, component, n, round(distance, 6) AS distance, round(exp(-pow((distance - 3.8) / 2.5, 2)), 6) AS score FROM q WHERE rk = 1"
)
def site_components(spark, sf_dir):
    """Around each site of class 0 the components of every class, and the one that fits best."""
    c = cloud(spark, sf_dir)
    groups = spatial.components_around(c.where("label = 0"), c, 6.0, 3.0)
    groups = groups.withColumn("distance", V.norm(V.sub(V.vec("cx", "cy", "cz"), V.unpacked(F.col("s")))))
    best = spatial.choose_component(groups, ["site", "label"], 3.8)
    return best.select("site", "label", "component", "n", rounded(F.col("distance")).alias("distance"), rounded(V.gaussian_score(F.col("distance"), 3.8, 2.5)).alias("score"))
