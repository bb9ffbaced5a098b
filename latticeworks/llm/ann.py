"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are scaled to length one, assigned to the nearest of about sqrt(n) centroids, and the residual's direction is
rotated and kept as one sign bit per dimension with three correction scalars. A query estimates every inner product of
a probed list from the bits; the estimate's error bound decides which originals are read for exact cosines. How many
lists are probed follows from the recall measured on the vectors from which the centroids are fitted. Lists are cut
into chunks of bounded size, so a list that holds a third of all vectors is searched by many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

#: Vectors from which the centroids are fitted, at most about so many, chosen by a hash of vec_id.
SAMPLE_ROWS = 20_000
#: Lists at most: so many centroids are broadcast, and fitted from the sample.
MOST_LISTS = 4096
#: Of the sample's true neighbours, the share that lies in the lists which are probed.
RECALL = 0.95
#: Vectors of a list, and queries, that meet in one task.
CHUNK, QUERY_BLOCK = 4096, 2048
#: Widths of the confidence interval: standard errors of the estimate on either side.
EPSILON = 2.5


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def fit_centroids(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Plain k-means on unit vectors; fewer centroids if there are fewer vectors."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that can take part and their vectors: ``dim`` finite components, not all zero."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    good = np.flatnonzero(sizes == dim)
    values = column.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(good), dim)
    fine = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
    return good[fine], values[fine]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(x: np.ndarray, centroids: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, ...]:
    """List, packed sign bits, residual length, product of code and direction, and product with the centroid."""
    near = np.argmax(x @ centroids.T - 0.5 * (centroids * centroids).sum(axis=1), axis=1)
    rest = x - centroids[near]
    length = np.linalg.norm(rest, axis=1)
    turned = (rest / np.maximum(length, 1e-12)[:, None]) @ turn
    bits = turned > 0
    fit = np.abs(turned).sum(axis=1) / np.sqrt(x.shape[1])
    return near, np.packbits(bits, axis=1), length, np.maximum(fit, 1e-6), (x * centroids[near]).sum(axis=1)


def list_count(n: int) -> int:
    """Lists for ``n`` vectors: half the square root of n, so that lists grow as slowly as their number."""
    return int(np.clip(round(np.sqrt(n) / 2), 1, MOST_LISTS))


def probes_for(x: np.ndarray, centroids: np.ndarray, k: int, recall: float = RECALL, queries: int = 400) -> int:
    """Lists to probe: the fewest that hold ``recall`` of the ``k`` nearest of some of the unit vectors ``x`` in ``x``."""
    if len(x) < 2:
        return len(centroids)
    half = 0.5 * (centroids * centroids).sum(axis=1)
    near = np.argmax(x @ centroids.T - half, axis=1)
    asked = np.linspace(0, len(x) - 1, min(queries, len(x))).astype(np.int64)
    place = np.argsort(np.argsort(-(x[asked] @ centroids.T - half), axis=1, kind="stable"), axis=1)
    cosine = x[asked] @ x.T
    cosine[np.arange(len(asked)), asked] = -np.inf
    k = min(k, len(x) - 1)
    found = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    rank = np.sort(place[np.arange(len(asked))[:, None], near[found]].reshape(-1))
    return int(rank[min(len(rank) - 1, int(np.ceil(recall * len(rank))) - 1)]) + 1


def _valid(vectors: DataFrame) -> DataFrame:
    """vec_id, vector of the rows that can take part: finite components, not all zero, of the commonest dimension."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).where("vec_id is not null and size(vector) > 0")
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    x = x.where(F.forall("vector", fine) & F.exists("vector", lambda v: v != 0))
    most = x.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").head()
    return x.where(F.size("vector") == (most["dim"] if most else 0))


def build_index(vectors: DataFrame, seed: int, lists: int | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """The index over every valid row of ``vectors`` (vec_id, embedding), its centroids, its rotation and the unit
    vectors from which the centroids were fitted.

    Rows whose vector is null, zero, of another dimension than most, or holds null or non-finite components are left
    out. The centroids come from about SAMPLE_ROWS vectors, every row is indexed; ``rid`` numbers the rows.
    """
    spark = vectors.sparkSession
    x = _valid(vectors)
    n = x.count()
    share = min(1.0, SAMPLE_ROWS / max(1, n))
    taken = x.where(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).orderBy(F.xxhash64("vector"), "vec_id").select(F.col("vector").cast("array<double>").alias("vector")).toArrow().column(0).combine_chunks()
    dim = len(taken[0]) if len(taken) else 1
    sample = unit(_matrix(taken, dim)[1]) if len(taken) else np.zeros((0, dim))
    centroids = fit_centroids(sample, min(lists or list_count(n), max(1, len(sample))), seed) if len(sample) else np.zeros((1, dim))
    turn = rotation(dim, seed)
    shared = spark.sparkContext.broadcast((centroids, turn))

    def run(batches):
        c, t = shared.value
        for batch in batches:
            _, raw = _matrix(batch.column(2), dim)
            if len(raw):
                near, code, length, fit, along = encode(unit(raw), c, t)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array([b.tobytes() for b in code], pa.binary()), pa.array(length), pa.array(fit), pa.array(along), batch.column(2)],
                    ["rid", "vec_id", "list", "code", "length", "fit", "along", "vector"],
                )

    vector = x.schema["vector"].dataType.simpleString()
    schema = f"rid long, vec_id long, list int, code binary, length double, fit double, along double, vector {vector}"
    rows = x.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "vector")
    return materialize(rows.mapInArrow(run, schema), "ann_index"), centroids, turn, sample


def estimate(queries: np.ndarray, codes: np.ndarray, length: np.ndarray, fit: np.ndarray, along: np.ndarray, centroid: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines (query by code) of unit vectors in one list and how far they may be off."""
    dim = queries.shape[1]
    rest = queries - centroid
    q_length = np.linalg.norm(rest, axis=1)
    turned = (rest / np.maximum(q_length, 1e-12)[:, None]) @ turn
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    raw = (turned.astype(np.float32) @ signs.T).astype(np.float64) / np.sqrt(dim)
    scale = q_length[:, None] * length[None, :]
    value = raw / fit * scale + along + (queries @ centroid)[:, None] - centroid @ centroid
    error = np.sqrt(np.maximum(0.0, 1 - fit**2)) / fit * EPSILON / np.sqrt(max(1, dim - 1))
    return value, scale * error + 1e-6


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, lists: int | None = None, probes: int | None = None, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: for each valid row whose vec_id is divisible by ``every``, its ``k`` nearest found.

    Nearness is the largest cosine in double precision, ties go to the smaller vec_id. Candidates are all valid rows but
    the query's own: repeated vec_ids are queries and candidates of their own. Fewer candidates give fewer rows, an
    empty table gives none. ``lists`` and ``probes`` follow from the number of rows and from RECALL if not given.
    """
    spark = vectors.sparkSession
    index, centroids, turn, sample = build_index(vectors, seed, lists)
    probes = min(probes or probes_for(sample, centroids, k), len(centroids))
    shared = spark.sparkContext.broadcast((centroids, turn))
    dim = centroids.shape[1]
    sizes = index.groupBy("list").agg(F.count("*").alias("n")).withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    table = lambda column: column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)

    def probe(batches):
        c, _ = shared.value
        for batch in batches:
            if not len(batch):
                continue
            order = np.argsort(-(unit(table(batch.column(2))) @ c.T - 0.5 * (c * c).sum(axis=1)), axis=1, kind="stable")[:, :probes]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(order.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["query", "query_id", "vector", "lists"])

    vector = index.schema["vector"].dataType.simpleString()
    asked = index.where(F.col("vec_id") % every == 0).select("rid", "vec_id", "vector").mapInArrow(probe, f"query long, query_id long, vector {vector}, lists array<int>")
    asked = asked.select("query", "query_id", "vector", F.explode("lists").alias("list"))
    load = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    plan = F.broadcast(sizes.join(load, "list"))  # a row for each of MOST_LISTS lists at most
    place = lambda key, n: F.pmod(F.xxhash64(key), n.cast("long")).cast("int")
    left = index.join(plan, "list").withColumn("chunk", place("rid", F.col("chunks"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("list", "chunk", "block", "rid", "vec_id", "code", "length", "fit", "along", "vector")
    right = asked.join(plan, "list").withColumn("block", place("query", F.col("blocks"))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("list", "chunk", "block", "query", "query_id", "vector")

    def search(_, found, ask):
        c, t = shared.value
        out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if found.num_rows and ask.num_rows:
            found, ask = found.combine_chunks(), ask.combine_chunks()
            centroid = c[found.column("list")[0].as_py()]
            rids, ids, own, q_ids = found.column("rid").to_numpy(), found.column("vec_id").to_numpy(), ask.column("query").to_numpy(), ask.column("query_id").to_numpy()
            raw, q_raw = table(found.column("vector").combine_chunks()), table(ask.column("vector").combine_chunks())
            norms = np.sqrt((raw * raw).sum(axis=1))
            codes = np.frombuffer(b"".join(found.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            scalars = [found.column(s).to_numpy() for s in ("length", "fit", "along")]
            for b in range(0, len(own), 256):
                value, error = estimate(unit(q_raw[b : b + 256]), codes, *scalars, centroid, t)
                low = value - error
                for r in range(len(value)):
                    q, other = q_raw[b + r], rids != own[b + r]
                    able = low[r][other]
                    floor = np.partition(able, len(able) - k)[len(able) - k] if len(able) > k else -np.inf
                    near = np.flatnonzero(other & (value[r] + error[r] >= floor))
                    score = (raw[near] @ q) / (norms[near] * np.sqrt(q @ q))
                    best = np.lexsort((ids[near], -score))[:k]
                    for column, values in zip(out, (np.full(len(best), own[b + r]), np.full(len(best), q_ids[b + r]), ids[near][best], score[best]), strict=True):
                        column.append(values)
        return pa.table([pa.array(np.concatenate(x)) for x in out], ["query", "query_id", "vec_id", "score"])

    keys = ["list", "chunk", "block"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest(spark, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector of ``embeddings``, against all of it."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
