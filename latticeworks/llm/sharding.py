"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Each block of rows draws how many of its rows go to each shard (a multivariate hypergeometric row of the matrix, so
that column sums are the shard sizes), permutes itself, deals its rows out by those counts, and each shard is permuted
again. Only counts reach the driver: one per block, and at most ``MAX_BLOCKS`` blocks.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import materialize

#: Rows of the matrix at most; partitions beyond share blocks.
MAX_BLOCKS = 4096
#: Rows of a shard that one task permutes.
BUCKET_ROWS = 200_000


#: Rows from which on numpy's own sampler no longer serves.
LIBRARY_ROWS = 1_000_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many good ones ``draws`` draws without replacement hold.

    Below ``LIBRARY_ROWS`` numpy draws. Beyond, probabilities are taken relative to one another, never as differences of
    large logarithms: by their recurrence from 0 up where few are expected, else by ratio of uniforms around the mode with
    :func:`_log_ratio`, whose error stays below 1e-7 up to 10**13 rows.
    """
    total = good + bad
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    if total < LIBRARY_ROWS:
        return int(rng.hypergeometric(good, bad, draws))
    if 2 * draws > total:  # what is left behind is the smaller sample
        return good - hypergeometric(rng, good, bad, total - draws)
    if good > bad:
        return draws - hypergeometric(rng, bad, good, draws)
    most, mean = min(good, draws), draws * good / total
    if most < 64 or mean < 50:
        p = math.exp(_log_gamma_step(total - good - draws + 1, most) - _log_gamma_step(total - most + 1, most))
        u, k, acc = rng.random(), 0, p
        while u > acc and k < most:
            p *= (good - k) / (k + 1) * ((draws - k) / (bad - draws + k + 1))
            k += 1
            acc += p
        return k
    spread = math.sqrt(mean * (bad / total) * ((total - draws) / (total - 1)) + 0.5)
    mode = min(most, (draws + 1) * (good + 1) // (total + 2))
    wide = 2.6 * spread + 2.0
    while True:
        u, v = 1.0 - rng.random(), rng.random() - 0.5
        k = mode + math.floor(wide * v / u + 0.5)
        if 0 <= k <= most and 2 * math.log(u) <= _log_ratio(k, mode, good, bad, draws):
            return k


def _log_gamma_step(a: int, m: int) -> float:
    """log(gamma(a + m) / gamma(a)), by the series of the difference where both are large."""
    if min(a, a + m) < 64:
        return math.lgamma(a + m) - math.lgamma(a)
    tail = (1 / (a + m) - 1 / a) / 12 - (1 / (a + m) ** 3 - 1 / a**3) / 360
    return (a - 0.5) * math.log1p(m / a) + m * math.log(a + m) - m + tail


def _log_ratio(k: int, mode: int, good: int, bad: int, draws: int) -> float:
    """The logarithm of the probability of k over that of ``mode``."""
    m = k - mode
    up = _log_gamma_step(mode + 1, m) + _log_gamma_step(bad - draws + mode + 1, m)
    return -(up + _log_gamma_step(good - mode + 1, -m) + _log_gamma_step(draws - mode + 1, -m))


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Rows to go from each block to each shard: row sums are ``blocks``, column sums ``shards``, law exact."""
    rng, left, out = np.random.default_rng(seed), [int(x) for x in shards], []
    for rows in blocks:
        row, need, pool = [], int(rows), sum(left)
        for j, room in enumerate(left):
            pool -= room
            take = hypergeometric(rng, room, pool, need)
            row.append(take)
            left[j] -= take
            need -= take
        out.append(row)
    return np.array(out, dtype=np.int64).reshape(len(blocks), len(shards))


def hypergeometric_shards(df: DataFrame, n_shards: int, seed: int = 20240611) -> DataFrame:
    """Every row of ``df`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in its shard).

    Shard sizes differ by one at most and every arrangement is equally likely, up to the 64-bit hash of (row, seed)
    that stands for a random number. Input columns called shard or slot are replaced; nulls, repeated rows and clashing
    names elsewhere do not matter, as rows travel as one struct. An empty input gives an empty result. The rows are
    written once to the shared folder, so a recomputed task sees the same blocks.
    """
    spark = df.sparkSession
    keep = [c for c in df.columns if c not in ("shard", "slot")]
    part, rid = F.spark_partition_id(), F.monotonically_increasing_id()
    rows = materialize(df.select(F.struct(*[df[c] for c in keep]).alias("row") if keep else F.lit(None).cast("int").alias("row"), F.pmod(part, F.lit(MAX_BLOCKS)).alias("block"), rid.alias("rid")), "shard_rows")
    counts = sorted((r["block"], r["count"]) for r in rows.groupBy("block").count().collect())  # MAX_BLOCKS rows at most
    total = sum(n for _, n in counts)
    sizes = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    bounds = np.cumsum(communication_matrix([n for _, n in counts], sizes, seed), axis=1) if counts else np.zeros((0, n_shards), np.int64)
    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("bounds", T.ArrayType(T.LongType()))])
    matrix = spark.createDataFrame([(b, row.tolist()) for (b, _), row in zip(counts, bounds, strict=True)], schema)
    first = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), F.col("rid")), "rid")
    dealt = rows.withColumn("at", F.row_number().over(first) - 1).join(F.broadcast(matrix), "block").withColumn("shard", F.size(F.filter("bounds", lambda b: b <= F.col("at"))))
    n_buckets = max(1, -(-max(sizes) // BUCKET_ROWS)) if total else 1
    draw = F.xxhash64(F.lit(seed + 1), F.col("rid"))
    dealt = materialize(dealt.select("row", "rid", "shard", draw.alias("draw"), F.pmod(F.shiftrightunsigned(draw, 20), F.lit(n_buckets)).cast("int").alias("bucket")), "shard_dealt")
    within = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "bucket").count().withColumn("start", F.coalesce(F.sum("count").over(within), F.lit(0))).drop("count")
    again = Window.partitionBy("shard", "bucket").orderBy("draw", "rid")
    out = dealt.withColumn("at", F.row_number().over(again) - 1).join(starts, ["shard", "bucket"])
    return out.select(*([F.col("row")[c].alias(c) for c in keep]), F.col("shard"), (F.col("start") + F.col("at")).alias("slot"))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in 40 shards under the law ``rows``; null text counts as no bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    dealt = hypergeometric_shards(docs, 40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
