"""The driver's tables in the roles that the operators expect, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: Density above which a cell is foreground.
CONTOUR = 10.0
DAY_ZERO = "2024-01-01"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as grid cells: z day, y user, x hour, kind, density (sum of values), one row per cell."""
    e = table(spark, sf_dir, "events")
    place = e.select(F.datediff("ts", F.lit(DAY_ZERO)).alias("z"), F.col("user_id").cast("int").alias("y"), F.hour("ts").alias("x"), F.col("event_type").alias("kind"), "value")
    return place.groupBy("z", "y", "x", "kind").agg(F.sum("value").alias("density"))


CELLS = f"cells AS (SELECT CAST(date_diff('day', DATE '{DAY_ZERO}', CAST(ts AS DATE)) AS INT) AS z, CAST(user_id AS INT) AS y, CAST(hour(ts) AS INT) AS x, event_type AS kind, sum(value) AS density FROM events GROUP BY 1, 2, 3, 4)"


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as points: id, label, x, y, z (the first three components times 50)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", *[(F.element_at("embedding", k + 1).cast("double") * 50).alias(a) for k, a in enumerate("xyz")])


CLOUD = "cloud AS (SELECT vec_id AS id, label, CAST(embedding[1] AS DOUBLE) * 50 AS x, CAST(embedding[2] AS DOUBLE) * 50 AS y, CAST(embedding[3] AS DOUBLE) * 50 AS z FROM embeddings)"


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as scored pairs: chain (mode of shipping day), i, j in 0..59, the mean score of each."""
    l = table(spark, sf_dir, "lineitem")
    keyed = l.select((F.col("l_orderkey") % 40).cast("int").alias("chain"), (F.col("l_partkey") % 60).cast("int").alias("a"), (F.col("l_suppkey") % 60).cast("int").alias("b"), "l_discount")
    ends = keyed.where("a <> b").groupBy("chain", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))
    return ends.agg(F.round(F.avg("l_discount") * 10, 6).alias("prob"))


PAIRS = "scored AS (SELECT CAST(l_orderkey % 40 AS INT) AS chain, CAST(least(l_partkey % 60, l_suppkey % 60) AS INT) AS i, CAST(greatest(l_partkey % 60, l_suppkey % 60) AS INT) AS j, round(avg(l_discount) * 10, 6) AS prob FROM lineitem WHERE l_partkey % 60 <> l_suppkey % 60 GROUP BY 1, 2, 3)"


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cloud as chains: chain (label), residue_num (rank of the id, from 1), id, x, y, z, base."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("label").orderBy("id"))
    letters = F.array(*[F.lit(b) for b in "ACGU"])
    return cloud(spark, sf_dir).select(F.col("label").alias("chain"), rank.alias("residue_num"), "id", "x", "y", "z", F.element_at(letters, (F.col("id") % 4 + 1).cast("int")).alias("base"))


CHAINS = CLOUD + ", chains AS (SELECT label AS chain, CAST(row_number() OVER (PARTITION BY label ORDER BY id) AS INT) AS residue_num, id, x, y, z, substring('ACGU', CAST(id % 4 + 1 AS INT), 1) AS base FROM cloud)"
