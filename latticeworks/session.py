"""Session helpers shared by the jobs, the tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "latticeworks", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    parts = "8" if cpus == "*" else str(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new name below the checkpoint folder; a cluster names that in spark.checkpoint.dir, a local run gets its own."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-latticeworks-"))
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a Parquet table at ``path``, read back: the lineage is cut and a lost executor costs a re-read."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more, in whatever store it lies."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` by ``keys`` over all shuffle partitions, however few bytes they are, as the work of a group in Python is
    not told by its bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _differs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b) & ~(pd.isna(a) & pd.isna(b))


def by_group(rows: DataFrame, keys: list[str], solve: Callable[[pd.DataFrame], pd.DataFrame], schema: str, order: tuple = ()) -> DataFrame:
    """``solve`` of the rows of each key (a pandas frame, in ``order``), as ``groupBy(*keys).applyInPandas`` has it.

    Tasks read their groups one after the other from sorted batches, so small groups don't each pay for a way between
    Spark and Python; a task holds a batch and a group.
    """

    def whole(parts: list[pd.DataFrame]) -> pd.DataFrame:
        return solve(parts[0].reset_index(drop=True) if len(parts) == 1 else pd.concat(parts, ignore_index=True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            new = np.zeros(len(batch), bool)
            for k in keys:
                values = batch[k].to_numpy()
                new[1:] |= _differs(values[1:], values[:-1])
                new[0] |= bool(held) and bool(_differs(values[:1], held[-1][k].to_numpy()[-1:])[0])
            done, at = [], 0
            for cut in np.flatnonzero(new).tolist():
                held += [batch.iloc[at:cut]] if cut else []
                done.append(whole(held))
                held, at = [], cut
            held.append(batch.iloc[at:])
            if done := [d for d in done if len(d)]:
                yield pd.concat(done, ignore_index=True)
        if held and len(last := whole(held)):
            yield last

    return dealt(rows, keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may lie in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
