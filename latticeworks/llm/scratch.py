"""Intermediate tables in the folder that driver and executors share.

``materialize`` writes a DataFrame as Parquet below ``spark.checkpoint.dir`` and reads it back: lineage is cut, a lost
executor costs a re-read, and later stages prune columns. The folder is read from the session; only where the setting
is absent (tests, local runs) a folder of this driver is chosen.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_MADE: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a local folder for a local master, else an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="spark-latticeworks-")
    return _LOCAL["dir"]


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and return it as a table scan; ``zstd`` is for whole texts.

    Shuffle files of the write go when it ends: the table stands for them from then on.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/latticeworks-{uuid.uuid4().hex}"
    path = f"{folder}/{name}"
    _MADE.append(folder)
    schema = df.schema
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files behind a table that ``materialize`` returned and nothing reads any more."""
    _delete(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


def mark() -> int:
    """A point in time for ``drop_since``."""
    return len(_MADE)


def drop_since(spark: SparkSession, point: int, *kept: DataFrame) -> None:
    """Delete the tables made since ``mark`` but those of ``kept``, once nothing else reads them any more."""
    stay = {f.rstrip("/").rsplit("/", 1)[1] for k in kept for f in (x.rsplit("/", 2)[0] for x in k.inputFiles())}
    old = [f for f in _MADE[point:] if f.rsplit("/", 1)[1] not in stay]
    _delete(spark, set(old))
    _MADE[point:] = [f for f in _MADE[point:] if f not in old]


def clear(spark: SparkSession) -> None:
    """Delete every table of this driver; call it once results that read them are written."""
    _delete(spark, set(_MADE))
    _MADE.clear()


def _delete(spark: SparkSession, folders: set[str]) -> None:
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)
