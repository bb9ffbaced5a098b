"""A corpus from raw documents to packed sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions

from latticeworks.llm import decontamination, neardup, packing, pii, toxicity
from latticeworks.llm.scratch import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from labels of ``docs``, does not call toxic."""
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, lexicon)


def _numbered(docs: DataFrame, *order) -> tuple[DataFrame, str]:
    """The rows with a number each, in ``order`` if given, as a table that later reads agree on; the number's column."""
    name = "row_number"
    while name in docs.columns:
        name += "_"
    return materialize((docs.orderBy(*order) if order else docs).withColumn(name, functions.monotonically_increasing_id()), "numbered", "zstd"), name


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at five-word similarity 0.8, the one with the smallest doc_id."""
    rows, number = _numbered(docs, functions.col("doc_id").asc_nulls_last(), functions.xxhash64("text"))
    groups = neardup.near_duplicates(rows.select(functions.col(number).alias("doc_id"), "text"), percent=80)
    kept = groups.where("kept").select(groups["doc_id"].alias(number))
    return rows.join(kept, number, "left_semi").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item, or a whole shorter one."""
    rows, number = _numbered(docs)
    found = decontamination.contamination(rows.select(functions.col(number).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.where("contaminated").select(found["doc_id"].alias(number))
    return rows.join(hit, number, "left_anti").select(docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text if it is a column."""
    clean = pii.redact(docs)
    if "n_chars" in clean.columns:
        clean = clean.withColumn("n_chars", functions.when(functions.col("text").isNull(), functions.col("n_chars")).otherwise(functions.length("text").cast(docs.schema["n_chars"].dataType)))
    return clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("packing", pack),
]

#: Learned scores and token ids have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
