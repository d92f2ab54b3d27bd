"""The corpus pipeline: quality, near-duplicates, decontamination, secrets, mixing.

Every stage takes (spark, docs, sf_dir), docs with the columns of ``documents``, and returns
such rows; the last adds the columns of the mix. Each is judged on all that its predecessor kept.
Null texts pass the stages as empty ones; an empty table gives an empty one; other columns stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lattix.llm import decontam, minhash, mixing, quality, secrets
from lattix.llm.common import checkpoint, shared_dir
from lattix.session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the smallest id."""
    return minhash.drop_near_duplicates(docs, width=5, threshold=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontam.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; n_chars follows."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus: all columns of each document, and its size, its source's target, the copies the mix holds and the words they take."""
    return mixing.with_mix(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("mixing sources", mixed),
]

#: Stages one, two and four have no SQL: they are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each result written as Parquet to the shared folder and read again; the folder goes at the end, or when a stage fails."""
    docs = _table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        for k, (_, stage) in enumerate(STAGES[:-1]):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
            docs = spark.read.parquet(f"{base}/{k}")
        return checkpoint(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(base)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
