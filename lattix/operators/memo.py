"""The memo of scores: Parquet bucketed by key, read through and added to.

A memo is a folder; the rows lie in its ``buckets=N``, as files of Spark's bucketed tables, each sorted
by key with a Bloom filter of its keys. A read has the memo's rows where a join on the key wants
them, so that it moves only the rows that ask; and when few keys are asked for, the scan gets
them by name, and opens only their buckets and, of those, the row groups and pages that may hold
them. Appends write next to the memo and then move whole files in, under names that nobody else
uses: writers do not wait for each other, and one that fails leaves nothing that is read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA = "key string, seq_hash string, seq_len int, global_score double, junction_scores array<double>, meta string, created_at double"
BUCKETS = 64
#: Different keys, at most, that a lookup names to the scan.
FEW = 2000


def latest(memo: DataFrame) -> DataFrame:
    """One row for each key, the one made last; of one time that with the greatest hash."""
    w = W.partitionBy("key").orderBy(F.col("created_at").desc(), F.col("seq_hash").desc_nulls_last())
    return memo.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _folder(spark: SparkSession, path: str):
    """The file system of path, and path with its scheme."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def _bucketed(spark: SparkSession, folder: str, buckets: int) -> DataFrame:
    """The files of one folder as a table of the session's catalog, for Spark takes buckets from there alone."""
    name = f"memo_{hashlib.sha256(folder.encode()).hexdigest()[:24]}"
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({SCHEMA}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{folder}'")
    spark.catalog.refreshTable(name)
    return spark.table(name)


def rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the memo at path, also those that later ones stand for; none if there is no memo yet.

    A folder of plain Parquet files is read too; ``compact`` makes a memo of it.
    """
    fs, folder = _folder(spark, path)
    parts: list[DataFrame] = []
    if fs.exists(folder):
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder))
        sizes = [int(m[1]) for m in (re.fullmatch(r"buckets=(\d+)", n) for n in names) if m]
        parts = [_bucketed(spark, f"{folder.toString()}/buckets={n}", n) for n in sizes]
        if plain := [f"{folder.toString()}/{n}" for n in names if n.endswith(".parquet")]:
            parts.append(spark.read.schema(SCHEMA).parquet(*plain))
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """The memo at path, one row for each key, empty if there is none yet."""
    return latest(rows(spark, path))


def get(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The rows of a few keys; one bucket is opened for each."""
    return latest(rows(spark, path).where(F.col("key").isin(*keys)))


def lookup(asked: DataFrame, path: str, few: int = FEW) -> DataFrame:
    """The rows of the memo at path that may be of asked's keys, for ``marked`` and ``scored``.

    Up to ``few`` different keys come to the driver and go to the scan by name, so that it opens their
    buckets alone and sorts their rows alone; more of them meet the memo in its buckets. No more than
    ``spark.sql.parquet.pushdown.inFilterThreshold`` keys (100 in ``session.local``; Parquet nests a test
    in the other, so thousands overflow a task's stack) are looked up in the pages and Bloom filters.
    """
    have = rows(asked.sparkSession, path)
    keys = [r["key"] for r in asked.select("key").where("key is not null").distinct().limit(few + 1).collect()]
    return have.where(F.col("key").isin(keys)) if len(keys) <= few else have


def marked(rows: DataFrame, memo: DataFrame) -> DataFrame:
    """rows (with key) and the memo's scores, and teacher_cache_hit."""
    known = latest(memo).select("key", "global_score", "junction_scores", F.lit(True).alias("_hit"))
    return rows.join(known, "key", "left").withColumn("teacher_cache_hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def scored(rows: DataFrame, memo: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with scores: from the memo if it has them, else from ``score``, once for each key.

    score gets rows of distinct keys and adds global_score and junction_scores. The columns of
    rows go through it; nothing is put together by position. Rows without a key are scored as
    one more key.
    """
    split = marked(rows, memo)
    hits = split.where("teacher_cache_hit")
    misses = split.where("not teacher_cache_hit").drop("global_score", "junction_scores")
    new = score(misses.dropDuplicates(["key"])).select(F.col("key").alias("_key"), "global_score", "junction_scores")
    return hits.unionByName(misses.join(new, F.col("key").eqNullSafe(F.col("_key"))).drop("_key"))


def _put(new: DataFrame, path: str, buckets: int) -> None:
    """Writes rows as files of buckets, one a bucket, and moves them into the memo."""
    spark = new.sparkSession
    fs, folder = _folder(spark, path)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    name = f"memo_{uuid.uuid4().hex}"
    staging, to = f"{folder.toString()}/_staging-{name}", fs_path(f"{folder.toString()}/buckets={buckets}")
    try:
        made = new.select(*[F.col(f.name).cast(f.dataType) for f in spark.createDataFrame([], SCHEMA).schema]).repartition(buckets, "key")
        made.write.bucketBy(buckets, "key").sortBy("key").format("parquet").option("path", staging).option("parquet.bloom.filter.enabled#key", "true").saveAsTable(name)
        fs.mkdirs(to)
        for status in fs.listStatus(fs_path(staging)):
            file = status.getPath()
            if re.search(r"_\d{5}\.", file.getName()) and not fs.rename(file, fs_path(to, file.getName())):
                raise OSError(f"cannot move {file.toString()} into the memo")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        fs.delete(fs_path(staging), True)


def append(path: str, new: DataFrame, buckets: int = BUCKETS) -> None:
    """Adds rows that the memo does not have; a later row of a key wins when it is read.

    Several may append at once. A row that two of them bring lies there twice and is read once.
    """
    have = lookup(new, path).select("key", "created_at")
    _put(new.join(have, ["key", "created_at"], "left_anti"), path, buckets)


def compact(spark: SparkSession, path: str, to: str, buckets: int = BUCKETS) -> None:
    """Writes the latest rows of path to a new memo, one file a bucket."""
    fs, folder = _folder(spark, to)
    if fs.exists(folder):
        raise FileExistsError(to)
    _put(read(spark, path), to, buckets)
