"""Sinks: tables, single-file exports, run metadata, and stages that are skipped if they are done."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def export_csv(df: DataFrame, path: str, *order: str) -> None:
    """One CSV file for readers outside of Spark; for reports, not for stages."""
    (df.orderBy(*order) if order else df).coalesce(1).write.mode("overwrite").csv(path, header=True)


def library_json(library: DataFrame) -> DataFrame:
    """(json) of {parent_slot: sequence without stops}, by parent and slot."""
    key = F.concat("parent", F.lit("_"), F.lpad(F.col("slot").cast("string"), 2, "0"))
    entry: Column = F.struct(key.alias("key"), F.replace("aa_sequence", F.lit("*"), F.lit("")).alias("value"))
    return library.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("json"))


def _plain(x: Any) -> Any:
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, list | tuple):
        return [_plain(v) for v in x]
    return None if isinstance(x, float) and not math.isfinite(x) else x


def metadata(spark: SparkSession, path: str, values: dict[str, Any]) -> None:
    """Run metadata as one JSON file; numbers that JSON lacks are null."""
    text = json.dumps(_plain(values), sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def fingerprint(parameters: dict[str, Any]) -> str:
    return hashlib.sha256(json.dumps(_plain(parameters), sort_keys=True, default=str).encode()).hexdigest()[:16]


def stage(spark: SparkSession, folder: str, name: str, parameters: dict[str, Any], make: Callable[[], DataFrame]) -> DataFrame:
    """A stage's table, made only if no finished one with the same parameters is there."""
    path = f"{folder}/{name}-{fingerprint(parameters)}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    if not fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path(f"{path}/_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
