"""Sources: configuration, fragment and protein files, tables of earlier stages, run folders."""

from __future__ import annotations

from typing import Any

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.functions import sequences
from lattix.operators.library import require_columns

JUNCTION_COLUMNS = ", ".join(f"junction_{k:02d} double" for k in range(1, 11))
LIBRARY = ("parent string, slot int, dna_path string, aa_sequence string, aa_length int, orientation string, frame int, query_start int, query_end int, parent_start int, "
           "parent_end int, align_score double, adjusted_score double, stop_count int, x_fraction double, ambiguous boolean, warnings string")  # fmt: skip
CANDIDATES = ("parent string, slot int, rank int, dna_path string, orientation string, frame int, aa_length_trimmed int, parent_start int, parent_end int, query_start int, "
              "query_end int, align_score double, adjusted_score double, stop_count int, x_fraction double")  # fmt: skip
DISTILL = f"source_run_id string, seed int, combo_compact string, sequence_aa string, sequence_hash string, global_score double, junction_mean double, junction_min double, teacher_cache_hit boolean, {JUNCTION_COLUMNS}"
RERANKED = f"combo_compact string, sequence_aa string, sequence_hash string, global_score double, junction_mean double, junction_min double, {JUNCTION_COLUMNS}, student_rank_score double, teacher_cache_hit boolean"


def config(path: str, defaults: dict[str, Any] | None = None, given: dict[str, Any] | None = None) -> dict[str, Any]:
    """Values given come before those of the file, and those before defaults; a given None is none."""
    with open(path, encoding="utf-8") as f:
        own = yaml.safe_load(f) or {}
    return (defaults or {}) | own | {k: v for k, v in (given or {}).items() if v is not None}


def table(spark: SparkSession, path: str, schema: str, *required: str) -> DataFrame:
    """A stage's table with its declared schema: CSV if the path says so, else Parquet."""
    df = spark.read.schema(schema).csv(path, header=True) if path.endswith(".csv") else spark.read.schema(schema).parquet(path)
    return require_columns(df, *required)


def fragment_name(path: Column) -> Column:
    """struct<parent, slot> of a file name such as As_01.dna, any case; an error for other names."""
    name = F.element_at(F.split(path, "/"), -1)
    parts = lambda k: F.regexp_extract(name, r"(?i)^(As|Fn|Lb|Mb)_(\d{2})\.dna$", k)
    parent = F.initcap(F.lower(parts(1)))
    wrong = F.raise_error(F.concat(F.lit("not a fragment file: "), name)).cast("string")
    return F.struct(F.when(parts(1) == "", wrong).when(parent == "Mb", "Mb2").otherwise(parent).alias("parent"), parts(2).try_cast("int").alias("slot"))


def fragment_files(spark: SparkSession, folder: str) -> DataFrame:
    """(parent, slot, dna_path, dna) of the text of fragment files: the longest run of nucleotide letters of each."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dna").load(folder)
    text = F.upper(F.decode("content", "ISO-8859-1"))
    runs = F.regexp_extract_all(text, F.lit("[ACGTN]+"), F.lit(0))
    dna = F.element_at(F.array_sort(F.transform(runs, lambda x, i: F.struct(F.length(x), -i, x.alias("dna")))), -1)["dna"]
    return files.select(fragment_name(F.col("path")).alias("id"), F.col("path").alias("dna_path"), dna.alias("dna")).select("id.*", "dna_path", "dna")


def protein_files(spark: SparkSession, folder: str, least: int = 500) -> DataFrame:
    """(path, protein): the longest run of amino-acid letters of each *.prot file; an error if it is too short."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.prot").load(folder)
    run = sequences.longest_run(F.decode("content", "ISO-8859-1"), least)
    return files.select("path", F.coalesce(run, F.raise_error(F.concat(F.lit("no protein in "), F.col("path")))).alias("protein"))


def head(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows in an order that is said."""
    return df.orderBy(order).limit(n)


def latest_run(spark: SparkSession, folder: str, prefix: str, *needed: str) -> str:
    """The newest complete run folder, by name, that holds all files needed."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted((s.getPath().getName() for s in fs.listStatus(fs_path(folder)) if s.isDirectory()), reverse=True)
    for name in names:
        if name.startswith(prefix) and all(fs.exists(fs_path(f"{folder}/{name}/{x}")) for x in needed):
            return f"{folder}/{name}"
    raise FileNotFoundError(f"no complete {prefix}* in {folder}")
