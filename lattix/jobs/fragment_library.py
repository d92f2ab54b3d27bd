"""The library job: reads of fragments translated in all frames, aligned with their parent, and one choice for each slot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.functions import sequences
from lattix.operators import library
from lattix.sources import writers

KEEP, DELTA, OVERLAP, MOST_X = 5, 25.0, 5, 0.10
COLUMNS = ("parent", "slot", "aa_sequence", "aa_length", "orientation", "frame", "query_start", "query_end", "parent_start", "parent_end", "align_score", "adjusted_score", "stop_count", "x_fraction", "ambiguous", "warnings")


def chosen(candidates: DataFrame, keep: int = KEEP, delta: float = DELTA, overlap: int = OVERLAP, most_stops: int = 0, ordered: bool = True) -> DataFrame:
    """One of the candidates (parent, slot, gen_idx, adjusted_score, stop_count, parent_start, parent_end, ...) for each slot.

    Candidates with too many stops go if others are left. With ``ordered`` the choice is the best
    chain of each parent, else the best of each slot. Adds fell_back, and ambiguous: whether the
    two best of the slot are less than delta apart.
    """
    left = library.within_stops(candidates, most_stops)
    best = library.chain(left, keep, overlap) if ordered else library.best(left).drop("rank").withColumn("fell_back", F.lit(False))
    return best.join(library.ambiguous(left, delta).select("parent", "slot", "ambiguous"), ["parent", "slot"])


def warned(rows: DataFrame) -> DataFrame:
    """rows with the warnings of the choice."""
    return rows.withColumn("warnings", sequences.warnings(F.col("ambiguous"), F.col("stop_count"), F.col("x_fraction"), MOST_X))


def build(candidates: DataFrame, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(library, the best candidates of each slot, slots_increasing of each parent) from library.translated_candidates() rows."""
    aa = sequences.without_stops(F.col("aa_trimmed"))
    rows = warned(chosen(candidates, **how)).withColumn("aa_sequence", aa).withColumn("aa_length", F.length("aa_sequence"))
    top = library.top(library.within_stops(candidates, how.get("most_stops", 0)), how.get("keep", KEEP)).withColumn("aa_length", F.length(aa))
    return rows.select(*COLUMNS), top, library.slots_increasing(rows, how.get("overlap", OVERLAP))


def run(spark: SparkSession, fragments: DataFrame, parents: DataFrame, folder: str, **how) -> DataFrame:
    """The library of reads (parent, slot, dna) and proteins (parent, protein), with its audit tables, written to folder.

    Candidates are aligned once and written; the rest reads them. Returns the library as it was written.
    """
    library.translated_candidates(fragments, parents).write.mode("overwrite").parquet(f"{folder}/all_candidates")
    made, top, order = build(spark.read.parquet(f"{folder}/all_candidates"), **how)
    made.write.mode("overwrite").parquet(f"{folder}/library")
    out = spark.read.parquet(f"{folder}/library")
    writers.export_csv(out, f"{folder}/library_csv", "parent", "slot")
    writers.export_csv(top.select("parent", "slot", "rank", "orientation", "frame", "aa_length", "align_score", "adjusted_score", "stop_count", "x_fraction"), f"{folder}/candidates", "parent", "slot", "rank")
    writers.export_csv(order, f"{folder}/order", "parent")
    writers.library_json(out).coalesce(1).write.mode("overwrite").text(f"{folder}/library_json")
    return out
