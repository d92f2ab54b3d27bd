"""The distillation set: designs scored by the dear scorer, for training a cheap one on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.functions import junctions, sequences
from lattix.jobs.rank import rescored
from lattix.operators import library
from lattix.operators.scorers import Scorer

COLUMNS = ("source_run_id", "seed", "combo_compact", "sequence_aa", "sequence_hash", "global_score", "junction_mean", "junction_min", "teacher_cache_hit")


def distill(sample: DataFrame, active: DataFrame | None, fragments: DataFrame, scorer: Scorer, known: DataFrame | str | None = None, model: str = "", run_id: str = "", seed: int = 0) -> DataFrame:
    """A row for each different design of the sample and the active ones (combo_compact), scored through the memo ``known``, its rows or its path.

    Has COLUMNS and the scores of the junctions, and a key for the memo if there is one.
    """
    designs = sample.select("combo_compact")
    if active is not None:
        designs = designs.union(active.select("combo_compact"))
    got = rescored(designs.distinct(), fragments, scorer, known, model)
    rows = got.withColumn("sequence_hash", sequences.sha256(F.col("sequence_aa"))).withColumn("source_run_id", F.lit(run_id)).withColumn("seed", F.lit(seed).cast("long"))
    return rows.select(*COLUMNS, *junctions.flat(F.col("junction_scores")))


def reconstructed(active: DataFrame, fragments: DataFrame, slots: list[str] | None = None) -> DataFrame:
    """Rows of a results table with a letter in all slots, with their key, sequence, its hash and fragment lengths."""
    rows = library.built(library.with_combo(library.active_rows(active, slots), slots), fragments)
    return rows.withColumn("sequence_hash", sequences.sha256(F.col("sequence_aa")))
