"""The calibration job: scores what lacks features, fits on active and background designs, saves, reads back, applies."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.jobs.rank import rescored
from lattix.operators import calibration
from lattix.operators.scorers import Scorer
from lattix.sources import writers

BACKGROUND = 300


def with_features(rows: DataFrame, fragments: DataFrame, scorer: Scorer) -> DataFrame:
    """rows as they are if they have the features, else scored by their keys."""
    if set(calibration.FEATURES) <= set(rows.columns):
        return rows
    return rescored(rows, fragments, scorer).drop("domain_lengths", "junction_scores", "teacher_cache_hit")


def calibrate(spark: SparkSession, active: DataFrame, background: DataFrame, fragments: DataFrame, scorer: Scorer, folder: str, size: int = BACKGROUND, seed: int = 13, run_id: str = "", **how: float) -> tuple[dict[str, Any], DataFrame]:
    """(artifact, all rows with label and calibrated scores) of active and background designs (combo_compact, perhaps features).

    Designs that are active are taken out of the background, of which ``size`` rows are used
    (all if it is 0). The artifact, the scored rows and a report are written to folder; what is
    applied is the artifact as it is read back.
    """
    def stage(name: str, rows: DataFrame) -> DataFrame:
        """Scored once: the fit passes over the features many times."""
        with_features(rows, fragments, scorer).select("combo_compact", *calibration.FEATURES).write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    own = stage("active", active)
    other = stage("background", calibration.downsampled(calibration.background_only(background, active), size, seed))
    calibration.save(spark, calibration.fit(own, other, **how), f"{folder}/artifact")
    artifact = calibration.load(spark, f"{folder}/artifact")
    both = calibration.apply(calibration.labelled(own, other), artifact)
    writers.export_csv(both, f"{folder}/scored", "combo_compact")
    means = {r["label"]: r["p"] for r in both.groupBy("label").agg(F.avg("calibrated_prob").alias("p")).collect()}
    writers.metadata(spark, f"{folder}/report", {"run_id": run_id, "active": artifact["train_summary"]["active"], "background": artifact["train_summary"]["background"], "active_mean": means.get(1), "background_mean": means.get(0)})
    return artifact, both
