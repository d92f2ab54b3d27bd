"""Calibration: a weighted logistic regression of active against background designs, and its use."""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattix.sources import writers

FEATURES = ("global_score", "junction_mean", "junction_min")
C, BACKGROUND_WEIGHT, QUANTILE = 1.0, 0.2, 0.1
#: Buckets in which values are counted for a quantile.
BUCKETS = 4096


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def labelled(active: DataFrame, background: DataFrame) -> DataFrame:
    """Rows of both by column name, label 1 and 0."""
    return active.withColumn("label", F.lit(1)).unionByName(background.withColumn("label", F.lit(0)), allowMissingColumns=True)


def background_only(background: DataFrame, active: DataFrame, key: str = "combo_compact") -> DataFrame:
    """Background rows whose key no active row has; rows without a key stay."""
    return background.join(active.select(key), key, "left_anti")


def downsampled(df: DataFrame, n: int, seed: int = 0, key: str = "combo_compact") -> DataFrame:
    """n rows of df, the first by a hash of key and seed; all of them if n is 0 or less."""
    return df if n <= 0 else df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def s_min(column: str = "junction_min", q: float = QUANTILE) -> Column:
    """The exact quantile of the finite values; NaN if there are none."""
    return F.coalesce(F.percentile(F.when(finite(F.col(column)), F.col(column)), min(1.0, max(0.0, q))), F.lit(float("nan")))


def s_min_grouped(df: DataFrame, *keys: str, column: str = "junction_min", q: float = QUANTILE) -> DataFrame:
    """(keys, s_min): the same quantile of each group by counts, so that no task holds a group's values.

    Values are counted before they move, and the two in whose ranks the quantile falls are read
    from running counts of buckets, then of the values in the buckets that hold them.
    """
    x = F.col(column)
    rows = df.where(finite(x)).select(*keys, x.alias("_x"))
    span = rows.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count("*").alias("_n"))
    rank = F.lit(min(1.0, max(0.0, q))) * (F.col("_n") - 1)
    span = span.withColumn("_a", F.floor(rank)).withColumn("_b", F.ceil(rank)).withColumn("_w", rank - F.floor(rank))
    on = list(keys) or None
    join = lambda a, b: a.join(b, on) if on else a.crossJoin(F.broadcast(b))  # noqa: E731  a single row without keys
    bucket = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BUCKETS), F.lit(BUCKETS - 1))).otherwise(F.lit(0)).cast("int")
    placed = join(rows, span).withColumn("_k", bucket)
    counts = placed.groupBy(*keys, "_k", "_a", "_b").agg(F.count("*").alias("_c"))
    upto = W.partitionBy(*keys).orderBy("_k")
    holding = counts.withColumn("_before", F.sum("_c").over(upto) - F.col("_c")).where("(_before <= _a and _a < _before + _c) or (_before <= _b and _b < _before + _c)").select(*keys, "_k", "_before")
    values = placed.groupBy(*keys, "_k", "_x", "_a", "_b", "_w").agg(F.count("*").alias("_c")).join(holding, [*keys, "_k"])
    end = F.col("_before") + F.sum("_c").over(W.partitionBy(*keys, "_k").orderBy("_x"))
    ranked = values.withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("_c"))
    at = lambda c: F.max(F.when((F.col("_start") <= F.col(c)) & (F.col(c) < F.col("_end")), F.col("_x")))
    found = ranked.groupBy(*keys).agg(at("_a").alias("_va"), at("_b").alias("_vb"), F.max("_w").alias("_w"))
    return found.select(*keys, (F.col("_va") + (F.col("_vb") - F.col("_va")) * F.col("_w")).alias("s_min"))


def feature_means(df: DataFrame, *keys: str) -> DataFrame:
    """Means of the features, NaN left out."""
    return df.groupBy(*(keys or ("label",))).agg(*[F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in FEATURES], F.count("*").alias("n"))


def fit(active: DataFrame, background: DataFrame, weight: float = BACKGROUND_WEIGHT, q: float = QUANTILE, c: float = C) -> dict:
    """{features, coefficients, intercept, s_min_threshold, train_summary} on the features as they come.

    Features are scaled by their mean and population deviation, which the coefficients then take
    in; the penalty is that of C with summed losses, so it is divided by the weights' sum.
    """
    both = labelled(active.select(*FEATURES), background.select(*FEATURES)).withColumn("weight", F.when(F.col("label") == 1, 1.0).otherwise(weight))
    stats = both.agg(*[f(x).alias(f"{n}_{x}") for x in FEATURES for n, f in (("m", F.avg), ("s", F.stddev_pop))], F.sum("weight").alias("w"), F.sum("label").alias("n1"), F.count("*").alias("n")).first()
    if not stats["n1"] or stats["n1"] == stats["n"]:
        raise ValueError("both active and background rows are needed")
    low = next((r["s_min"] for r in s_min_grouped(active, q=q).collect()), None)  # one row
    low = float("nan") if low is None else low
    means = [stats[f"m_{x}"] for x in FEATURES]
    scales = [stats[f"s_{x}"] or 1.0 for x in FEATURES]
    scaled = both.select("label", "weight", *[((F.col(x) - m) / s).alias(x) for x, m, s in zip(FEATURES, means, scales, strict=True)])
    model = LogisticRegression(weightCol="weight", standardization=False, elasticNetParam=0.0, regParam=1.0 / (c * stats["w"]), tol=1e-12, maxIter=2000).fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(scaled))
    w = [float(v) / s for v, s in zip(model.coefficients, scales, strict=True)]
    return {
        "features": list(FEATURES), "coefficients": w, "intercept": float(model.intercept) - sum(v * m for v, m in zip(w, means, strict=True)), "s_min_threshold": low,
        "train_summary": {"active": stats["n1"], "background": stats["n"] - stats["n1"]},
    }


def save(spark: SparkSession, artifact: dict[str, Any], path: str) -> None:
    """The artifact as JSON; a threshold that is no number is null there."""
    writers.metadata(spark, path, artifact)


def load(spark: SparkSession, path: str) -> dict[str, Any]:
    """An artifact as it was saved; an error if it lacks something that apply() needs."""
    artifact = json.loads("".join(r["value"] for r in spark.read.text(path).collect()))  # one line
    missing = {"features", "coefficients", "intercept", "s_min_threshold"} - set(artifact)
    if missing:
        raise ValueError(f"not a calibration: {', '.join(sorted(missing))} missing")
    if artifact["s_min_threshold"] is None:
        artifact["s_min_threshold"] = float("nan")
    return artifact


def passes(value: Column, threshold: float) -> Column:
    """value >= threshold; true if there is no threshold, false for NaN."""
    return F.coalesce((value >= threshold) & ~F.isnan(value), F.lit(False)) if math.isfinite(threshold) else F.lit(True)


def apply(df: DataFrame, artifact: dict) -> DataFrame:
    """df with calibrated_prob, calibrated_score (the same) and passes_s_min: one expression, no model object."""
    z = F.lit(float(artifact["intercept"]))
    for name, w in zip(artifact["features"], artifact["coefficients"], strict=True):
        z = z + F.lit(float(w)) * F.col(name)
    return df.withColumn("calibrated_prob", 1 / (1 + F.exp(-z))).withColumn("calibrated_score", F.col("calibrated_prob")).withColumn("passes_s_min", passes(F.col("junction_min"), artifact["s_min_threshold"]))
