"""Checkpoints of the network: a table of arrays, with the network's shape and vocabulary, in any folder that Spark reads."""

from __future__ import annotations

import json
from dataclasses import asdict
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lattix.functions import sequences
from lattix.operators.scorers import Scorer, network_scorer
from lattix.operators.training import Shape, Weights

SCHEMA = "name string, shape array<int>, values array<double>, about string"
ABOUT = "about"
#: Rows and values that a checkpoint may have; it is read whole by the driver.
MOST_ARRAYS, MOST_VALUES = 200, 100_000_000


def save(spark: SparkSession, path: str, weights: Weights, shape: Shape, **about: Any) -> None:
    rows: list[tuple] = [(n, list(a.shape), a.astype(float).ravel().tolist(), None) for n, a in weights.items()]
    rows.append((ABOUT, None, None, json.dumps({"shape": asdict(shape), "vocabulary": list(sequences.VOCABULARY), **about}, sort_keys=True)))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> tuple[Weights, Shape, dict[str, Any]]:
    """The arrays, the network's shape and what else was saved; an error if anything does not fit the shape or the vocabulary."""
    table: DataFrame = spark.read.schema(SCHEMA).parquet(path)
    if table.count() > MOST_ARRAYS or (table.selectExpr("sum(size(values)) AS n").first()["n"] or 0) > MOST_VALUES:
        raise ValueError(f"not a checkpoint of a network: {path}")
    rows = {r["name"]: r for r in table.collect()}
    if ABOUT not in rows or not rows[ABOUT]["about"]:
        raise ValueError(f"the checkpoint has no description: {path}")
    about = json.loads(rows.pop(ABOUT)["about"])
    if about.get("vocabulary") != list(sequences.VOCABULARY):
        raise ValueError(f"the checkpoint has another vocabulary: {path}")
    shape = Shape(**about.pop("shape"))
    wanted = shape.arrays()
    if set(rows) != set(wanted):
        raise ValueError(f"the checkpoint's arrays are not those of its shape: {sorted(set(rows) ^ set(wanted))}")
    for n, s in wanted.items():
        if tuple(rows[n]["shape"]) != s or len(rows[n]["values"]) != int(np.prod(s)):
            raise ValueError(f"{n} has the shape {rows[n]['shape']}, not {list(s)}")
    return {n: np.array(rows[n]["values"]).reshape(s) for n, s in wanted.items()}, shape, about


def saved_scorer(spark: SparkSession, path: str, batch: int = 64) -> Scorer:
    """Scores by a saved network; an executor gets its weights once."""
    return network_scorer(load(spark, path)[0], batch, spark)
