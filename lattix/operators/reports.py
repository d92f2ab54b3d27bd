"""Tables of the reports: metrics, frequencies, overlaps, curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattix.functions import combos, junctions
from lattix.operators.calibration import finite


def regression_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(n, corr, mae, mse) over pairs in which both are finite; NaN of fewer than two, corr NaN without variance."""
    x, y = F.col(truth), F.col(guess)
    nan = F.lit(float("nan"))
    got = df.where(finite(x) & finite(y)).agg(
        F.count("*").alias("n"), F.corr(x, y).alias("corr"), F.avg(F.abs(x - y)).alias("mae"), F.avg((x - y) * (x - y)).alias("mse"),
        F.stddev_pop(x).alias("_x"), F.stddev_pop(y).alias("_y"))
    ok = F.col("n") >= 2
    return got.select("n", F.when(ok & (F.col("_x") > 0) & (F.col("_y") > 0), F.col("corr")).otherwise(nan).alias("corr"), *[F.when(ok, F.col(c)).otherwise(nan).alias(c) for c in ("mae", "mse")])


def masked_mse(df: DataFrame, truth: str, guess: str) -> DataFrame:
    ok = finite(F.col(truth)) & finite(F.col(guess))
    return df.agg(F.coalesce(F.avg(F.when(ok, F.pow(F.col(truth) - F.col(guess), 2))), F.lit(0.0)).alias("mse"))


def epoch_means(batches: DataFrame, *values: str) -> DataFrame:
    """Mean over batches of each epoch, every batch with the same weight."""
    return batches.groupBy("epoch").agg(*[F.avg(v).alias(v) for v in values])


def best_epoch(epochs: DataFrame, loss: str = "val_loss") -> DataFrame:
    """The first epoch of the least loss."""
    return epochs.agg(F.min(F.struct(F.col(loss).alias("loss"), F.col("epoch"))).alias("b")).select("b.epoch", F.col("b.loss").alias(loss))


def slot_frequencies(df: DataFrame, key: str = "combo_compact") -> DataFrame:
    """(slot, A, L, F, M): the share of keys with each letter in each slot; other letters count in no column."""
    total = df.agg(F.count("*").alias("n"))
    counts = df.select(F.posexplode(combos.letters(F.col(key))).alias("k", "letter")).groupBy((F.col("k") + 1).alias("slot")).pivot("letter", list(combos.ALPHABET)).count()
    return counts.crossJoin(F.broadcast(total)).select("slot", *[(F.coalesce(c, F.lit(0)) / F.col("n")).alias(c) for c in combos.ALPHABET])  # one row


def overlap_curve(a: DataFrame, b: DataFrame, most: int = 50, key: str = "combo_compact", rank: str = "rank") -> DataFrame:
    """(k, overlap): the share of the first k of both lists that is in both, k up to ``most`` or the shorter list."""
    first = lambda d, n: d.where(F.col(rank) <= most).groupBy(key).agg(F.min(rank).alias(n))
    met = first(a, "x").join(first(b, "y"), key).select(F.greatest("x", "y").alias("k")).groupBy("k").agg(F.count("*").alias("c"))
    size = a.agg(F.max(rank).alias("x")).crossJoin(b.agg(F.max(rank).alias("y"))).select(F.least(F.lit(most), "x", "y").cast("int").alias("n"))
    ks = size.where("n > 0").select(F.explode(F.sequence(F.lit(1), "n")).alias("k"))
    run = F.sum(F.coalesce("c", F.lit(0))).over(W.orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow))
    return ks.join(met, "k", "left").select("k", (run / F.col("k")).alias("overlap"))  # at most ``most`` rows


def rank_curve(df: DataFrame, n: int, score: str, key: str = "combo_compact") -> DataFrame:
    """(rank, score) of the n best."""
    head = df.orderBy(junctions.orderable(F.col(score)).desc_nulls_last(), key).limit(n)
    return head.withColumn("rank", F.row_number().over(W.orderBy(junctions.orderable(F.col(score)).desc_nulls_last(), key)))
