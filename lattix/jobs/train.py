"""The student job: the recurrent network trained on a distillation set, with its history and checkpoints.

Batches are fixed by hashes of the keys and written apart, each in ``lanes`` files, so that a step
reads its own rows only, in as many tasks; their order changes from epoch to epoch. The tasks of a
step return the gradient of their rows in slices, each slice is summed in one task, and the driver,
which gets one gradient whatever the batch's size, moves the weights on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.functions import junctions, sequences
from lattix.operators import library, reports, sampling, scorers, training
from lattix.sources import weights as checkpoints
from lattix.sources import writers

SLICES = 16
STATS = ("ll", "tokens", "global_sum", "global_n", "junction_sum", "junction_n")
HISTORY = ("epoch", "train_loss", "train_nll", "train_global_mse", "train_junction_mse", "val_loss", "val_nll", "val_global_mse", "val_junction_mse",
           "global_corr", "global_mae", "global_mse", "junction_mean_corr", "junction_mean_mae", "junction_mean_mse")


@dataclass(frozen=True)
class Settings:
    seed: int = 13
    batch: int = 8
    epochs: int = 3
    rate: float = 1e-3
    decay: float = 1e-4
    clip: float = 1.0
    val_fraction: float = 0.2
    nll_weight: float = 1.0
    global_weight: float = 1.0
    junction_weight: float = 1.0
    lanes: int = 4

    def loss(self, nll: float, global_mse: float, junction_mse: float) -> float:
        return self.nll_weight * nll + self.global_weight * global_mse + self.junction_weight * junction_mse


def prepared(rows: DataFrame, fragments: DataFrame | None, settings: Settings, key: str = "combo_compact") -> DataFrame:
    """(key, sequence_aa, domain_lengths, teacher_global, teacher_junctions, is_val) of a distillation set.

    Slot lengths are those of the key's fragments; without fragments sequences are split evenly.
    """
    teacher = F.array(*[F.coalesce(F.col(f"junction_{k:02d}").cast("double"), F.lit(float("nan"))) for k in range(1, junctions.JUNCTIONS + 1)])
    own = rows.select(F.col(key).alias("key"), F.upper(F.trim("sequence_aa")).alias("sequence_aa"), F.coalesce(F.col("global_score").cast("double"), F.lit(float("nan"))).alias("teacher_global"), teacher.alias("teacher_junctions")).where(F.length("sequence_aa") > 0)
    if fragments is None:
        own = own.withColumn("domain_lengths", sequences.uniform_split(F.length("sequence_aa")))
    else:
        own = library.built(own.drop("sequence_aa"), fragments, "key")
    split = sampling.split(own, settings.val_fraction, settings.seed, "key")
    return split.select("key", "sequence_aa", "domain_lengths", "teacher_global", "teacher_junctions", "is_val")


def dealt(rows: DataFrame, path: str, settings: Settings) -> tuple[int, int]:
    """Writes prepared() rows in their batches; returns the numbers of training and validation batches."""
    sizes = {r["is_val"]: r["n"] for r in rows.groupBy("is_val").agg(F.count("*").alias("n")).collect()}
    n_train, n_val = (max(1, round(sizes.get(v, 0) / settings.batch)) for v in (False, True))
    rows = rows.withColumn("is_val", F.col("is_val").cast("int"))
    h = F.xxhash64(F.lit(settings.seed), "key")
    batch = F.pmod(h, F.when(F.col("is_val") == 1, n_val).otherwise(n_train)).cast("int")
    lane = F.pmod(F.xxhash64("key", F.lit(settings.seed)), F.lit(settings.lanes)).cast("int")
    out = rows.withColumn("batch", batch).withColumn("lane", lane)
    out.repartition("is_val", "batch", "lane").write.mode("overwrite").partitionBy("is_val", "batch", "lane").parquet(path)
    return n_train, n_val


def _errors(ll: list[np.ndarray], lengths: pa.Array, truth: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """STATS of scored rows against the teacher's."""
    each, means = scorers.summed(pa.array(ll, pa.list_(pa.float64())), lengths, junctions.LEFT, junctions.RIGHT)
    a, b = (each - truth) ** 2, (means - windows) ** 2
    return np.array([sum(x.sum() for x in ll), sum(map(len, ll)), np.nansum(a), np.isfinite(a).sum(), np.nansum(b), np.isfinite(b).sum()], float)


def step_gradient(rows: DataFrame, values: np.ndarray, shape: training.Shape, seed: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(gradient of the summed loss, STATS) of a batch's rows at flat weights; seed turns dropout on."""
    sc = rows.sparkSession.sparkContext
    sent = sc.broadcast(values.astype(np.float32))
    edges = np.linspace(0, shape.size, SLICES + 1).astype(int)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = training.unflat(sent.value, shape)
        total, stats = np.zeros(shape.size), np.zeros(len(STATS))
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [np.array(x, np.int64) for x in part.column("tokens").to_pylist()]
                seeds = [(h ^ seed) & 0x7FFFFFFFFFFFFFFF for h in part.column("h").to_pylist()] if seed is not None else None
                grad, ll = training.gradient(ids, weights, shape, seeds)
                total += training.flat(grad)
                truth = part.column("teacher_global").to_numpy(zero_copy_only=False)
                windows = np.array(part.column("teacher_junctions").to_pylist(), float).reshape(part.num_rows, -1)
                stats += _errors(ll, part.column("domain_lengths"), truth, windows)
        task = TaskContext.get().partitionId()
        slices = [stats, *(total[a:b] for a, b in zip(edges, edges[1:], strict=False))]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(slices)), pa.int32()), pa.array([task] * len(slices), pa.int32()), pa.array([x.tolist() for x in slices], pa.list_(pa.float64()))], ["slice", "task", "values"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("slice").to_pylist(), b.column("values"), strict=True):
                x = x.values.to_numpy()
                out[k] = out[k] + x if k in out else x.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([x.tolist() for x in out.values()], pa.list_(pa.float64()))], ["slice", "values"])

    asked = rows.select(scorers.tokens_of(F.col("sequence_aa")).alias("tokens"), "domain_lengths", "teacher_global", "teacher_junctions", F.xxhash64("key").alias("h"))
    each = asked.mapInArrow(parts, "slice int, task int, values array<double>")
    # in the order of the tasks, so that every run adds up to the same
    got = {r["slice"]: np.array(r["values"]) for r in each.repartition(SLICES + 1, "slice").sortWithinPartitions("slice", "task").mapInArrow(summed, "slice int, values array<double>").collect()}
    sent.destroy()
    return np.concatenate([got[k] for k in range(1, SLICES + 1)]), got[0]


def _means(stats: np.ndarray, settings: Settings) -> np.ndarray:
    """(loss, nll, global_mse, junction_mse) of a batch's STATS."""
    s = dict(zip(STATS, stats, strict=True))
    mse = [s[f"{k}_sum"] / s[f"{k}_n"] if s[f"{k}_n"] else 0.0 for k in ("global", "junction")]
    nll = -s["ll"] / s["tokens"]
    return np.array([settings.loss(nll, *mse), nll, *mse])


def validated(rows: DataFrame, weights: training.Weights, settings: Settings) -> dict[str, float]:
    """The val_* and regression columns of the history: the network's scores of dealt() rows against the teacher's."""
    got = scorers.summaries(scorers.network_scorer(weights, spark=rows.sparkSession)(rows)).persist()
    square = lambda x, y: F.when(~F.isnan(x) & ~F.isnan(y), (x - y) * (x - y))
    squares = F.filter(F.zip_with("junction_scores", "teacher_junctions", square), lambda v: v.isNotNull())
    n = F.length("sequence_aa")
    g = square(F.col("global_score"), F.col("teacher_global"))
    sums = got.select("batch", (F.col("global_score") * n).alias("ll"), n.alias("n"), g.alias("g"), F.aggregate(squares, F.lit(0.0), lambda a, x: a + x).alias("j"), F.size(squares).alias("jn"))
    batches = sums.groupBy("batch").agg((-F.sum("ll") / F.sum("n")).alias("nll"), F.coalesce(F.avg("g"), F.lit(0.0)).alias("global_mse"), F.coalesce(F.try_divide(F.sum("j"), F.sum("jn")), F.lit(0.0)).alias("junction_mse"))
    loss = settings.nll_weight * F.col("nll") + settings.global_weight * F.col("global_mse") + settings.junction_weight * F.col("junction_mse")
    names = ("loss", "nll", "global_mse", "junction_mse")
    means = reports.epoch_means(batches.withColumn("loss", loss).withColumn("epoch", F.lit(0)), *names).first()
    out = {f"val_{k}": means[k] for k in names}
    with_means = got.withColumn("teacher_mean", junctions.junction_mean(F.col("teacher_junctions")))
    for prefix, truth, guess in (("global", "teacher_global", "global_score"), ("junction_mean", "teacher_mean", "junction_mean")):
        r = reports.regression_metrics(with_means, truth, guess).first()
        out |= {f"{prefix}_{k}": r[k] for k in ("corr", "mae", "mse")}
    got.unpersist()
    return out


def train(spark: SparkSession, rows: DataFrame, folder: str, fragments: DataFrame | None = None, shape: training.Shape | None = None, settings: Settings | None = None, key: str = "combo_compact") -> DataFrame:
    """Trains the network on distillation rows; returns HISTORY, a row for each epoch.

    folder gets the batches, the checkpoints ``last`` and ``best`` (of the first epoch with the least
    validation loss), the history and a summary. Two rows are the least; rows without a sequence are left out.
    """
    shape, settings = shape or training.Shape(), settings or Settings()
    n_train, _ = dealt(prepared(rows, fragments, settings, key), f"{folder}/batches", settings)
    data = spark.read.parquet(f"{folder}/batches")
    val, own = data.where("is_val = 1"), data.where("is_val = 0")
    weights = training.flat(training.initial(shape, settings.seed))
    optimiser = training.Adam(settings.rate, settings.decay, settings.clip)
    history: list[tuple] = []
    least = np.inf
    for epoch in range(1, settings.epochs + 1):
        seen = []
        for b in np.random.default_rng((settings.seed, epoch)).permutation(n_train).tolist():
            grad, stats = step_gradient(own.where(F.col("batch") == b), weights, shape, hash((settings.seed, epoch, b)) & 0x7FFFFFFF)
            if not stats[1]:  # a batch that got no rows
                continue
            seen.append(_means(stats, settings))
            weights = optimiser.step(weights, settings.nll_weight * grad / stats[1])
        now = training.unflat(weights, shape)
        means = dict(zip(("train_loss", "train_nll", "train_global_mse", "train_junction_mse"), np.mean(seen, axis=0).tolist(), strict=True))
        row = {"epoch": epoch} | means | validated(val, now, settings)
        history.append(tuple(row[c] for c in HISTORY))
        checkpoints.save(spark, f"{folder}/last", now, shape, epoch=epoch)
        if row["val_loss"] < least:
            least = row["val_loss"]
            checkpoints.save(spark, f"{folder}/best", now, shape, epoch=epoch)
    table = spark.createDataFrame(history, ", ".join(f"{c} {'int' if c == 'epoch' else 'double'}" for c in HISTORY))
    writers.export_csv(table, f"{folder}/history", "epoch")
    best = reports.best_epoch(table).first()
    counts = {("n_val" if r["is_val"] else "n_train"): r["n"] for r in data.groupBy("is_val").agg(F.count("*").alias("n")).collect()}
    writers.metadata(spark, f"{folder}/summary", counts | {"best_epoch": best["epoch"], "best_val_loss": best["val_loss"], "shape": asdict(shape), "settings": asdict(settings), "final": dict(zip(HISTORY, history[-1], strict=True))})
    return table
