"""Scorers of sequences: what gives each residue a log-likelihood.

A scorer is a function from a DataFrame with sequence_aa and domain_lengths to one that also has
token_ll; summaries() turns that into the scores that ranking uses. Two are here: a bigram model
counted and applied by Spark, a stand-in for a trained language model, and the forward pass of a
gated recurrent network, with weights that sources.weights keeps and jobs.train makes.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.functions import junctions, sequences


class Scorer(Protocol):
    def __call__(self, df: DataFrame) -> DataFrame: ...


def summaries(df: DataFrame, left: int = junctions.LEFT, right: int = junctions.RIGHT) -> DataFrame:
    """df (token_ll, domain_lengths) with global_score, junction_scores, junction_mean, junction_min.

    The same as the column functions of junctions give, by running sums over Arrow batches.
    """

    @F.arrow_udf("struct<global_score:double,junction_scores:array<double>>")
    def run(ll: pa.Array, lengths: pa.Array) -> pa.Array:
        total, means = np.full(len(ll), np.nan), np.full((len(ll), junctions.JUNCTIONS), np.nan)
        for i in range(0, len(ll), 1024):
            total[i : i + 1024], means[i : i + 1024] = summed(ll.slice(i, 1024), lengths.slice(i, 1024), left, right)
        flat = pa.array(means.ravel())
        scores = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, junctions.JUNCTIONS, dtype=np.int32)), flat)
        return pa.StructArray.from_arrays([pa.array(total), scores], ["global_score", "junction_scores"])

    rows = df.withColumn("_s", run(F.col("token_ll"), F.col("domain_lengths"))).withColumn("global_score", F.col("_s.global_score")).withColumn("junction_scores", F.col("_s.junction_scores")).drop("_s")
    return rows.withColumn("junction_mean", junctions.junction_mean(F.col("junction_scores"))).withColumn("junction_min", junctions.junction_min(F.col("junction_scores")))


def summed(ll: pa.Array, lengths: pa.Array, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
    """Means of all scores, and window means, of a batch of rows."""
    sizes = pc.fill_null(pc.list_value_length(ll), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    parts = pc.fill_null(pc.list_value_length(lengths), 0).to_numpy(zero_copy_only=False)
    if (parts != junctions.JUNCTIONS + 1).any():
        raise ValueError("eleven lengths are needed")
    values = ll.flatten()
    row = np.repeat(np.arange(len(ll)), sizes)
    col = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # sums, counts and NaN counts before each place of each row
    known = np.asarray(values.is_valid())
    x = pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False)
    odd = known & np.isnan(x)
    before = []
    for v in (np.where(odd, 0.0, x), known.astype(float), odd.astype(float)):
        grid = np.zeros((len(ll), int(sizes.max(initial=0)) + 1))
        grid[row, col + 1] = v
        before.append(np.cumsum(grid, axis=1))
    each = np.arange(len(ll))[:, None]
    bounds = np.cumsum(lengths.flatten().to_numpy(zero_copy_only=False).reshape(len(ll), -1), axis=1)[:, :-1]
    low = np.maximum(bounds - left, 1)  # the first residue has no score
    high = np.minimum(bounds + right, sizes[:, None])
    low = np.minimum(low, sizes[:, None])
    high = np.maximum(high, low)
    total, count, nans = (b[each, high] - b[each, low] for b in before)
    with np.errstate(divide="ignore", invalid="ignore"):
        means = np.where(nans > 0, np.nan, total / count)
    whole, _, some = (b[np.arange(len(ll)), sizes] for b in before)
    return np.where(some > 0, np.nan, whole / np.maximum(sizes, 1)), means


def pairs(df: DataFrame, text: str = "sequence_aa") -> DataFrame:
    """(prev, cur) of each letter and the one before it, ^ at the start."""
    s = F.col(text)
    return df.where(F.length(s) > 0).select(F.explode(F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.struct(F.when(i == 1, "^").otherwise(F.substr(s, i - 1, F.lit(1))).alias("prev"), F.substr(s, i, F.lit(1)).alias("cur")))).alias("p")).select("p.*")


def bigram_fit(df: DataFrame, text: str = "sequence_aa", smoothing: float = 1.0) -> DataFrame:
    """(prev, cur, n, ll): counts of letter pairs and their smoothed log-likelihoods."""
    counts = pairs(df, text).groupBy("prev", "cur").agg(F.count("*").alias("n"))
    totals = counts.groupBy("prev").agg(F.sum("n").alias("total"))
    return counts.join(totals, "prev").select("prev", "cur", "n", F.log((F.col("n") + smoothing) / (F.col("total") + smoothing * len(sequences.VOCABULARY))).alias("ll"))


def bigram_scorer(model: DataFrame, most: int = 100_000, unseen: float = -8.0) -> Scorer:
    """Scores by a model of letter pairs, which travels with the function as a table; more than ``most`` pairs are an error."""
    rows = model.select("prev", "cur", "ll").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("the model has too many letter pairs")
    letters = sorted({c for r in rows for c in (r["prev"], r["cur"])} | {"^"})
    number = {c: k + 1 for k, c in enumerate(letters)}
    table = np.full((len(letters) + 1, len(letters) + 1), unseen)
    for r in rows:
        table[number[r["prev"]], number[r["cur"]]] = r["ll"]
    codes = np.zeros(max(map(ord, letters)) + 2, np.int64)  # the last place is for letters beyond
    codes[[ord(c) for c in letters]] = [number[c] for c in letters]
    start = number["^"]

    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        texts = [t or "" for t in column.to_pylist()]
        x = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        cur = codes[np.minimum(x, len(codes) - 1)]
        ends = np.cumsum([0, *map(len, texts)])
        prev = np.concatenate(([start], cur[:-1])) if len(cur) else cur
        first = ends[:-1][np.diff(ends) > 0]
        prev[first] = start
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(table[prev, cur]))

    return lambda df: df.withColumn("token_ll", run(F.col("sequence_aa")))


class Network:
    """Embedding, stacked gated recurrent units and a linear layer, run on padded batches by numpy."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w = weights
        self.layers = sum(k.startswith("gru.weight_ih_l") for k in weights)

    def log_likelihoods(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        """Of each sequence of vocabulary numbers, the log-likelihood of every one given those before."""
        longest = max(map(len, ids))
        x = np.zeros((len(ids), longest), np.int64)
        y = np.zeros_like(x)
        for k, s in enumerate(ids):
            x[k, : len(s)] = np.concatenate(([sequences.BOS], s[:-1]))
            y[k, : len(s)] = s
        h = self.w["embed.weight"][x]
        for layer in range(self.layers):
            h = self._layer(h, *(self.w[f"gru.{n}_l{layer}"] for n in ("weight_ih", "weight_hh", "bias_ih", "bias_hh")))
        logits = h @ self.w["lm_head.weight"].T + self.w["lm_head.bias"]
        logits -= logits.max(axis=2, keepdims=True)
        ll = np.take_along_axis(logits, y[:, :, None], axis=2)[:, :, 0] - np.log(np.exp(logits).sum(axis=2))
        return [ll[k, : len(s)].astype(float) for k, s in enumerate(ids)]

    @staticmethod
    def _layer(x: np.ndarray, wi: np.ndarray, wh: np.ndarray, bi: np.ndarray, bh: np.ndarray) -> np.ndarray:
        n = wh.shape[1]
        given = x @ wi.T + bi
        state, out = np.zeros((len(x), n)), np.empty((*x.shape[:2], n))
        sigmoid = lambda v: 1 / (1 + np.exp(-v))
        for t in range(x.shape[1]):
            own = state @ wh.T + bh
            r = sigmoid(given[:, t, :n] + own[:, :n])
            z = sigmoid(given[:, t, n : 2 * n] + own[:, n : 2 * n])
            new = np.tanh(given[:, t, 2 * n :] + r * own[:, 2 * n :])
            state = (1 - z) * new + z * state
            out[:, t] = state
        return out


def network_scorer(weights: dict[str, np.ndarray], batch: int = 64, spark: SparkSession | None = None) -> Scorer:
    """Scores by a network of fixed size, sequences in Arrow batches; its weights travel with the function, or with a session once to each executor."""
    sent = spark.sparkContext.broadcast(weights) if spark else None
    own = None if sent else weights

    def score(df: DataFrame) -> DataFrame:
        @F.arrow_udf("array<double>")
        def run(column: pa.Array) -> pa.Array:
            net = Network(sent.value if sent else own)
            ids = [np.array(x or [], dtype=np.int64) for x in column.to_pylist()]
            out: list[list[float] | np.ndarray] = [[] for _ in ids]
            order = [k for k in sorted(range(len(ids)), key=lambda k: len(ids[k])) if len(ids[k])]
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                for k, ll in zip(part, net.log_likelihoods([ids[k] for k in part]), strict=True):
                    out[k] = ll
            return pa.array(out, pa.list_(pa.float64()))

        return df.withColumn("token_ll", run(tokens_of(F.col("sequence_aa"))))

    return score


def tokens_of(text: Column) -> Column:
    return sequences.tokens(F.upper(F.trim(text)))
