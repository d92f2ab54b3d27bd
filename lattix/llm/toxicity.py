"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is folded to lower case with everything but letters as spaces, and its n-grams of
``ORDERS`` characters are hashed to ``2 ** BITS`` features, present or absent. Feature f gets
the ratio ``r = log((p + a) / (P + 2a)) - log((q + a) / (Q + 2a))`` of the labelled texts with
and without the label that hold it, and a logistic regression with L2 penalty weighs the
scaled features. Features whose ratio is not clear (``|r| * sqrt(texts)``) get no weight.

The classifier is fitted to at most ``sample`` labelled texts, the first by a digest of the id,
half of them of each label if there are enough, with ``most`` features together and weights for
the ``keep`` clearest; these bounds, not the corpus, size the fit. The
weights are one array of fixed size and travel with the scoring function over all texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattix.llm.common import checkpoint, crc_bucket

ORDERS = (3, 4, 5, 6)
BITS = 20
SAMPLE = 8000
MOST_FEATURES = 80_000_000
KEEP = 40_000
THRESHOLD = 0.3
BATCH_CHARS = 1 << 19
#: Parts of the features that are counted apart.
SLICES = 64
_M = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0x2545F491)]
_ASCII_GAP = np.array([not (97 <= c < 123) for c in range(128)])


def folded(text: str | None) -> np.ndarray:
    """Code points of the text in lower case, spaces for what isn't a letter, and a space at either end."""
    x = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where((x < 128) & _ASCII_GAP[np.minimum(x, 127)], np.uint32(32), x)


def grams(x: np.ndarray, order: int) -> np.ndarray:
    """Feature numbers of the n-grams at each position."""
    n = len(x) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    h = x[:n] * _M[0]
    for k in range(1, order):
        h = (h ^ (h >> np.uint32(15))) * _M[k] + x[k : n + k]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * order)
    return (h ^ (h >> np.uint32(13))) >> np.uint32(32 - BITS)


def features(text: str | None) -> np.ndarray:
    x = folded(text)
    return np.unique(np.concatenate([grams(x, n) for n in ORDERS]))


def ratios(p: np.ndarray, q: np.ndarray, P: float, Q: float) -> np.ndarray:
    """r of features that p of P texts with the label and q of Q texts without it hold."""
    return np.log((p + 1) / (P + 2)) - np.log((q + 1) / (Q + 2))


def train(own: list[np.ndarray], y: np.ndarray, r: np.ndarray, penalty: float = 1e-3, steps: int = 150) -> tuple[np.ndarray, float]:
    """(weight of each chosen feature, the bias) from the numbers of those that each text holds, labels 0 and 1, and ratios."""
    P, Q = float((y == 1).sum()), float((y == 0).sum())
    if not P or not Q:
        return np.zeros(len(r)), float(np.log((P + 1) / (Q + 1)))
    doc = np.repeat(np.arange(len(own), dtype=np.int32), [len(k) for k in own])
    f = np.concatenate(own)
    scale = r / np.sqrt((r**2).mean() if len(r) else 1.0)
    x = scale[f]
    theta, b = np.zeros(len(r)), np.log(P / Q)
    m = v = np.zeros(len(r) + 1)
    even = np.where(y == 1, 2.0, 1.0) / len(own)  # a missed toxic text is worse than a false alarm
    for step in range(1, steps + 1):
        margin = np.bincount(doc, x * theta[f], minlength=len(own)) + b
        g = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - y) * even
        grad = np.append(np.bincount(f, g[doc] * x, minlength=len(r)) + penalty * theta, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta, b = theta - move[:-1], b - move[-1]
    return theta * scale, float(b)


def _numbers(n: int, packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(packed, 4 * n, codec="zstd", asbytes=True), np.uint32), dtype=np.uint32)


def clear(texts: DataFrame, P: float, Q: float, keep: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(number, ratio) of the ``keep`` clearest features of texts (y, n, f), the clearest first.

    Texts are counted where they are, in slices of the features, and each slice is added up in its own task.
    """

    def counts(batches):
        both = np.zeros((2, SLICES, (1 << BITS) // SLICES), np.int32)
        flat = both.reshape(2, -1)
        for b in batches:
            for y, n, f in zip(*(b.column(c).to_pylist() for c in ("y", "n", "f")), strict=True):
                flat[y][_numbers(n, f)] += 1  # a text holds each feature once
        held = np.flatnonzero(both.any(axis=(0, 2)))
        packed = [pa.compress(both[:, k].tobytes(), codec="zstd", asbytes=True) for k in held.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(packed, pa.binary())], ["slice", "counts"])

    def chosen(table: pa.Table) -> pa.Table:
        long = (1 << BITS) // SLICES
        both = np.zeros((2, long), np.int64)
        for x in table.column("counts").to_pylist():
            both += np.frombuffer(pa.decompress(x, 8 * long, codec="zstd", asbytes=True), np.int32).reshape(2, -1)
        q, p = both
        r = ratios(p, q, P, Q)
        weight = np.abs(r) * np.sqrt(p + q)
        at = np.flatnonzero((weight >= least) & (weight > 0))
        return pa.table({"feature": pa.array((at + table.column("slice")[0].as_py() * long).astype(np.int32)), "r": pa.array(r[at]), "weight": pa.array(weight[at])})

    each = texts.select("y", "n", "f").mapInArrow(counts, "slice int, counts binary")
    got = each.groupBy("slice").applyInArrow(chosen, "feature int, r double, weight double").orderBy(F.desc("weight"), "feature").limit(keep).toArrow()
    return got.column("feature").to_numpy(), got.column("r").to_numpy()


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, most: int = MOST_FEATURES, keep: int = KEEP, least: float = 6.0) -> tuple[np.ndarray, float]:
    """Weights and bias from at most ``sample`` rows of labels (doc_id, label); features are counted and chosen side by side, the chosen ones weighed in one task.

    The texts hold ``most`` features together at most, and ``keep`` features get a weight, so the
    task's memory is bounded. Of the texts of an id that repeats, that with the smallest digest is taken.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    picked = None
    for c in (1, 0):
        part = known.where(F.col("y") == c).orderBy(order, "doc_id").limit(sample // 2)
        picked = part if picked is None else picked.union(part)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")  # at most ``sample`` ids

    def gather(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = part.column("text").to_pylist()
                got = [features(t).astype(np.uint32) for t in texts]
                mark = [hashlib.blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=8).digest() for t in texts]
                packed = [pa.compress(np.diff(g, prepend=np.uint32(0)).tobytes(), codec="zstd", asbytes=True) for g in got]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(mark, pa.binary()), pa.array([len(g) for g in got], pa.int32()), pa.array(packed, pa.binary())], ["doc_id", "y", "mark", "n", "f"])

    found = rows.mapInArrow(gather, "doc_id long, y int, mark binary, n int, f binary")
    found = checkpoint(found.groupBy("doc_id").agg(F.min_by(F.struct("y", "n", "f"), "mark").alias("r")).select("doc_id", "r.*"))
    # the smallest digests of ids first, as far as their features go together into ``most``
    size = W.orderBy(order, "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    within = found.select("doc_id", F.sum("n").over(size).alias("upto")).where(F.col("upto") <= most).select("doc_id")
    got = found.join(F.broadcast(within), "doc_id")
    totals = {r["y"]: float(r["count"]) for r in got.groupBy("y").count().collect()}
    w = np.zeros(1 << BITS, np.float32)
    if not totals:
        return w, 0.0
    at, r = clear(got, totals.get(1, 0.0), totals.get(0, 0.0), keep, least) if len(totals) == 2 else (np.zeros(0, np.int32), np.zeros(0))

    def own(batches):
        number = np.full(1 << BITS, -1, np.int32)
        number[at] = np.arange(len(at), dtype=np.int32)
        for b in batches:
            held = [(k := number[_numbers(n, f)])[k >= 0].tobytes() for n, f in zip(b.column("n").to_pylist(), b.column("f").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(held, pa.binary())], ["doc_id", "y", "own"])

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending")])
        theta, b = train([np.frombuffer(x, np.int32) for x in table.column("own").to_pylist()], table.column("y").to_numpy(), r)
        return pa.table({"bias": pa.array([b], pa.float64()), "w": pa.array([theta.astype(np.float32).tobytes()], pa.binary())})

    # of at most ``sample`` texts the chosen features alone
    fitted = got.select("doc_id", "y", "n", "f").mapInArrow(own, "doc_id long, y int, own binary").withColumn("one", F.lit(1)).groupBy("one").applyInArrow(solve, "bias double, w binary").first()
    w[at] = np.frombuffer(fitted["w"], np.float32)
    return w, fitted["bias"]


def margins(texts: list[str | None], w: np.ndarray, bias: float) -> np.ndarray:
    """The linear score of each text: the bias and the weights of the features it holds."""
    used = w != 0
    out = np.empty(len(texts))
    for i, text in enumerate(texts):
        x, hits = folded(text), []
        for start in range(0, max(1, len(x)), BATCH_CHARS):  # long texts in pieces that overlap
            for n in ORDERS:
                h = grams(x[start : start + BATCH_CHARS + n - 1], n)
                hits.append(h[used[h]])
        out[i] = bias + w[np.unique(np.concatenate(hits))].sum(dtype=np.float64)
    return out


def score(text: Column, w: np.ndarray, bias: float) -> Column:
    at = np.flatnonzero(w).astype(np.int32)
    packed = (at, w[at])

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        full = np.zeros(1 << BITS, np.float32)
        full[packed[0]] = packed[1]
        m = margins(column.to_pylist(), full, bias)
        return pa.array(1 / (1 + np.exp(-m / (1 + np.abs(m) / 30))), pa.float64())

    return scored(text)


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held: int = 2, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs (doc_id, text).

    Labels of documents with crc32(doc_id) mod folds = held are not learned from; a document
    labelled twice counts as toxic if one label says so. Null and empty texts hold no known
    feature and get the score of the bias. Without labels of both classes every score is the
    prior's. Rows that repeat an id are scored one by one; other columns are ignored.
    """
    w, bias = fit(docs, labels.where(crc_bucket(F.col("doc_id"), folds) != held), label, sample)
    return docs.select("doc_id", (crc_bucket(F.col("doc_id"), folds) == held).alias("held_out"), score(F.col("text"), w, bias).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
