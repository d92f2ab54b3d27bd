"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

``statistics`` turns a text into ``len(NAMES)`` transformed counts in one pass over its bytes.
``fit`` gathers, for each class, the count, sums and cross products of the labelled rows as
Spark sums, so the driver sees two small matrices whatever the size of the corpus. Each class
covariance is shrunk towards the pooled one and that towards its mean variance; its Cholesky
factor is computed once and travels with the scoring function. The score is the logistic of
the squashed difference of the two log densities (Mahalanobis term, determinant, prior).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattix.llm.common import bloom_of_ids, checkpoint, chunks, crc_bucket, may_hold, mix, parts, shingle_hashes, span_hashes, word_spans

NAMES = (
    "log_chars", "log_words", "word_length", "upper", "symbols", "digits", "stops", "pipes",
    "distinct_words", "doubled_words", "distinct_lines", "distinct_shingles", "shouts", "line_length",
)
D = len(NAMES)
THRESHOLD = 0.3
#: Discriminant values are squashed to this bound, so that scores stay apart from 0 and 1.
BOUND = 30.0


def _classes() -> dict[str, np.ndarray]:
    def of(chars: bytes) -> np.ndarray:
        m = np.zeros(256, dtype=bool)
        m[list(chars)] = True
        return m

    return {
        "lead": np.array([not 0x80 <= b < 0xC0 for b in range(256)]), "upper": of(bytes(range(65, 91))), "letter": np.array([65 <= b < 91 or 97 <= b < 123 or b >= 0xC0 for b in range(256)]),
        "symbol": of(b"*#$%&@^~<>{}[]\\"), "digit": of(b"0123456789"), "stop": of(b".,;:?"), "pipe": of(b"|"), "shout": of(b"!"), "line": of(b"\n"),
    }


CLASSES = _classes()


def _distinct(hashes: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """The number of different hashes of each document."""
    if not len(hashes):
        return np.zeros(n)
    key = hashes + mix(docs.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount(docs[order][new], minlength=n).astype(float)


def statistics_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The statistics of each document of a chunk, a row for each; those of an empty text too."""
    n = len(offsets) - 1
    count = {k: np.diff(np.concatenate(([0], np.cumsum(m[data])))[offsets]).astype(float) for k, m in CLASSES.items()}
    starts, ends, docs = word_spans(data, offsets)
    words = np.bincount(docs, minlength=n).astype(float)
    hashes = span_hashes(data, starts, ends)
    pair = docs[1:] == docs[:-1]
    doubled = np.bincount(docs[1:][pair & (hashes[1:] == hashes[:-1])], minlength=n)
    # lines: from the start of a document or behind a line feed
    feeds = np.flatnonzero(CLASSES["line"][data]) + 1 if len(data) else np.zeros(0, np.int64)
    full = offsets[:-1][np.diff(offsets) > 0]
    begin = np.union1d(full, feeds[feeds < len(data)])
    stop = np.append(begin[1:], len(data))
    line_docs = np.searchsorted(offsets, begin, side="right") - 1
    lines = np.bincount(line_docs, minlength=n).astype(float)
    distinct_lines = _distinct(span_hashes(data, begin, stop) if len(begin) else np.zeros(0, np.uint64), line_docs, n)
    sh, sd = shingle_hashes(hashes, docs, n, 4)
    shingles = np.bincount(sd, minlength=n).astype(float)
    w1, c1 = np.maximum(words, 1), np.maximum(count["lead"], 1)
    lg = lambda x, e=0.005: np.log(x + e)
    return np.column_stack([
        np.log1p(count["lead"]), np.log1p(words), np.log1p(c1 / w1), lg(count["upper"] / np.maximum(count["letter"], 1)), lg(count["symbol"] / c1), lg(count["digit"] / c1), lg(count["stop"] / w1),
        lg(count["pipe"] / w1), lg(_distinct(hashes, docs, n) / w1, 0.05), lg(doubled / w1), lg(distinct_lines / np.maximum(lines, 1), 0.05), lg(_distinct(sh, sd, n) / np.maximum(shingles, 1), 0.05),
        lg(count["shout"] / w1), np.log1p(w1 / np.maximum(lines, 1)),
    ])


def statistics(text: Column) -> Column:
    """array<double> of the NAMES of each text; null counts as empty."""

    @F.arrow_udf("array<double>")
    def stats(column: pa.Array) -> pa.Array:
        got = [statistics_of(data, offsets) for _, _, data, offsets in chunks(column)]
        flat = np.concatenate(got).ravel() if got else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, D, dtype=np.int32)), pa.array(flat))

    return stats(text)


@dataclass
class Model:
    """Means, Cholesky factors of the precision-ready covariances, and log constants of two classes."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    consts: np.ndarray

    def decision(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        each = []
        for mean, factor, const in zip(self.means, self.factors, self.consts, strict=True):
            each.append(const - 0.5 * (np.linalg.solve(factor, (z - mean).T) ** 2).sum(axis=0))
        v = each[1] - each[0]
        return v / (1 + np.abs(v) / BOUND)

    def score(self, stats: Column) -> Column:
        model = self

        @F.arrow_udf("double")
        def scored(column: pa.Array) -> pa.Array:
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, D)
            return pa.array(1 / (1 + np.exp(-model.decision(x))) if len(x) else np.zeros(0), pa.float64())

        return scored(stats)


def solve(counts: np.ndarray, sums: np.ndarray, outer: np.ndarray, shrink: float = 0.1, ridge: float = 0.02) -> Model:
    """The model from each class's count, sum and sum of outer products.

    With a class missing, both get the pooled statistics and the score is the prior's.
    """
    n = np.maximum(counts, 0.0)
    total = max(n.sum(), 1.0)
    centre = sums.sum(axis=0) / total
    pooled = outer.sum(axis=0) / total - np.outer(centre, centre)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    means, covs = np.zeros((2, D)), np.zeros((2, D, D))
    within = np.zeros((D, D))
    for c in (0, 1):
        if n[c] > 0:
            m = sums[c] / n[c]
            means[c] = (m - centre) / scale
            covs[c] = (outer[c] / n[c] - np.outer(m, m)) / np.outer(scale, scale)
        within += n[c] / total * covs[c]
    if within.trace() <= 0:
        within = np.eye(D)
    factors, consts = [], []
    for c in (0, 1):
        own = shrink + (1 - shrink) * D / (n[c] + D)  # few rows: closer to the pooled matrix
        s = (1 - own) * covs[c] + own * within if min(n) > 0 else within
        s = (1 - ridge) * s + ridge * np.trace(s) / D * np.eye(D) + 1e-9 * np.eye(D)
        factor = np.linalg.cholesky(s)
        factors.append(factor)
        consts.append(-np.log(np.diag(factor)).sum() + np.log((n[c] + 1) / (total + 2)))
        if min(n) == 0:
            means[c] = 0
    return Model(centre, scale, means, np.array(factors), np.array(consts))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fits to the rows of stats (doc_id, stats) that labels (doc_id, label 0 or 1) name; null labels are left out."""
    rows = stats.join(labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y in (0, 1)"), "doc_id")
    # sums of doubles depend on their order: every run adds up the same rows in the same one
    rows = rows.repartition(parts(stats.sparkSession), "doc_id").sortWithinPartitions("doc_id", "stats", "y").select("y", "stats")

    def partial(batches):
        n, s, o = np.zeros(2), np.zeros((2, D)), np.zeros((2, D, D))
        for b in batches:
            x = b.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, D)
            y = b.column("y").to_numpy(zero_copy_only=False)
            for c in (0, 1):
                v = x[y == c]
                n[c] += len(v)
                s[c] += v.sum(axis=0)
                o[c] += v.T @ v
        values = np.concatenate([n, s.ravel(), o.ravel()])
        task = np.full(len(values), TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(task), pa.array(values)], ["i", "task", "v"])

    each = rows.mapInArrow(partial, "i int, task int, v double").groupBy("i").agg(F.array_sort(F.collect_list(F.struct("task", "v"))).alias("v"))
    got = each.select("i", F.aggregate("v", F.lit(0.0), lambda a, x: a + x["v"]).alias("v")).collect()
    flat = np.zeros(2 + 2 * D + 2 * D * D)
    for r in got:
        flat[r["i"]] = r["v"]
    return solve(flat[:2], flat[2 : 2 + 2 * D].reshape(2, D), flat[2 + 2 * D :].reshape(2, D, D))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs (doc_id, text).

    Labels of documents with crc32(doc_id) mod folds = held are not learned from. Null and empty
    texts have statistics, so they get scores like any text. Without labels of both classes
    every score is the prior's. Rows that repeat an id are scored one by one; other columns
    are ignored.
    """
    stats = checkpoint(docs.select("doc_id", statistics(F.col("text")).alias("stats")))
    model = fit(stats, labels.where(crc_bucket(F.col("doc_id"), folds) != held), label)
    return stats.select(
        "doc_id", (crc_bucket(F.col("doc_id"), folds) == held).alias("held_out"), model.score(F.col("stats")).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def labelled_statistics(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, stats) of the documents that labels name, and perhaps others: texts are filtered where they are read."""
    packed = bloom_of_ids(labels, "doc_id")

    def rows(batches):
        for b in batches:
            keep = pa.array(np.flatnonzero(may_hold(packed, b.column("doc_id").to_numpy(zero_copy_only=False))))
            for i, j, data, offsets in chunks(b.column("text").take(keep)):
                flat = statistics_of(data, offsets).ravel()
                stats = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, D, dtype=np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(keep[i:j]), stats], ["doc_id", "stats"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return texts.mapInArrow(rows, "doc_id long, stats array<double>")


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns; texts are not shuffled."""
    learned = labels.where(crc_bucket(F.col("doc_id"), folds) != held)
    model = fit(labelled_statistics(docs, learned), learned, label)
    return docs.where(model.score(statistics(F.col("text"))) >= threshold)
