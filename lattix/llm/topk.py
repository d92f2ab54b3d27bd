"""Exact top-k search by a uniform threshold in three phases.

A score is an inner product of integer vectors, the sum of partial scores over blocks of
components. Each shard of rows has a list of partial scores for each block of a query:

1. Every list gives its ``k`` highest entries and its smallest value. What the gathered entries
   score in full bounds the k-th highest score from below; the smallest values, added up over the
   blocks, are a floor to count from (partial scores can be negative).
2. What the bound leaves above the floor is shared evenly among the blocks. A row below its share in
   every block scores less than the bound, so the entries at or above their cutoffs are sufficient;
   they and the cutoffs of the other blocks bound a row's score from above.
3. Rows whose upper bound reaches the k-th highest score that is known are resolved in full.

Queries are taken in blocks of bounded size, which are broadcast; rows stay where they are read.
Shards send the entries of the first phase and resolved rows that reach the bound, no scores of
all pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattix.llm.common import checkpoint, in_order, parts

K = 5
EVERY = 50
SCALE = 256
#: Components of a block, and the most blocks.
BLOCK, BLOCKS = 16, 16
#: Rows of a shard, at least; there are as many shards as shuffle partitions at most. Each sends ``k`` entries for each query and block.
SHARD = 1 << 12
#: Bytes of the queries of a pass, as 64-bit components.
PASS_BYTES = 16 << 20
#: Rows and queries multiplied at a time.
ROWS, QUERIES = 2048, 512
ENTRY = "query_id long, block int, vec_id long, total long, least long"


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the integer vectors of rows with an id whose vector holds finite components only."""
    x = F.col("embedding").cast("array<double>")
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
        .where("vec_id is not null and x is not null and forall(x, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
        .select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))
    )


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles, filled up with zeros; integers up to 2 ** 53 are exact."""
    offsets = np.asarray(column.offsets)
    flat = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    if (size == width).all():
        return flat.reshape(-1, width).astype(np.float64)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = flat
    return out


@dataclass
class Pass:
    """The queries of a pass: ids, vectors, components of each block; after the first phase also bounds and cutoffs."""

    ids: np.ndarray
    x: np.ndarray
    cuts: list[slice]
    k: int
    bound: np.ndarray | None = None
    share: np.ndarray | None = None

    def products(self, rows: np.ndarray, at: slice) -> list[np.ndarray]:
        """Partial scores of the queries with the rows for each block."""
        return [self.x[at, c] @ rows[:, c].T for c in self.cuts]

    def own(self, ids: np.ndarray, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of the pairs of one id; the queries' ids ascend."""
        have = self.ids[at]
        i = np.minimum(np.searchsorted(have, ids), len(have) - 1)
        c = np.flatnonzero(have[i] == ids)
        return i[c], c


def highest(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest of each row of scores, ties to smaller ids; in no order."""
    if score.shape[1] <= k:
        return np.broadcast_to(np.arange(score.shape[1]), score.shape)
    least = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
    tied = (score == least).sum(axis=1) + (score > least).sum(axis=1) > k
    out = np.argpartition(-score, k - 1, axis=1)[:, :k]
    for i in np.flatnonzero(tied):
        out[i] = np.lexsort((ids, -score[i]))[:k]
    return out


def _shards(batches, width: int):
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            yield part.column("vec_id").to_numpy(), matrix(part.column("v"), width)


def gathered(q: Pass):
    """Phase one over a shard: for each query and block the k highest entries, with the row's whole score, and the smallest value."""

    def rows(batches):
        n, m = len(q.ids), len(q.cuts)
        best = np.full((m, n, q.k), -np.inf)
        who, total = np.zeros((m, n, q.k), np.int64), np.zeros((m, n, q.k))
        least = np.full((m, n), np.inf)
        for ids, x in _shards(batches, q.x.shape[1]):
            for at in range(0, n, QUERIES):
                own = slice(at, at + QUERIES)
                product = q.products(x, own)
                whole, same = sum(product), q.own(ids, own)
                for j, p in enumerate(product):
                    p[same] = np.inf
                    least[j, own] = np.minimum(least[j, own], p.min(axis=1))
                    p[same] = -np.inf
                    top = highest(p, ids, q.k)
                    side = lambda new, old: np.concatenate((old, new), axis=1)
                    score = side(np.take_along_axis(p, top, 1), best[j, own])
                    name = side(ids[top], who[j, own])
                    full = side(np.take_along_axis(whole, top, 1), total[j, own])
                    keep = np.argpartition(-score, q.k - 1, axis=1)[:, : q.k]
                    best[j, own], who[j, own], total[j, own] = (np.take_along_axis(y, keep, 1) for y in (score, name, full))
        for j in range(m):
            i, e = np.nonzero(np.isfinite(best[j]))
            columns = [q.ids[i], np.full(len(i), j, np.int32), who[j, i, e], total[j, i, e].astype(np.int64), least[j, i].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [f.split()[0] for f in ENTRY.split(", ")])

    return rows


def cutoffs(entries: DataFrame, q: Pass) -> Pass:
    """q with the bound of each query, the k-th highest whole score gathered, and the cutoff of each of its blocks.

    A query with fewer than k entries has no bound: everything is sufficient for it.
    """
    floor = entries.groupBy("query_id", "block").agg(F.min("least").alias("floor"))
    floor = floor.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("block", "floor"))).alias("floor"))  # one for each block
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("total"), "vec_id"))
    best = entries.select("query_id", "vec_id", "total").distinct().withColumn("place", place).where(F.col("place") == q.k).select("query_id", "total")
    bound, share = np.full(len(q.ids), -np.inf), np.full((len(q.ids), len(q.cuts)), -np.inf)
    at = {int(v): i for i, v in enumerate(q.ids)}
    for r in best.join(floor, "query_id").toLocalIterator():  # a row for each query of the pass
        i = at[r["query_id"]]
        low = np.array([r["floor"][j] for j in range(len(q.cuts))], float)
        bound[i] = r["total"]
        share[i] = low + (bound[i] - low.sum()) / len(q.cuts)
    return Pass(q.ids, q.x, q.cuts, q.k, bound, share)


def resolved(q: Pass):
    """Phases two and three over a shard: rows with a sufficient entry, bounded from above by the cutoffs of the other blocks; those that reach the bound, by their whole scores the k highest of the shard."""

    def rows(batches):
        n = len(q.ids)
        best, who = np.full((n, q.k), -np.inf), np.full((n, q.k), np.iinfo(np.int64).max)
        for ids, x in _shards(batches, q.x.shape[1]):
            for at in range(0, n, QUERIES):
                own = slice(at, at + QUERIES)
                product = q.products(x, own)
                sent = [p >= q.share[own, j, None] for j, p in enumerate(product)]
                upper = sum(np.where(s, p, np.minimum(q.share[own, j, None], np.finfo(float).max)) for j, (s, p) in enumerate(zip(sent, product, strict=True)))
                known = np.maximum(q.bound[own], best[own].min(axis=1))
                wanted = np.logical_or.reduce(sent) & (upper >= known[:, None])
                wanted[q.own(ids, own)] = False
                i, c = np.nonzero(wanted)
                score = sum(p[i, c] for p in product)
                good = score >= known[i]
                i, c, score = i[good] + at, c[good], score[good]
                if not len(i):
                    continue
                hit = np.unique(i)
                i = np.concatenate((i, np.repeat(hit, q.k)))
                name = np.concatenate((ids[c], who[hit].ravel()))
                score = np.concatenate((score, best[hit].ravel()))
                order = np.lexsort((name, -score, i))
                first = np.searchsorted(i[order], hit)
                take = order[first[:, None] + np.arange(q.k)]
                best[hit], who[hit] = score[take], name[take]
        i, e = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(q.ids[i]), pa.array(who[i, e]), pa.array(best[i, e].astype(np.int64))], ["query_id", "vec_id", "score"])

    return rows


def search(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each row whose vec_id ``every`` divides with other rows.

    vectors has vec_id and embedding; components are floor(scale * x). Ties go to the smaller vec_id. Vectors that
    are null or hold null or non-finite components, and rows without an id, take no part; a vector's missing
    components count as 0 beside longer ones. Rows that repeat an id are not candidates of that id's queries, and
    a candidate each elsewhere; of queries that repeat an id the one with the largest vector, component by component, counts.
    Fewer candidates than k are all returned, an empty table gives an empty result, other columns are
    ignored. Products of 2 ** 53 or more are an error.
    """
    spark = vectors.sparkSession
    rows = checkpoint(usable(vectors, scale))
    most = rows.agg(F.max(F.size("v")).alias("width"), F.max(F.array_max(F.transform("v", F.abs))).alias("most"), F.count("*").alias("n")).head()
    width = most["width"] or 0
    if (most["most"] or 0) ** 2 * width >= 1 << 53:
        raise ValueError("inner products of 2 ** 53 or more are not exact")
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max("v").alias("v"))
    size = max(1, PASS_BYTES // (8 * max(width, 1)))
    queries = checkpoint(in_order(queries, "vec_id").withColumn("pass", F.floor(F.col("at") / size).cast("int")))
    shards = rows.coalesce(min(parts(spark), max(1, -(-most["n"] // SHARD))))
    blocks = min(BLOCKS, max(1, -(-width // BLOCK)))
    edges = np.linspace(0, width, blocks + 1).astype(int)
    found = []
    for number in range((queries.agg(F.max("pass")).head()[0] if width else None) or 0, -1, -1):
        own = queries.where(F.col("pass") == number).select("vec_id", "v").toArrow().combine_chunks().sort_by("vec_id")  # PASS_BYTES at most
        if not own.num_rows:
            break
        q = Pass(own.column("vec_id").to_numpy(), matrix(own.column("v").combine_chunks(), width), [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)], k)
        sent = spark.sparkContext.broadcast(q)
        q = cutoffs(checkpoint(shards.mapInArrow(_with(sent, gathered), ENTRY)), q)
        cut = spark.sparkContext.broadcast(q)
        found.append(checkpoint(shards.mapInArrow(_with(cut, resolved), "query_id long, vec_id long, score long")))
    if not found:
        found = [spark.createDataFrame([], "query_id long, vec_id long, score long")]
    all_ = found[0]
    for f in found[1:]:
        all_ = all_.union(f)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return all_.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _with(sent, phase):
    return lambda batches: phase(sent.value)(batches)


ORACLE_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
