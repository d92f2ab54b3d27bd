"""Embedding near-duplicates by product quantisation with exact reranking.

Unit vectors are put in coarse inverted lists by their nearest centroid; the residual is cut into
subspaces and each part coded by its nearest codeword. A query's distance to a member is read
from tables, one for each subspace, of the distances of the query's residual to the codewords.

Probes are sufficient: a vector that differs from a query by x lies in a list only if the query
is no farther behind the plane between that list's centroid and its own nearest one than x
reaches across it. A linked x is at most r long, so all lists within r are probed, and no link is
missed. As that holds from both sides, a query probes its own list and those of higher numbers
only, and what is found counts for both. A member's code is off by a known distance e, kept with it; a table distance over r + e
rules the pair out and loses none. What is left is decided by the cosine in double precision.

Vectors of each length are compared with one another. Centroids and codewords are fitted to at
most ``sample`` vectors of a length, the first by a hash. Equal vectors are one class with a count. Lists and their queries are cut into blocks of bounded size,
and a block pair returns link counts and a spanning forest of its links, not the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.llm.common import checkpoint, components

SAMPLE = 20_000
SUBSPACES = 8
CODES = 64
BLOCK = 1024
QUERY_BLOCK = 4096


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)  # no overflow in squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1), 0.0)


def kmeans(x: np.ndarray, k: int, steps: int = 8, seed: int = 7) -> np.ndarray:
    """k centroids, fewer if x has fewer rows; empty ones keep their place."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(steps):
        near = np.concatenate([squared(x[i : i + 4096], c).argmin(axis=1) for i in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, j], minlength=len(c)) for j in range(x.shape[1])], axis=1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


class Quantiser:
    """Coarse centroids and the codewords of each subspace of the residuals."""

    def __init__(self, x: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES) -> None:
        self.centroids = kmeans(x, lists)
        d = x.shape[1]
        self.cuts = np.linspace(0, d, min(subspaces, d) + 1).astype(int)
        residual = x - self.centroids[squared(x, self.centroids).argmin(axis=1)]
        self.books = [kmeans(residual[:, a:b], codes, 6) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        self.gaps = np.sqrt(squared(self.centroids, self.centroids))
        # all tables of a residual as one product: a block for each subspace
        self.starts = np.concatenate(([0], np.cumsum([len(book) for book in self.books])))
        self.blocks = np.zeros((d, int(self.starts[-1])), np.float32)
        for a, b, at, book in zip(self.cuts[:-1], self.cuts[1:], self.starts[:-1], self.books, strict=True):
            self.blocks[a:b, at : at + len(book)] = -2 * book.T
        self.norms = np.concatenate([(book**2).sum(axis=1) for book in self.books]).astype(np.float32)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, distance of the decoded vector) of each row."""
        own = squared(x, self.centroids).argmin(axis=1)
        residual = x - self.centroids[own]
        codes = np.stack([squared(residual[:, a:b], book).argmin(axis=1) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)], axis=1)
        decoded = np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], axis=1)
        return own, codes.astype(np.uint8), np.linalg.norm(residual - decoded, axis=1)

    def probes(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, own list) of the lists from each row's own on that can hold a vector within the radius of it."""
        d = squared(x, self.centroids)
        own = d.argmin(axis=1)
        behind = d - d[np.arange(len(x)), own][:, None]
        near = behind <= 2 * radius * self.gaps[own] * (1 + 1e-9) + 1e-9
        row, list_ = np.nonzero(near & (np.arange(len(self.centroids)) >= own[:, None]))
        return row, list_, own[row]

    def tables(self, x: np.ndarray, list_: int) -> np.ndarray:
        """Of each row, the tables of all subspaces in a row: a codeword's share of the distance of the row from the list's members.

        Shares of the row itself are in those of the first subspace.
        """
        residual = x - self.centroids[list_]
        out = residual.astype(np.float32) @ self.blocks + self.norms
        out[:, : self.starts[1]] += (residual**2).sum(axis=1, keepdims=True).astype(np.float32)
        return out


def links(quantiser: Quantiser, list_: int, members: np.ndarray, codes: np.ndarray, off: np.ndarray, queries: np.ndarray, least: float):
    """(query, member) numbers of the pairs with a cosine of at least ``least``, a batch of queries at a time."""
    radius = np.sqrt(max(0.0, 2 - 2 * least))
    m, q = unit(members), unit(queries)
    bound = ((radius + off) ** 2 + 1e-4).astype(np.float32)  # more than single precision loses
    columns = codes.T.astype(np.intp) + quantiser.starts[:-1, None]
    for i in range(0, len(q), 256):
        part = q[i : i + 256]
        tables = quantiser.tables(part, list_)
        far = tables.take(columns[0], axis=1)
        for c in columns[1:]:
            far += tables.take(c, axis=1)
        a, b = np.nonzero(far <= bound)
        for k in range(0, len(a), 1 << 16):
            x, y = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
            ok = np.einsum("ij,ij->i", part[x], m[y]) >= least
            yield i + x[ok], y[ok]


class Joined:
    """Connected sets of numbered nodes, fed pairs in arrays."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (up := self.label[self.label]).tobytes() != self.label.tobytes():
                self.label = up


def cosine_duplicates(vectors: DataFrame, least: float = 0.95, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors (vec_id, embedding).

    Vectors that are null, zero, or hold null or non-finite values link with nothing, nor do
    rows without an id and vectors of different lengths (each length is a pass of its own, so
    there should be few). Rows that repeat an id count as vectors of their own. Ties at the
    threshold link. An empty table gives an empty result. Other columns are ignored.
    """
    e = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    good = F.col("vec_id").isNotNull() & F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    lengths = rows.where(good).groupBy(F.size(e).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").collect()  # a row for each length
    out = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    for r in lengths:
        out = out.union(_of_one_length(rows.where(good & (F.size(e) == r["d"])), r["n"], least, sample))
    return out


def _of_one_length(rows: DataFrame, total: int, least: float, sample: int) -> DataFrame:
    e = F.col("embedding")
    keyed = rows.select("vec_id", "embedding", F.xxhash64(e).alias("k1"), F.xxhash64(F.lit(1), e).alias("k2"))
    classes = checkpoint(keyed.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first(e).alias("embedding")))
    picked = classes.orderBy("k2", "k1").limit(sample).select("embedding").toArrow()  # bounded by ``sample``
    quantiser = Quantiser(unit(matrix(picked.column("embedding"))), max(1, min(4096, int(total**0.5) // 2)))
    reach = float(np.sqrt(max(0.0, 2 - 2 * least)))

    def coded(batches):
        for b in batches:
            own, codes, off = quantiser.encode(unit(matrix(b.column("embedding"))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int32()), b.column("rep"), b.column("n"), b.column("embedding"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off)], ["list", "rep", "n", "embedding", "codes", "off"])

    kind = rows.schema["embedding"].dataType.simpleString()
    members = checkpoint(classes.mapInArrow(coded, f"list int, rep long, n long, embedding {kind}, codes binary, off double"))

    def probing(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                row, list_, own = quantiser.probes(unit(matrix(part.column("embedding"))), reach)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(list_, pa.int32()), pa.array(list_ == own), part.column("rep").take(at), part.column("n").take(at), part.column("embedding").take(at)], ["list", "at_home", "rep", "n", "embedding"])

    source = members.select("rep", "n", "embedding")
    queries = source.mapInArrow(probing, f"list int, at_home boolean, rep long, n long, embedding {kind}")
    asked = source.mapInArrow(lambda bs: (x.select(["list"]) for x in probing(bs)), "list int").groupBy("list").agg(F.count("*").alias("q"))
    sizes = checkpoint(
        members.groupBy("list").agg(F.count("*").alias("m")).join(asked, "list").select("list", F.ceil(F.col("m") / BLOCK).cast("int").alias("mb"), F.ceil(F.col("q") / QUERY_BLOCK).cast("int").alias("qb"))
    )  # a row for each list, at most 4096
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = members.join(F.broadcast(sizes), "list").withColumn("i", block("mb")).withColumn("j", each("qb")).drop("mb", "qb")
    right = queries.join(F.broadcast(sizes), "list").withColumn("j", block("qb")).withColumn("i", each("mb")).drop("mb", "qb")

    def compare(key: tuple, m: pa.Table, q: pa.Table) -> pa.Table:
        empty = pa.table({"kind": pa.array([], pa.int32()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not m.num_rows or not q.num_rows:
            return empty
        codes = np.frombuffer(b"".join(m.column("codes").to_pylist()), np.uint8).reshape(m.num_rows, -1)
        own, other, home = m.column("rep").to_numpy(), q.column("rep").to_numpy(), q.column("at_home").to_numpy()
        weight, times = m.column("n").to_numpy(), q.column("n").to_numpy()
        count, back = np.zeros(q.num_rows, np.int64), np.zeros(m.num_rows, np.int64)
        nodes, where = np.unique(np.concatenate((own, other)), return_inverse=True)
        joined = Joined(len(nodes))
        for a, b in links(quantiser, key[0].as_py(), matrix(m.column("embedding")), codes, m.column("off").to_numpy(), matrix(q.column("embedding")), least):
            once = ~home[a] | (other[a] > own[b])  # a pair of one list is found from both sides
            a, b = a[once], b[once]
            count += np.bincount(a, weight[b], minlength=len(count)).astype(np.int64)
            back += np.bincount(b, times[a], minlength=len(back)).astype(np.int64)
            joined.add(where[len(own) + a], where[b])
        some, more, tied = np.flatnonzero(count), np.flatnonzero(back), np.flatnonzero(joined.label != np.arange(len(nodes)))
        return pa.table({
            "kind": pa.array([0] * (len(some) + len(more)) + [1] * len(tied), pa.int32()), "a": pa.array(np.concatenate((other[some], own[more], nodes[tied]))), "b": pa.array(np.concatenate((count[some], back[more], nodes[joined.label[tied]]))),
        })

    found = checkpoint(left.groupBy("list", "i", "j").cogroup(right.groupBy("list", "i", "j")).applyInArrow(compare, "kind int, a long, b long"))
    counts = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("more"))
    comp = components(found.where("kind = 1")).withColumnRenamed("id", "rep")
    result = classes.select("k1", "k2", "rep", "n").join(counts, "rep", "left").join(comp, "rep", "left").select(
        "k1", "k2", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    return keyed.select("vec_id", "k1", "k2").join(result, ["k1", "k2"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
