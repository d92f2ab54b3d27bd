"""Pieces the corpus operators share: checkpoints, Arrow text buffers, word hashes, components.

Text columns reach Python as Arrow batches. ``chunks`` hands them on as one UTF-8 byte buffer
with document offsets, a few hundred kilobytes at a time, so numpy works on many documents at
once and a task's memory does not depend on how many rows a batch holds.
"""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 19
BLOOM_BITS = 23
#: Edges of components in a file of their checkpoints.
EDGES = 250_000
#: What separates words: space and the control characters 9 to 13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: What separates words where punctuation is not part of them: every ASCII character but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_B = 0x9E3779B97F4A7C15
_B_INV = pow(_B, -1, 1 << 64)
_POW: dict[int, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's ``spark.checkpoint.dir``; on one machine, a temporary one if unset.

    Executors on other machines do not see a temporary folder, so on a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and cuts its lineage; survives the loss of executors.

    The shuffle files behind it are not needed any more. Spark removes them when the driver's
    garbage is collected, which may be long after; so that is asked for here.
    """
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    del df
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def parts(spark: SparkSession, times: int = 1) -> int:
    return times * int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _POW.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, base & (2**64 - 1), dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 8 * CHUNK_BYTES:
            _POW[base] = have
    return have[:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its values; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole values of about ``size`` bytes."""
    if len(column) == 0:
        return
    raw, offsets = text_buffer(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        j = min(j, n)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the words of a chunk, the runs of bytes not in gaps; no word crosses documents."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    word = ~gaps[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets[:-1]] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | first[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = word[1:]
    last = np.zeros(n + 1, dtype=bool)
    last[offsets[1:]] = True
    ends = np.flatnonzero(word & (~after | last[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans, A-Z folded to lower case if asked."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(((FOLD[data] if fold else data).astype(np.uint64) + np.uint64(1)) * powers(_B, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_B_INV, n + 1)[starts])


def shingle_hashes(words: np.ndarray, docs: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and document numbers of the word shingles of each document.

    A document with fewer than ``width`` words, but one at least, has its whole sequence as one.
    """
    h = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
    for k in range(width):
        h += mix(words[k : len(words) - width + 1 + k] + np.uint64(k + 1)) * np.uint64(2 * k + 3) if len(h) else 0
    h = mix(h)
    whole = docs[: len(h)] == docs[width - 1 :] if len(h) else np.zeros(0, bool)
    h, d = h[whole], docs[: len(whole)][whole]
    counts = np.bincount(docs, minlength=n_docs)
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):
        at = np.concatenate(([0], np.cumsum(counts)))
        own = np.array([_sequence(words[at[i] : at[i + 1]]) for i in few], dtype=np.uint64)
        h, d = np.concatenate((h, own)), np.concatenate((d, few))
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
    return h, d


def _sequence(words: np.ndarray) -> np.uint64:
    k = np.arange(1, len(words) + 1, dtype=np.uint64)
    return mix((mix(words + k) * (k + k + np.uint64(len(words)))).sum(dtype=np.uint64, keepdims=True))[0]


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the folds that hold out labels."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


#: The table of CRC-32 by its rule, as the CTE that crc32_sql() reads.
CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS rem)"


def crc32_sql(x: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a string's UTF-8 bytes, null for null; the query has CRC_TABLE among its tables."""
    byte = f"('0x' || substr(hex(encode({x})), (2 * i - 1)::INT, 2))::BIGINT"
    bytes_ = f"list_transform(range(1, octet_length(encode({x})) + 1), lambda i: {byte})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: xor(c >> 8, crc.rem[((xor(c, b) & 255) + 1)::INT])), 4294967295::BIGINT)"


def in_order(df: DataFrame, *order: str) -> DataFrame:
    """df, written, with ``at``: each row's place from 0 in the order of the columns, by ranges of them and the sizes of the ranges."""
    spark = df.sparkSession
    n = parts(spark)
    rows = checkpoint(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = {r["p"]: r["n"] for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row for each partition
    starts = np.concatenate(([0], np.cumsum([sizes.get(p, 0) for p in range(max(sizes, default=0) + 1)])))
    start = F.element_at(F.lit([int(x) for x in starts[:-1]]).cast("array<long>"), (part + 1).cast("int"))
    return rows.withColumn("at", start + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))


def bloom(hashes: np.ndarray, bits: int = BLOOM_BITS) -> np.ndarray:
    """A filter of 2 ** bits bits with two bits for each hash."""
    out = np.zeros(1 << bits, dtype=bool)
    out[(hashes >> np.uint64(64 - bits)).astype(np.int64)] = True
    out[(hashes & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
    return np.packbits(out)


def passes(packed: np.ndarray, hashes: np.ndarray, bits: int = BLOOM_BITS) -> np.ndarray:
    a = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    ok = (packed[a >> 3] >> (7 - (a & 7)).astype(np.uint8)) & 1
    at = np.flatnonzero(ok)
    b = (hashes[at] & np.uint64((1 << bits) - 1)).astype(np.int64)
    out = np.zeros(len(hashes), dtype=bool)
    out[at[((packed[b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1) > 0]] = True
    return out


def bloom_of(df: DataFrame, hashes) -> np.ndarray:
    """The filter of all hashes that ``hashes`` yields from df's batches; 1 MB whatever the table's size."""

    def filters(batches):
        all_ = np.zeros((1 << BLOOM_BITS) // 8, np.uint8)
        for h in hashes(batches):
            all_ |= bloom(h)
        words = all_.view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(words[at], pa.int64())], ["at", "v"])

    out = np.zeros((1 << BLOOM_BITS) // 64, np.int64)
    for r in df.mapInArrow(filters, "at int, v long").groupBy("at").agg(F.bit_or("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out.view(np.uint8)


def bloom_of_ids(df: DataFrame, column: str) -> np.ndarray:
    """The filter of a column of ids, for may_hold()."""

    def hashes(batches):
        for b in batches:
            yield mix(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))

    return bloom_of(df.select(F.col(column).cast("long")).where(f"{column} is not null"), hashes)


def may_hold(packed: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return passes(packed, mix(ids.astype(np.int64).view(np.uint64)))


def word_sequences(docs: DataFrame, wanted: DataFrame, least: int = 1) -> DataFrame:
    """(doc_id, items) of the texts of the wanted ids, and perhaps others, that have ``least`` words: folded words as 32-bit hashes in order.

    Texts are filtered where they are read, and the result is written. Shingles of such hashes,
    by shingles_of(), are 64-bit ones; half the bytes of a set of them, or fewer, move.
    """
    packed = bloom_of_ids(wanted, "doc_id")

    def rows(batches):
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(may_hold(packed, ids))
            own, items = [], []
            for i, j, data, offsets in chunks(b.column("text").take(pa.array(keep))):
                starts, ends, doc = word_spans(data, offsets)
                if len(starts):
                    h = (span_hashes(data, starts, ends) >> np.uint64(32)).astype(np.uint32)
                    cut = np.searchsorted(doc, np.arange(j - i + 1))
                    for k in np.flatnonzero(np.diff(cut) >= least).tolist():
                        own.append(int(ids[keep[i + k]]))
                        items.append(h[cut[k] : cut[k + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(items, pa.binary())], ["doc_id", "items"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return checkpoint(texts.mapInArrow(rows, "doc_id long, items binary"))


def shingles_of(items: bytes, width: int) -> np.ndarray:
    """The shingles of a text, in order, from its word_sequences() row."""
    words = np.frombuffer(items, np.uint32).astype(np.uint64)
    return shingle_hashes(words, np.zeros(len(words), np.int64), 1, width)[0]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the given ones connect, one fewer than each component's nodes: each node's to its smallest."""
    nodes, where = np.unique(np.concatenate((a, b)), return_inverse=True)
    label, x, y = np.arange(len(nodes)), where[: len(a)], where[len(a) :]
    while True:
        p, q = label[x], label[y]
        differ = p != q
        if not differ.any():
            break
        x, y, p, q = x[differ], y[differ], p[differ], q[differ]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(up := label[label], label):
            label = up
    tied = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[tied], nodes[label[tied]]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable from each id that has an edge.

    Each partition first shrinks its edges to a forest; then labels pass over the edges and
    pointers are halved until nothing changes, in a number of rounds that grows with the
    logarithm of the diameter. Every round is a join and a combined minimum, so a hub's rows
    are spread over tasks; its result is written in a file for each EDGES edges. edges is read
    more than once, so it should be a written table.
    """

    def shrink(batches):
        a = b = np.zeros(0, np.int64)
        for x in batches:
            a, b = forest(np.concatenate((a, x.column("a").to_numpy())), np.concatenate((b, x.column("b").to_numpy())))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").mapInArrow(shrink, "a long, b long")
    files = max(1, -(-pairs.count() // EDGES))
    both = checkpoint(pairs.union(pairs.select("b", "a")).distinct().coalesce(files))
    labels = checkpoint(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("label")).coalesce(files))
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), "label"), "b").select(F.col("a").alias("id"), "label")
        # the label of each neighbour, offered to the node and to the node's own label
        offered = both.join(labels.select(F.col("id").alias("b"), F.col("label").alias("near")), "b").join(
            labels.select(F.col("id").alias("a"), "label"), "a"
        ).where("near < label").select(F.col("label").alias("id"), F.col("near").alias("label"))
        low = labels.union(seen).union(offered).groupBy("id").agg(F.min("label").alias("label"))
        jumped = low.join(low.select(F.col("id").alias("label"), F.col("label").alias("up")), "label", "left").select("id", F.least("label", F.coalesce("up", "label")).alias("label"))
        after = checkpoint(jumped.coalesce(files))
        changed = after.join(labels.withColumnRenamed("label", "was"), "id").where("label <> was").limit(1).count()
        labels = after
        if not changed:
            return labels.select("id", F.col("label").alias("component"))
