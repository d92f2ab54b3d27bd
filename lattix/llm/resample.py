"""Importance resampling towards a target: documents drawn by the log-ratio of their n-grams' frequencies.

1. The n-grams of documents and of target texts are counted by CRC-32 in a fixed number of buckets;
   a CRC of a run of words is put together from those of its words, so each word is hashed once.
2. A bucket's gain is an entry of an array that every task gets; a document's weight is the sum of
   the entries of its n-grams. With noise that only depends on the id, the highest scores are a
   sample without replacement by weight.
3. The cut-off is found by quickselect over (score, doc_id): random keys of what is still open
   are pivots, rows above, at and between them are counted exactly in one pass, and the range that
   holds the k-th key is kept until a pivot is that key. Only the winners are sorted and ranked.
"""

from __future__ import annotations

import hashlib
import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattix.llm.common import CRC_TABLE, FOLD, PUNCTUATION, checkpoint, chunks, crc32_sql, in_order

BUCKETS = 10_000
WIDTH = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Keys compared in one pass of the quickselect.
PIVOTS = 24
#: What separates words becomes a space, A-Z lower case.
_CLEAN = bytes(0x20 if PUNCTUATION[b] else int(FOLD[b]) for b in range(256))
#: Words up to this length are joined by tables, longer ones by running the CRC on.
SHORT = 64


def _shift_tables() -> np.ndarray:
    """[n, j, b]: what byte j of a CRC with value b becomes behind n more zero bytes."""
    rem = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rem = np.where(rem & 1, (rem >> 1) ^ np.uint32(0xEDB88320), rem >> 1)
    out = np.zeros((SHORT + 2, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, SHORT + 2):
        out[n] = rem[out[n - 1] & 255] ^ (out[n - 1] >> 8)
    return out


SHIFT = _shift_tables()
_BLANK = np.uint32(crc32(b" "))


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs behind n more zero bytes; that xor the CRC of n bytes is the CRC of both together."""
    return SHIFT[n, 0, crc & 255] ^ SHIFT[n, 1, (crc >> 8) & 255] ^ SHIFT[n, 2, (crc >> 16) & 255] ^ SHIFT[n, 3, crc >> 24]


def joined(crc: np.ndarray, words: list[bytes], own: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRCs of what has ``crc``, a space and the words, whose own CRCs and sizes are given."""
    n = np.minimum(size, SHORT)
    spaced = shifted(np.full(len(n), _BLANK, np.uint32), n) ^ own
    out = shifted(crc, n + 1) ^ spaced
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = crc32(words[i], crc32(b" ", int(crc[i])))
    return out


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of the runs of 1 to ``width`` words of a chunk's texts, in no order, and each text's number of words."""
    raw = data.tobytes().translate(_CLEAN)
    words: list[bytes] = []
    counts = np.zeros(len(offsets) - 1, np.int64)
    for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
        own = raw[a:b].split(b" ")
        before = len(words)
        words += filter(None, own)
        counts[i] = len(words) - before
    doc = np.repeat(np.arange(len(counts)), counts)
    one = np.fromiter(map(crc32, words), np.uint32, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    grams, docs, last = [one], [doc], one
    for w in range(1, width):
        if len(words) <= w:
            break
        last = joined(last[:-1], words[w:], one[w:], size[w:])  # of words i to i + w
        inside = doc[: len(last)] == doc[w:]
        grams.append(last[inside])
        docs.append(doc[w:][inside])
    return (np.concatenate(grams) % np.uint32(buckets)).astype(np.int64), np.concatenate(docs), counts


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many n-grams of the texts each bucket holds; a row for each bucket comes to the driver."""

    def rows(batches):
        seen = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, data, offsets in chunks(b.column(0)):
                seen += np.bincount(features(data, offsets, buckets)[0], minlength=buckets)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(rows, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log-ratio) of each bucket's frequency in the target to that in the source, both smoothed by one."""
    b, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1) * (s + b) / ((x + 1) * (t + b)))) for x, y in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """floor(1000 * Gumbel noise) of an id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "doc_id long, n_features long, weight long, score long, enough boolean"


def scored(docs: DataFrame, gain: np.ndarray, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, enough) of each document; enough: it has ``least`` words."""

    def rows(batches):
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            n, weight, words = (np.zeros(len(ids), np.int64) for _ in range(3))
            for i, j, data, offsets in chunks(b.column("text")):
                bucket, doc, words[i:j] = features(data, offsets, len(gain))
                n[i:j] = np.bincount(doc, minlength=j - i)
                order = np.argsort(doc, kind="stable")
                sums = np.concatenate(([0], np.cumsum(gain[bucket[order]])))
                weight[i:j] = np.diff(sums[np.concatenate(([0], np.cumsum(n[i:j])))])
            score = weight + np.fromiter((noise(d, seed) for d in ids), np.int64, len(ids))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(weight), pa.array(score), pa.array(words >= least)], [f.split()[0] for f in SCORED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, SCORED)


def above(key: tuple[int, int | None] | None) -> Column:
    """Whether a row comes before the key: a higher score, or the same and a smaller id, none being the largest."""
    if key is None:
        return F.lit(True)
    score, doc = key
    same = F.col("doc_id").isNotNull() if doc is None else F.col("doc_id") < F.lit(doc)
    return (F.col("score") > F.lit(score)) | ((F.col("score") == F.lit(score)) & F.coalesce(same, F.lit(False)))


def at_key(key: tuple[int, int | None]) -> Column:
    return (F.col("score") == F.lit(key[0])) & F.col("doc_id").eqNullSafe(F.lit(key[1]))


def kth_key(rows: DataFrame, k: int, seed: int = SEED) -> tuple[int, int | None]:
    """The k-th key of rows (score, doc_id), k from 1 and at most their number; rows should be a written table.

    Of each pass PIVOTS keys come to the driver and the exact number of rows in each of the ranges
    between them, and at each of them.
    """
    low, high, before, turn = None, None, 0, 0  # the key lies behind low and before high; rows up to and with low
    while True:
        turn += 1
        open_ = rows.where(above(high))
        if low is not None:
            open_ = open_.where(~above(low) & ~at_key(low))
        # random keys: those with the smallest hashes of this turn
        picks = open_.select("score", "doc_id").orderBy(F.xxhash64(F.lit(seed + turn), "score", "doc_id")).limit(PIVOTS).collect()
        pivots = sorted({(r["score"], r["doc_id"]) for r in picks}, key=lambda p: (-p[0], p[1] is None, p[1] or 0))
        passed, counts = before, open_.agg(*(F.count_if(c).alias(f"{n}{i}") for i, p in enumerate(pivots) for n, c in (("a", above(p)), ("e", at_key(p))))).head()
        for i, p in enumerate(pivots):
            up_to = before + counts[f"a{i}"]
            if up_to >= k:
                high = p
                break
            if up_to + counts[f"e{i}"] >= k:
                return p
            low, passed = p, up_to + counts[f"e{i}"]
        before = passed


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs (doc_id, text); target has text.

    Of the N documents with ``least`` words the floor(percent * N / 100) highest scores are drawn and ranked from 1,
    ties by doc_id, rows without an id last; the rank of others is null. Null and empty texts have no features and weight 0.
    Rows that repeat an id are documents each; where they tie in score too, the one with fewer features goes first. Very long
    texts are read whole, an empty table gives an empty result, an empty target one in which all features are rarer than
    expected; other columns are ignored.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    rows = checkpoint(scored(docs, gain, least, seed))
    columns = ["doc_id", "n_features", "weight", "score"]
    k = percent * rows.where("enough").count() // 100
    if not k:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    key = kth_key(rows.where("enough"), k, seed)
    drawn = F.col("enough") & (above(key) | at_key(key))
    order = rows.where(drawn).select(*columns, (-F.col("score")).alias("by"), F.col("doc_id").isNull().alias("last"))
    ranked = in_order(order, "by", "last", "doc_id", "n_features", "weight").select(*columns, F.when(F.col("at") < k, F.col("at") + 1).alias("rank"))
    return rows.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")).union(ranked)


def oracle_sql(buckets: int = BUCKETS, least: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> str:
    words = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    grams = lambda t: " UNION ALL ".join(f"SELECT r, {g} AS g FROM {t} WHERE {last} IS NOT NULL" for g, last in (("a", "a"), ("a || ' ' || b", "b"), ("a || ' ' || b || ' ' || c", "c")))
    placed = "SELECT r, a, lead(a) OVER p AS b, lead(a, 2) OVER p AS c FROM (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM {}) WINDOW p AS (PARTITION BY r ORDER BY i)"
    return f"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, {words.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT row_number() OVER () AS r, {words.format("coalesce(text, '')")} AS w FROM benchmark),
dw AS ({placed.format("d")}),
bw AS ({placed.format("b")}),
f AS ({grams("dw")}),
u AS ({grams("bw")}),
h AS (SELECT g, {crc32_sql("g")} % {buckets} AS k FROM (SELECT g FROM f UNION SELECT g FROM u), crc),
s AS (SELECT k, count(*) AS n FROM f JOIN h USING (g) GROUP BY k),
t AS (SELECT k, count(*) AS n FROM u JOIN h USING (g) GROUP BY k),
c AS (SELECT h.k, coalesce(any_value(s.n), 0) AS s, coalesce(any_value(t.n), 0) AS t FROM h LEFT JOIN s ON s.k = h.k LEFT JOIN t ON t.k = h.k GROUP BY h.k),
gain AS (SELECT k, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {buckets})::DOUBLE / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {buckets})::DOUBLE)))::BIGINT AS gain FROM c),
w AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN h USING (g) JOIN gain USING (k) GROUP BY r),
o AS (SELECT r, doc_id, len(w) AS words, (('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM d),
e AS (SELECT doc_id, words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln(u)))::BIGINT AS score FROM o LEFT JOIN w USING (r)),
p AS (SELECT *, row_number() OVER (PARTITION BY words >= {least} ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER (PARTITION BY words >= {least}) AS n FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= {least} AND place <= {percent} * n // 100 THEN place END AS rank FROM p
"""
