"""MinHash near-duplicates by an inverted join of signature coordinates.

A document's set is its distinct word shingles. The top bits of a shingle's hash name one of
``COORDINATES`` coordinates, and the smallest hash in each is the signature's value there, so a
hash is a coordinate-value pair. Documents are posted under their pairs; documents with equal
sets count as one throughout.

Two sets with a Jaccard similarity of the threshold differ in more than ``slack()`` of their
coordinates with a chance under 1e-6 (in short documents never). So a document needs a list with
another document under 1 - slack of its pairs, and each pair of documents that links shares one
of the slack + 1 pairs that come first when pairs are ordered by the length of their lists: only
those prefixes are merged, the longest lists are skipped.

First each document is held against one leader, the document that most of its prefix lists
name as having the most company. Lists whose documents are connected then need no more work.
In the others, documents of different components are compared, in blocks of about ``BLOCK``
shingles: an inverted join of the signatures in the block counts in how many coordinates two
documents collide, pairs with fewer collisions than a link can have are passed over, and what
is left is confirmed on the full sets, in the first list that both share. Pairs that links of the
block have connected are not looked at again, so a large group of copies costs a row for each copy.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.llm.common import checkpoint, chunks, components, shingle_hashes, shingles_of, span_hashes, word_sequences, word_spans

COORDINATES = 64
BLOCK = 300_000
_EDGES = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(64 - COORDINATES.bit_length() + 1)


def slack(threshold: int) -> float:
    """The share of coordinates in which sets at the threshold may differ: the mean and five deviations."""
    j = threshold / 100
    return min(1.0, 1 - j + 5 * (j * (1 - j) / COORDINATES) ** 0.5)


def sets_of(column: pa.Array, width: int):
    """(row, sorted distinct shingle hashes) of each text that has words."""
    for i, j, data, offsets in chunks(column):
        starts, ends, docs = word_spans(data, offsets)
        if not len(starts):
            continue
        h, d = shingle_hashes(span_hashes(data, starts, ends), docs, j - i, width)
        cut = np.searchsorted(d, np.arange(j - i + 1))
        for k in np.flatnonzero(np.diff(cut)).tolist():
            yield i + k, np.unique(h[cut[k] : cut[k + 1]])


def signature(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash of each coordinate that has one, of sorted hashes."""
    at = np.searchsorted(hashes, _EDGES)
    end = np.append(at[1:], len(hashes))
    return hashes[at[at < end]]


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, digest, sig): set size, digest of the set (null if empty) and signature of each row."""

    def rows(batches):
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            digest: list[bytes | None] = [None] * b.num_rows
            sig: list[np.ndarray | None] = [None] * b.num_rows
            for k, s in sets_of(b.column("text"), width):
                n[k], digest[k], sig[k] = len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), signature(s).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(digest, pa.binary()), pa.array(sig, pa.list_(pa.int64()))], ["doc_id", "n", "digest", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, n long, digest binary, sig array<long>")


def linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    """Whether 100 * intersection >= threshold * union of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < threshold * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= threshold * (len(a) + len(b) - both)


def set_of(items: bytes, width: int) -> np.ndarray:
    """The sorted distinct shingles of a text's word_sequences() row."""
    return np.unique(shingles_of(items, width))


def _confirm(width: int, threshold: int):
    def rows(batches):
        for b in batches:
            ok, last = np.zeros(b.num_rows, bool), (b"", np.zeros(0, np.uint64))
            for k, (x, y) in enumerate(zip(b.column("x"), b.column("y"), strict=True)):
                if last[0] != (y := y.as_py()):  # rows come by leader
                    last = y, set_of(y, width)
                ok[k] = linked(set_of(x.as_py(), width), last[1], threshold)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok))], ["a", "b"])

    return rows


class Postings:
    """Sets of a block, for the intersection of one set with all of them at once."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(s) for s in sets])
        items = np.concatenate(sets)
        order = np.argsort(items, kind="stable")
        self.items, self.owner = items[order], np.repeat(np.arange(len(sets), dtype=np.int32), self.size)[order]

    def common(self, s: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.items, s), np.searchsorted(self.items, s, side="right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.size))


def collisions_needed(coordinates: int, threshold: int) -> int:
    """The least number of coordinates, of those a set has, in which it collides with a set that it links with."""
    return max(1, int(np.ceil((1 - slack(threshold)) * coordinates - 1e-9)))


def block_links(ids, comp, side, sets, prefixes, key: int, same: bool, threshold: int) -> list[tuple[int, int]]:
    """Links that connect components of one block pair of a list.

    side is 0 or 1, the block of each document; with same, both blocks are one. Documents of the
    largest component are not held against each other.
    """
    signs = [signature(s) for s in sets]
    posts, label = Postings(signs), comp.copy()
    need = np.array([collisions_needed(len(s), threshold) for s in signs])
    values, counts = np.unique(comp, return_counts=True)
    rows = np.flatnonzero(comp != values[counts.argmax()])
    order: list[dict[int, int] | None] = [None] * len(ids)
    out = []
    for i in rows.tolist():
        ok = (posts.common(signs[i]) >= np.maximum(need, need[i])) & (label != label[i])
        if not same:
            ok &= side != side[i]
        for j in np.flatnonzero(ok).tolist():
            if label[j] == label[i]:
                continue
            for k in (i, j):
                if order[k] is None:
                    order[k] = dict.fromkeys(prefixes[k], 0)
            if next((k for k in order[i] if k in order[j]), key) != key or not linked(sets[i], sets[j], threshold):
                continue  # confirmed in the first list that they share
            low, high = min(label[i], label[j]), max(label[i], label[j])
            label[label == high] = low
            out.append((int(ids[i]), int(ids[j])))
    return out


def near_duplicates(docs: DataFrame, width: int = 3, threshold: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs (doc_id, text).

    Texts without words, and null ones, have empty sets and link with nothing; a text of fewer
    words than ``width`` is one shingle. Rows that repeat an id count as one document. Rows
    without an id are linked with nothing and have no component. An empty table gives an empty
    result. Other columns are ignored.
    """
    rows = checkpoint(signatures(docs, width))
    classes = rows.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = rows.join(classes.withColumnRenamed("rep", "doc_id"), ["digest", "doc_id"]).select("doc_id", "digest", "n", "sig").dropDuplicates(["doc_id", "digest"])

    # posts; documents alone under too many of their pairs have no near-duplicate
    posts = reps.select("doc_id", "n", F.size("sig").alias("m"), F.explode("sig").alias("key"))
    lists = posts.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    need = F.greatest(F.ceil((1 - slack(threshold)) * F.col("m") - 1e-9), F.lit(1))
    own = posts.join(lists, "key").groupBy("doc_id", "n", "m").agg(F.collect_list(F.struct("c", "key")).alias("ks"), F.sum("c").alias("w")).where(F.size("ks") >= need)
    prefix = checkpoint(own.select("doc_id", "n", "w", F.transform(F.slice(F.sort_array("ks"), F.lit(1), (F.size("ks") - need + 1).cast("int")), lambda k: k["key"]).alias("keys")))

    # one leader for each document
    member = prefix.select("doc_id", "w", F.explode("keys").alias("key"))
    leads = member.groupBy("key").agg(F.max(F.struct("w", F.negate("doc_id").alias("d"))).alias("top"), F.count("*").alias("c")).where("c > 1").select("key", F.negate("top.d").alias("leader"))
    votes = member.join(leads, "key").where("leader <> doc_id").groupBy("doc_id", "leader").agg(F.count("*").alias("v"))
    pairs = checkpoint(votes.groupBy("doc_id").agg(F.max(F.struct("v", F.negate("leader").alias("d"))).alias("top")).select(F.col("doc_id").alias("a"), F.negate("top.d").alias("b")))
    mixed_ids = member.join(leads.select("key"), "key").select("doc_id").distinct()
    items = word_sequences(docs, mixed_ids)
    x, y = items.withColumnsRenamed({"doc_id": "a", "items": "x"}), items.withColumnsRenamed({"doc_id": "b", "items": "y"})
    first = checkpoint(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_confirm(width, threshold), "a long, b long"))

    # lists that still hold several components
    comp = components(first)
    seen = checkpoint(prefix.join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "n", "keys", F.coalesce("component", "doc_id").alias("comp")))
    place = seen.select("doc_id", "n", "comp", F.explode("keys").alias("key"))
    mixed = place.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum(F.col("n") + COORDINATES).alias("n")).where("lo <> hi").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    spread = (
        place.join(mixed, "key")
        .withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "doc_id", "comp")
    )
    full = spread.join(seen.select("doc_id", "keys"), "doc_id").join(items, "doc_id")

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("comp", "ascending"), ("doc_id", "ascending")])
        sets = [set_of(s, width) for s in t.column("items").to_pylist()]
        k, i, j = (x.as_py() for x in key)
        got = block_links(t.column("doc_id").to_numpy(), t.column("comp").to_numpy().copy(), t.column("side").to_numpy(), sets, t.column("keys").to_pylist(), k, i == j, threshold)
        return pa.table({"a": pa.array([g[0] for g in got], pa.int64()), "b": pa.array([g[1] for g in got], pa.int64())})

    second = checkpoint(full.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long"))
    joined = components(first.union(second))
    class_comp = classes.join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("class_component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id")).alias("component_id")
    return rows.drop("sig").join(class_comp, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), component).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, width: int = 3, threshold: int = 85) -> DataFrame:
    """The rows of docs, with all columns, of the smallest id of each component; rows without an id stay.

    Of rows with one id and one text one stays (if their other columns differ, either); an id
    that has several texts keeps them all or none.
    """
    kept = near_duplicates(docs.select("doc_id", "text"), width, threshold).where("kept and doc_id is not null").select("doc_id").distinct()
    row = F.struct(*(f"`{c}`" for c in docs.columns)).alias("row")  # columns of any names
    rows = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), row)
    return rows.join(kept, "doc_id").dropDuplicates(["doc_id", "k1", "k2"]).select("row.*").union(docs.where("doc_id is null"))
