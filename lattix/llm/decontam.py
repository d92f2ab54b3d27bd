"""Benchmark decontamination by spaced-seed hashing.

Words are runs of ASCII letters, digits and other characters, without punctuation, A-Z folded.
A seed is the hash of five words at the places of a fixed mask; what stands at the other places
does not matter, so a seed survives substituted words. Items of up to ``SHORT`` words have seeds of
another kind: they are cut into one piece more than words may differ, so that a piece is always
whole. Seeds of the texts are joined with those of the benchmark. Around each hit, text and item are laid side by side on the hit's diagonal,
and the hit counts if ``window`` words in a row (the whole item if it is shorter) are equal in
at least ``share`` of the places.

The benchmark is measured first. Up to ``most`` words it is sent to all tasks, which bounds the
broadcast, and the texts are read once, without a shuffle. Beyond that, texts are filtered by a
Bloom filter of fixed size, and the seeds that pass are joined with those of the benchmark on
their hashes. They only say where an item may lie in a text; the texts and items they name are
then joined whole and compared as with an index, so results do not depend on the path.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattix.llm.common import PUNCTUATION, bloom, bloom_of, bloom_of_ids, checkpoint, chunks, may_hold, mix, passes, span_hashes, word_spans

#: Places of the words that make a seed.
MASKS = ((0, 1, 2, 3, 5), (0, 1, 3, 5, 6), (0, 2, 3, 6, 8))
WINDOW = 13
SHARE = 0.8
#: Words of an item that is cut into pieces, and looked for whole.
SHORT = 12
MOST_WORDS = 200_000
HIT = "array<struct<item_id:long,start:long,words:long,matches:long>>"
_HIT = pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("words", pa.int64()), ("matches", pa.int64())])


def words_of(column: pa.Array):
    """(first row, end row, word hashes, offsets of each text's words) of a column, chunk by chunk."""
    for i, j, data, offsets in chunks(column):
        starts, ends, docs = word_spans(data, offsets, PUNCTUATION)
        hashes = span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        yield i, j, hashes, np.searchsorted(docs, np.arange(j - i + 1))


def words_in(text: str) -> np.ndarray:
    """The word hashes of one text."""
    return np.concatenate([np.zeros(0, np.uint64), *(w for _, _, w, _ in words_of(pa.array([text], pa.string())))])


def seeds(words: np.ndarray, cut: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the mask's seeds, and the places where they start; none crosses texts."""
    span = mask[-1] + 1
    n = len(words) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(n, len(mask) * 1000 + sum(m * m for m in mask), np.uint64)
    for k, m in enumerate(mask):
        h += words[m : m + n] * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x632BE59BD9B4E019 & (2**64 - 1))
    at = np.arange(n)
    inside = at + span <= cut[np.searchsorted(cut, at, side="right")] if n else at
    return mix(h)[inside], at[inside]


def pieces(n: int, share: float) -> list[tuple[int, int]]:
    """(first word, words) of the pieces of an item of n words, of which one is whole in whatever overlaps it; none of longer items."""
    if not 0 < n <= SHORT:
        return []
    parts = min(n, int((1 - share) * n + 1e-9) + 1)
    cut = [n * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]


def piece_seeds(words: np.ndarray, cut: np.ndarray, share: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By their number of words the seeds of the items' pieces, and their places."""
    starts: dict[int, list[int]] = {}
    for a, b in zip(cut.tolist(), cut[1:].tolist(), strict=False):
        for first, size in pieces(b - a, share):
            starts.setdefault(size, []).append(a + first)
    out = {}
    for size, at in starts.items():
        h, place = seeds(words, cut, tuple(range(size)))
        own = np.searchsorted(place, at)
        out[size] = h[own], place[own]
    return out


def aligned(text: np.ndarray, item: np.ndarray, shift: int, window: int, share: float) -> tuple[int, int, int] | None:
    """(first place in the text, words, equal words) of the item laid at place shift of the text, or None if too few are equal."""
    lo, hi = max(0, -shift), min(len(item), len(text) - shift)
    w = min(window, len(item))
    if hi - lo < w or w == 0:
        return None
    same = text[shift + lo : shift + hi] == item[lo:hi]
    sums = np.concatenate(([0], np.cumsum(same)))
    if (sums[w:] - sums[:-w]).max() < share * w:
        return None
    at = np.flatnonzero(same)
    return shift + lo + int(at[0]), int(at[-1] - at[0] + 1), int(len(at))


def better(got: tuple[int, int, int], than: tuple[int, int, int] | None) -> bool:
    """Whether an alignment has more equal words than another, or else comes first, or else is longer."""
    return than is None or (got[2], -got[0], got[1]) > (than[2], -than[0], than[1])


class Index:
    """The benchmark's words and seeds, for lookups by seed."""

    def __init__(self, ids: list[int], items: list[np.ndarray], share: float = SHARE) -> None:
        self.ids, self.items = ids, items
        size = np.array([len(x) for x in items], dtype=np.int64)
        words = np.concatenate(items) if items else np.zeros(0, np.uint64)
        cut = np.concatenate(([0], np.cumsum(size)))
        self.seeds, self.item, self.place = [], [], []
        short = piece_seeds(words, cut, share)
        self.masks = [*MASKS, *(tuple(range(n)) for n in short)]
        for h, at in [*(seeds(words, cut, mask) for mask in MASKS), *short.values()]:
            order = np.argsort(h, kind="stable")
            item = np.searchsorted(cut, at[order], side="right") - 1
            self.seeds.append(h[order])
            self.item.append(item)
            self.place.append(at[order] - cut[item])
        self.bloom = bloom(np.concatenate(self.seeds) if items else np.zeros(0, np.uint64))

    def find(self, words: np.ndarray, cut: np.ndarray, window: int, share: float) -> dict[int, dict[int, tuple[int, int, int]]]:
        """The best alignment of each item with each text of a chunk that it overlaps."""
        found: dict[int, dict[int, tuple[int, int, int]]] = {}
        tried: set[tuple[int, int, int]] = set()
        for k, mask in enumerate(self.masks):
            h, at = seeds(words, cut, mask)
            maybe = np.flatnonzero(passes(self.bloom, h))
            h, at = h[maybe], at[maybe]
            lo, hi = np.searchsorted(self.seeds[k], h), np.searchsorted(self.seeds[k], h, side="right")
            for a, b, p in zip(lo[lo < hi].tolist(), hi[lo < hi].tolist(), at[lo < hi].tolist(), strict=True):
                doc = int(np.searchsorted(cut, p, side="right")) - 1
                for item, place in zip(self.item[k][a:b].tolist(), self.place[k][a:b].tolist(), strict=True):
                    shift = p - int(cut[doc]) - place
                    if (doc, item, shift) not in tried:
                        tried.add((doc, item, shift))
                        got = aligned(words[cut[doc] : cut[doc + 1]], self.items[item], shift, window, share)
                        if got and better(got, found.get(doc, {}).get(item)):
                            found.setdefault(doc, {})[item] = got
        return found


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")


def load(benchmark: DataFrame, most: int = MOST_WORDS, share: float = SHARE) -> Index | None:
    """The benchmark as an index, or None if it has more than ``most`` words."""
    items = _items(benchmark)
    size = items.agg(F.sum(F.length("text")).alias("n"), F.count("*").alias("items")).first()
    if (size["n"] or 0) > 8 * most or size["items"] > most:
        return None
    rows = items.orderBy("item_id").collect()  # bounded by ``most``
    column = pa.array([r["text"] for r in rows], pa.string())
    words = [w[c[k] : c[k + 1]] for _, _, w, c in words_of(column) for k in range(len(c) - 1)]
    return Index([r["item_id"] for r in rows], words, share)


def overlaps(text: Column, index: Index, window: int = WINDOW, share: float = SHARE) -> Column:
    """array<struct<item_id, start, words, matches>> of each text, by item; null counts as empty."""

    @F.arrow_udf(HIT)
    def hits(column: pa.Array) -> pa.Array:
        out: list[list] = [[] for _ in range(len(column))]
        for i, _, words, cut in words_of(column):
            for doc, items in index.find(words, cut, window, share).items():
                out[i + doc] = [{"item_id": index.ids[k], "start": s, "words": n, "matches": m} for k, (s, n, m) in sorted(items.items())]
        return pa.array(out, pa.list_(_HIT))

    return hits(text)


def _keys(df: DataFrame, a: str, b: str) -> DataFrame:
    """df with two hashes that stand for its text."""
    return df.withColumn(a, F.xxhash64("text")).withColumn(b, F.xxhash64(F.lit(1), "text"))


def _joined(docs: DataFrame, benchmark: DataFrame, window: int, share: float) -> DataFrame:
    """(_k1, _k2, item_id, start, words, matches): the hits of each text by its _keys(), by a join on seeds, for a benchmark of any size.

    Equal texts and equal items are compared once; an item has a hit for each of its rows.
    """
    items = _keys(_items(benchmark), "i1", "i2")
    texts = _keys(docs.select("text").where("text is not null"), "_k1", "_k2")

    def own_seeds(words: np.ndarray, cut: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """All seeds of items."""
        return [*(seeds(words, cut, mask) for mask in MASKS), *piece_seeds(words, cut, share).values()]

    def sizes(batches):
        for b in batches:
            n = {n for _, _, _, cut in words_of(b.column("text")) for k in np.diff(cut).tolist() for _, n in pieces(k, share)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(n), pa.int32())], ["n"])

    lengths = [r["n"] for r in items.select("text").mapInArrow(sizes, "n int").distinct().collect()]  # SHORT at most
    masks = [*MASKS, *(tuple(range(n)) for n in sorted(lengths))]

    def spread(packed: np.ndarray | None):
        def rows(batches):
            for b in batches:
                one, two = (b.column(c).to_numpy() for c in (1, 2))
                s, own, place = [], [], []
                for i, _, words, cut in words_of(b.column("text")):
                    for h, at in own_seeds(words, cut) if packed is None else (seeds(words, cut, mask) for mask in masks):
                        if packed is not None:
                            ok = passes(packed, h)
                            h, at = h[ok], at[ok]
                        doc = np.searchsorted(cut, at, side="right") - 1
                        s.append(h.view(np.int64))
                        own.append(i + doc)
                        place.append(at - cut[doc])
                s, own, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (s, own, place))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (s, one[own], two[own], place)], ["seed", "a", "b", "place"])

        return rows

    kind = "seed long, a long, b long, place long"

    def hashed(batches):
        for b in batches:
            for _, _, words, cut in words_of(b.column("text")):
                yield np.concatenate([h for h, _ in own_seeds(words, cut)])

    packed = bloom_of(items.select("text"), hashed)
    test = items.select("text", "i1", "i2").mapInArrow(spread(None), kind).select("seed", F.col("a").alias("i1"), F.col("b").alias("i2"), F.col("place").alias("item_at")).distinct()
    text = texts.mapInArrow(spread(packed), kind).select("seed", F.col("a").alias("_k1"), F.col("b").alias("_k2"), "place").distinct()
    tries = checkpoint(text.join(test, "seed").groupBy("_k1", "_k2", "i1", "i2").agg(F.collect_set(F.col("place") - F.col("item_at")).alias("shifts")))

    named = bloom_of_ids(tries.select("_k1"), "_k1")  # the other texts are left where they are read

    def held(batches):
        for b in batches:
            yield b.filter(pa.array(may_hold(named, b.column("_k1").to_numpy())))

    whole = texts.mapInArrow(held, texts.schema).dropDuplicates(["_k1", "_k2"])
    laid = tries.join(items.select("i1", "i2", F.col("text").alias("item")).dropDuplicates(["i1", "i2"]), ["i1", "i2"]).join(whole, ["_k1", "_k2"])

    def verify(batches):
        for b in batches:
            at, best = [], []
            last: tuple[str, np.ndarray] | None = None
            for k in range(b.num_rows):
                text, item = b.column("text")[k].as_py(), b.column("item")[k].as_py()
                if last is None or last[0] != text:
                    last = text, words_in(text)
                own, found = words_in(item), None
                for shift in b.column("shifts")[k].as_py():
                    got = aligned(last[1], own, shift, window, share)
                    if got and better(got, found):
                        found = got
                if found:
                    at.append(k)
                    best.append(found)
            keys = [b.column(c).take(pa.array(at, pa.int64())) for c in ("_k1", "_k2", "i1", "i2")]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array([x[k] for x in best], pa.int64()) for k in range(3))], ["_k1", "_k2", "i1", "i2", "start", "words", "matches"])

    found = laid.select("_k1", "_k2", "i1", "i2", "shifts", "text", "item").mapInArrow(verify, "_k1 long, _k2 long, i1 long, i2 long, start long, words long, matches long")
    return found.join(items.select("item_id", "i1", "i2"), ["i1", "i2"]).select("_k1", "_k2", "item_id", "start", "words", "matches")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, most: int = MOST_WORDS) -> DataFrame:
    """(doc_id, item_id, start, words, matches) of each document and benchmark item that overlap.

    start is the first equal word in the text, words reaches to the last, matches are equal.
    An item of fewer than ``window`` words overlaps where it is laid whole. Items without words, or
    without an id, match nothing; null texts hold nothing; an item repeated in the benchmark is found under each of its ids, a repeated document row once for each row.
    With a benchmark or documents empty the result is empty. Other columns are ignored.
    """
    index = load(benchmark, most, share)
    if index is None:
        own = _keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null"), "_k1", "_k2").drop("text")
        return own.join(_joined(docs, benchmark, window, share), ["_k1", "_k2"]).select("doc_id", "item_id", "start", "words", "matches")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(overlaps(F.col("text"), index, window, share)).alias("hit"))
    return found.select("doc_id", "hit.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, most: int = MOST_WORDS) -> DataFrame:
    """The rows of docs that no benchmark item overlaps, with all their columns."""
    index = load(benchmark, most, share)
    if index is None:
        hit = _joined(docs, benchmark, window, share).select("_k1", "_k2").distinct()
        own = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), "text")  # columns of any names
        return _keys(own, "_k1", "_k2").join(hit, ["_k1", "_k2"], "left_anti").select("row.*")
    return docs.where(F.size(overlaps(F.col("text"), index, window, share)) == 0)
