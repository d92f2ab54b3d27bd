"""Near-duplicate passages by compact windows.

Tokens are shingles of five words. Under a hash function, the subsequences of a text whose
smallest hash is at one place c form a compact window (l, c, r): all [x, y] with l <= x <= c <=
y <= r; they are the nodes of the Cartesian tree over the hashes. The windows of ``FUNCTIONS``
functions are intersected: subsequences of ``SPAN`` tokens with the same smallest tokens under
all of them, at the same distance, are one group, posted under that signature. About
``2 * FUNCTIONS / SPAN`` groups are posted for each token.

Passages of ``words`` words or more with a Jaccard similarity of 0.8 have room for few edits: an
edit takes at least four shingles of either side, so the longest stretch that both have without
an edit is ``SPAN`` tokens or more (20 of 46; more in longer ones). Equal stretches have equal
signatures under every function, so such passages always meet in a list.

1. Signatures that one text alone has are dropped; equal texts count as one throughout.
2. Each text is held against the first text of each of its lists: an interval join of the
   groups of both gives the hull of what they share, the words of the hull are cut out on both
   sides and passages in them are verified on the shingles.
3. Groups whose place no passage shared with the first text of their list covers are open. In
   lists of up to ``FEW`` places every open one is held against all others.
4. In longer lists, in which all can be copies of one passage with edits of their own, the words
   around each place are cut out, and the shingles counted that another text has there as well.
   Passages of ``words`` words around a place whose shingles are all in company, but for those
   that one edit at one place takes, are posted under the digest of their other words, for each
   place of the edit: of no, one or two words. Texts with such a digest are alike in pairs, so
   each open one is held against one of them, and which does not matter.
5. Open places of longer lists that can lie in a passage, by the shingles around them that are in
   company, are then held against all such places of the list, in pairs of blocks of ``BLOCK``:
   where shingles of one are in the other is laid out, and pairs with a stretch that may be a passage
   are verified, unless links of the block pair connect them already.

So links between members of a list are given, or both are connected by links in that list,
whatever its length: a large group of near copies costs rows for each of them, not for their
pairs. The time of step 5 grows with the open places of a list times its places.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattix.llm.common import bloom_of_ids, checkpoint, chunks, may_hold, mix, parts as tasks, powers, shingle_hashes, shingles_of, span_hashes, word_sequences, word_spans

WIDTH = 5
WORDS = 50
SIMILARITY = 0.8
FUNCTIONS = 2
SPAN = 20
FEW = 32
#: Places of a long list that are held against as many others in one group.
BLOCK = 1000
SLICE = 1 << 20
_PLACE = np.uint64((1 << 24) - 1)
_SEED = [np.uint64(0xA0761D6478BD642F * (2 * k + 1) & (2**64 - 1)) for k in range(FUNCTIONS)]
_B = 0x9E3779B97F4A7C15
PASSAGE = "doc_id long, start long, words long, other_id long, other_start long, other_words long, similarity double"


def hashed(tokens: np.ndarray, fn: int) -> np.ndarray:
    return mix(tokens ^ _SEED[fn])


def _slide(x: np.ndarray, t: int, op) -> np.ndarray:
    """op over x[i : i + t] for each i."""
    size = 1
    while size * 2 <= t:
        x = op(x[: len(x) - size], x[size:])
        size *= 2
    return op(x[: len(x) - (t - size)], x[t - size :]) if t > size else x


def compact_windows(h: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the compact windows of width t or more of one text, by c: the wide nodes of its Cartesian tree.

    Of equal hashes the leftmost is the smaller.
    """
    c = np.unique(smallest(h, t)).tolist()
    left, right, stack = [0] * len(c), [len(h) - 1] * len(c), []
    v = h[c].tolist()
    for k, p in enumerate(c):  # what bounds a wide node is a wide node itself
        while stack and v[stack[-1]] > v[k]:
            right[stack.pop()] = p - 1
        left[k] = c[stack[-1]] + 1 if stack else 0
        stack.append(k)
    return np.array(left, np.int64), np.array(c, np.int64), np.array(right, np.int64)


def smallest(h: np.ndarray, t: int) -> np.ndarray:
    """The place of the smallest of h[i : i + t] for each i, the leftmost in a tie: the Cartesian tree's node over them."""
    out = []
    for at in range(0, max(0, len(h) - t + 1), SLICE):
        part = h[at : at + SLICE + t - 1]
        key = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64)
        out.append((_slide(key, t, np.minimum) & _PLACE).astype(np.int64) + at)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def groups(tokens: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, text, place of its first function's token) of the groups of SPAN tokens; docs names each token's text."""
    n = len(tokens) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = [hashed(tokens, fn) for fn in range(FUNCTIONS)]
    c = [smallest(h, SPAN) for h in x]
    inside = docs[:n] == docs[SPAN - 1 :]
    new = np.ones(n, bool)
    new[1:] = ~inside[:-1]
    for p in c:
        new[1:] |= p[1:] != p[:-1]
    first = np.flatnonzero(new & inside)
    sign = np.zeros(len(first), np.uint64)
    for h, p in zip(x, c, strict=True):
        sign = mix(sign + h[p[first]] + (p[first] - c[0][first]).astype(np.uint64) * np.uint64(_B))
    return sign, docs[first], c[0][first]


def _tokens(column: pa.Array):
    """(first row, shingle hashes, their texts, where each text begins) of the texts with as many words as a shingle, by chunks."""
    for i, j, data, offsets in chunks(column):
        starts, ends, docs = word_spans(data, offsets)
        counts = np.bincount(docs, minlength=j - i)
        if not len(starts):
            continue
        h, d = shingle_hashes(span_hashes(data, starts, ends) >> np.uint64(32), docs, j - i, WIDTH)  # as shingles_of() has them
        long = counts[d] >= WIDTH
        h, d = h[long], d[long]
        yield i, h, d, np.searchsorted(d, np.arange(j - i + 1))


def posts(docs: DataFrame, t: int) -> DataFrame:
    """(doc_id, n, digest, keys, places) of each text of at least t shingles: their number, a digest of their sequence, its groups.

    Of a group that a text repeats within SPAN tokens one place is given.
    """

    def rows(batches):
        for b in batches:
            out: list[tuple] = []
            ids = b.column("doc_id").to_pylist()
            for i, h, d, cut in _tokens(b.column("text")):
                if not len(h):
                    continue
                sign, doc, place = groups(h, d)
                place = place - cut[doc]
                order = np.lexsort((place, sign, doc))
                sign, doc, place = sign[order], doc[order], place[order]
                keep = np.ones(len(sign), bool)
                keep[1:] = (sign[1:] != sign[:-1]) | (doc[1:] != doc[:-1]) | (place[1:] // SPAN != place[:-1] // SPAN)
                sign, place, edge = sign[keep].view(np.int64), place[keep].astype(np.int32), np.searchsorted(doc[keep], np.arange(len(cut)))
                for k in np.flatnonzero(np.diff(cut) >= t).tolist():
                    digest = hashlib.blake2b(h[cut[k] : cut[k + 1]].tobytes(), digest_size=16).digest()
                    out.append((ids[i + k], int(cut[k + 1] - cut[k]), digest, sign[edge[k] : edge[k + 1]], place[edge[k] : edge[k + 1]]))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], ["doc_id", "n", "digest", "keys", "places"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return texts.mapInArrow(rows, "doc_id long, n long, digest binary, keys array<long>, places array<int>")


def stretches(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of the stretches of one shingle again and again; most are one long."""
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(a)))


def distinct(a: np.ndarray) -> np.ndarray:
    """The values of a in order, each once; for few of them, sorting takes a tenth of the time of numpy's hashing."""
    a = np.sort(a)
    new = np.ones(len(a), bool)
    np.not_equal(a[1:], a[:-1], out=new[1:])
    return a[new]


def holds(values: np.ndarray, x: np.uint64) -> bool:
    """Whether x is among values, which are in order."""
    k = values.searchsorted(x)
    return bool(k < len(values) and values[k] == x)


class Side:
    """A text as partner: its shingles in order of value."""

    def __init__(self, b: np.ndarray) -> None:
        self.b = b
        self.ranked = np.sort(b)

    @cached_property
    def once(self) -> bool:
        """Whether no shingle repeats."""
        return bool((self.ranked[1:] != self.ranked[:-1]).all())

    @cached_property
    def order(self) -> np.ndarray:
        return np.argsort(self.b)

    @cached_property
    def laid_out(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First place, length and shingle of its stretches, in order of the shingle."""
        first, size = stretches(self.b)
        order = np.argsort(self.b[first], kind="stable")
        return first[order], size[order], self.b[first[order]]


def longest(same: np.ndarray, share: float) -> tuple[int, int]:
    """The longest stretch in which at least ``share`` is true."""
    s = np.concatenate(([0.0], np.cumsum(same - share)))
    low = np.minimum.accumulate(s)
    high = np.maximum.accumulate(s[::-1])[::-1]
    # for each start at a new low, the last place that is no lower
    starts = np.flatnonzero(np.concatenate(([True], s[1:] < low[:-1])))
    ends = np.searchsorted(-high, -s[starts] + 1e-12, side="right") - 1
    k = int((ends - starts).argmax())
    return int(starts[k]), int(ends[k])


def runs_of(a: np.ndarray, other: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, start in b) of the longest runs of equal shingles of a and b, by start; each place in a meets all in b.

    Stretches of one repeated shingle are laid beginning on beginning and end on end only.
    """
    if other.once:  # a shingle of a has one place in b or none
        k = np.minimum(other.ranked.searchsorted(a), len(other.ranked) - 1)
        p = np.flatnonzero(other.ranked[k] == a)
        q = other.order[k[p]]
        head = np.flatnonzero(np.concatenate(([True], (q[1:] != q[:-1] + 1) | (p[1:] != p[:-1] + 1)))[: len(p)])
        tail = np.append(head[1:], len(p)) - 1 if len(p) else head
        return p[head], p[tail] + 1, q[head]
    first, size = stretches(a)
    of_first, of_size, values = other.laid_out
    low, high = np.searchsorted(values, a[first]), np.searchsorted(values, a[first], side="right")
    many = high - low
    at = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
    x, m, y, n = np.repeat(first, many), np.repeat(size, many), of_first[at], of_size[at]
    both = np.minimum(m, n)
    ends = np.flatnonzero(m != n)
    p, q, both = np.concatenate((x, (x + m - both)[ends])), np.concatenate((y, (y + n - both)[ends])), np.concatenate((both, both[ends]))
    order = np.lexsort((p, q - p))
    p, q, both = p[order], q[order], both[order]
    new = np.ones(len(p), bool)
    new[1:] = (q[1:] - p[1:] != q[:-1] - p[:-1]) | (p[1:] != p[:-1] + both[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(p)) - 1 if len(p) else head
    start, end, place = p[head], p[tail] + both[tail], q[head]
    by = np.lexsort((place, start))
    return start[by], end[by], place[by]


def laid(a: np.ndarray, other: Side, t: int, least: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places in a, places in b) of chains of runs along diagonals, of ``least`` places or more, the longest first.

    A run follows the one before that makes the longest chain with it: at most t // 2 behind, and
    on a diagonal that is at most 3 * WIDTH off. A run is in one chain.
    """
    start, end, at = runs_of(a, other)
    n, half, off = len(start), t // 2, 3 * WIDTH
    drift, best, before = at - start, (end - start).astype(np.int64), np.full(n, -1)
    s, e, d, long, back = start.tolist(), end.tolist(), drift.tolist(), best.tolist(), before.tolist()
    first, reach = 0, half + max(long, default=0)
    for k in range(1, n):
        x, y, z = s[k], e[k], d[k]
        while s[first] < x - reach:
            first += 1
        if k - first > 64:  # many runs near by, as in texts that repeat a word
            own = slice(first, k)
            ok = (end[own] + half >= x) & (np.abs(drift[own] - z) <= off) & (end[own] < y)
            more = np.where(ok, best[own] - np.maximum(0, end[own] - x), 0)
            m = int(more.argmax())
            gain, m = int(more[m]), first + m
        else:
            gain, m = 0, -1
            for i in range(first, k):
                if x - half <= e[i] < y and -off <= d[i] - z <= off:
                    more_ = long[i] - max(0, e[i] - x)
                    if more_ > gain:
                        gain, m = more_, i
        if gain > 0:
            long[k] += gain
            best[k] = long[k]
            back[k] = m
    before[:] = back
    used = np.zeros(len(start), bool)
    chains_ = []
    for k in np.argsort(-best, kind="stable")[: int((best >= least).sum())].tolist():
        links = []
        while k >= 0 and not used[k]:
            used[k] = True
            links.append(k)
            k = int(before[k])
        m = np.array(links[::-1], np.int64)
        if len(m) and end[m[-1]] - start[m[0]] >= t:
            x, to = start[m], end[m]
            x[1:] = np.maximum(x[1:], to[:-1])  # a run begins behind the one before
            size = to - x
            p = np.repeat(to - np.cumsum(size), size) + np.arange(size.sum())
            chains_.append((p, p + np.repeat(drift[m], size)))
    return chains_


def grown(a: np.ndarray, lo: int, hi: int, own: np.ndarray) -> tuple[int, int]:
    """The stretch lo to hi of a as far as only its own shingles (in order) follow on either side."""
    while hi < len(a) and holds(own, a[hi]):
        hi += 1
    while lo and holds(own, a[lo - 1]):
        lo -= 1
    return lo, hi


def facing(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, tuple[int, int], np.ndarray, float]:
    """(shingles of a[lo:hi], the stretch of b that the chain (p, q) sets against it, its shingles, their similarity); shingles are in order."""
    i, j = p.searchsorted((lo, hi))
    u, v = int(q[i:j].min()), int(q[i:j].max()) + 1
    one = distinct(a[lo:hi])
    while v - u < hi - lo and v < len(b) and holds(one, b[v]):  # shingles that b repeats: on as far as they go
        v += 1
    while v - u < hi - lo and u and holds(one, b[u - 1]):
        u -= 1
    two = distinct(b[u:v])
    all_ = len(distinct(np.concatenate((one, two))))
    return one, (u, v), two, (len(one) + len(two) - all_) / all_


def densest(p: np.ndarray, q: np.ndarray, x: int, y: int, size: int) -> int | None:
    """Where in x to y the stretch of ``size`` begins that the chain (p, q) makes the most alike, if it holds any of it."""
    w = np.arange(x, y - size + 1)
    i, j = np.searchsorted(p, w), np.searchsorted(p, w + size)
    w, i, j = w[j > i], i[j > i], j[j > i]
    if not len(w):
        return None
    return int(w[((j - i) / (size + q[j - 1] - q[i] + 1 - (j - i))).argmax()])


def shares_of(similarity: float) -> list[float]:
    """The shares of shared shingles at which passages() looks for stretches, one after the other."""
    return [2 * similarity / (1 + similarity), 0.5 + similarity / (1 + similarity), 1 - 1e-9]


def stretched(same: np.ndarray, t: int, share: float) -> bool:
    """Whether a stretch of t or more that lies between true places is true to the share; same is true somewhere."""
    n = len(same) - same[::-1].argmax()
    s = np.zeros(n - same.argmax() + 1)
    np.cumsum(share - same[same.argmax() : n], out=s[1:])
    return len(s) > t and bool((s[t:] - np.maximum.accumulate(s[: len(s) - t])).min() <= 1e-6)


def passages(a: np.ndarray, other: Side, t: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """(start, end, start in b, end in b, similarity) of passages of t shingles or more that a and b have in common.

    Shared shingles are chained along diagonals; a passage is a stretch of a chain whose sets of
    shingles on both sides have the similarity. Of passages that others cover on both sides one is given.
    """
    b, ranked = other.b, other.ranked
    shares = shares_of(similarity)
    out: list[tuple[int, int, int, int, float]] = []
    if min(len(a), len(b)) < t * similarity:
        return out
    same = ranked[np.minimum(ranked.searchsorted(a), len(b) - 1)] == a
    if same.sum() < t * shares[0] - 1 or not stretched(same, t, shares[0]):  # what a chain holds is less
        return out
    seen = np.zeros(len(a), bool), np.zeros(len(b), bool)
    for p, q in laid(a, other, t, t * shares[0] - 1):
        if seen[0][p].all() and seen[1][q].all():
            continue
        todo = [(int(p[0]), int(p[-1]) + 1, 0)]
        while todo:
            x, y, level = todo.pop()
            if y - x < t:
                continue
            i, j = p.searchsorted((x, y))
            if j - i < t * shares[level] - 1e-6:
                continue
            s, e = 0, y - x
            if j - i < y - x:
                same = np.zeros(y - x)
                same[p[i:j] - x] = 1
                s, e = longest(same, shares[level])
            if e - s < t:
                continue
            got = facing(a, b, p, q, x + s, x + e)
            if level == 0 and got[-1] < similarity:  # an end with many edits can spoil what is alike but for it
                for size in (t, t + t // 4):
                    lo = densest(p, q, x, y, size)
                    if lo is not None and (one := facing(a, b, p, q, lo, lo + size))[-1] >= similarity:
                        s, e, got = lo - x, lo + size - x, one
                        break
            own, (u, v), two, found = got
            if found >= similarity and v - u >= t * similarity:
                (lo, hi), (u, v) = grown(a, x + s, x + e, own), grown(b, u, v, two)
                if not (seen[0][lo:hi].all() and seen[1][u:v].all()):
                    out.append((lo, hi, u, v, found))
                    seen[0][lo:hi] = seen[1][u:v] = True
            elif level + 1 < len(shares):  # what is more alike inside of it
                todo.append((x + s, x + e, level + 1))
            todo += [(x, x + s, level), (x + e, y, level)]
    return out


def in_lists(posts: DataFrame) -> DataFrame:
    """The rows (key, ...) whose key another row has: most keys have one, and are dropped as they pass by in order."""

    def rows(batches):
        last, kept = None, False
        for b in batches:
            if not b.num_rows:
                continue
            if last is not None:
                b = pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0]
            key = b.column("key").to_numpy()
            keep = np.zeros(len(key), bool)
            keep[1:] = key[1:] == key[:-1]
            keep[:-1] |= keep[1:]
            keep[0] |= kept
            last, kept, keep[-1] = b.slice(len(key) - 1), bool(keep[-1]), False  # whose key the next batch may have
            yield b.filter(pa.array(keep))
        if kept:
            yield last

    return posts.repartition("key").sortWithinPartitions("key").mapInArrow(rows, posts.schema)


def listed(place: DataFrame) -> DataFrame:
    """place (key, doc_id, place, open) with c, lo and hi of its list: places, smallest and largest id; of lists with several texts and an open place."""
    own = Window.partitionBy("key")
    stat = [F.count("*").over(own).alias("c"), F.max("open").over(own).alias("o"), F.min("doc_id").over(own).alias("lo"), F.max("doc_id").over(own).alias("hi")]
    return checkpoint(place.select("*", *stat).where("o > 0 and lo <> hi").drop("o"))


def leads(hit: DataFrame) -> DataFrame:
    """(key, y): the place of each list's first text in it, the first of several; of listed() rows."""
    return checkpoint(hit.where("doc_id = lo").groupBy("key").agg(F.min("place").alias("y")))


def led(hit: DataFrame, lead: DataFrame) -> DataFrame:
    """(a, x, b, y): each place of listed() rows and that of the first text of its list."""
    return hit.where("doc_id <> lo").join(lead, "key").select(F.col("doc_id").alias("a"), F.col("place").alias("x"), F.col("lo").alias("b"), "y")


def partners(hit: DataFrame, most: int) -> DataFrame:
    """(a, x, b, y): places of two texts to hold against each other: open ones and all others, in lists of up to ``most`` places."""
    few = hit.where(F.col("c") <= most).groupBy("key").agg(F.collect_list(F.struct("doc_id", "place", "open")).alias("g"))  # ``most`` places at most
    few = few.select("g", F.explode(F.filter("g", lambda m: m["open"] == 1)).alias("m")).select("m", F.explode("g").alias("n"))
    few = few.where("m.doc_id <> n.doc_id and (n.open = 0 or n.doc_id < m.doc_id)")
    return few.select(F.col("m.doc_id").alias("a"), F.col("m.place").alias("x"), F.col("n.doc_id").alias("b"), F.col("n.place").alias("y"))


def _shingled(parts: list[bytes]) -> list[np.ndarray]:
    """The shingles of each of the parts of texts."""
    words = np.frombuffer(b"".join(parts), np.uint32).astype(np.uint64)
    h, d = shingle_hashes(words, np.repeat(np.arange(len(parts)), [len(p) // 4 for p in parts]), len(parts), WIDTH)
    return np.split(h, np.searchsorted(d, np.arange(1, len(parts))))


def verified(pairs: DataFrame, items: DataFrame, t: int, similarity: float) -> DataFrame:
    """The passages of partners(), seen from both documents, looked for in the hull of the places that two texts share."""
    reach = t + SPAN
    hull = checkpoint(pairs.groupBy("a", "b").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")))
    low = lambda c: F.greatest(F.col(c) - reach, F.lit(0))
    side = lambda k, c: F.struct(F.col("ab"[k]).alias("doc_id"), F.lit(k).alias("side"), low(f"{c}0").alias("lo"), (F.col(f"{c}1") + (reach + WIDTH - 1) - low(f"{c}0")).alias("n"))
    asked = hull.select("a", "b", low("x0").alias("x0"), low("y0").alias("y0"), F.explode(F.array(side(0, "x"), side(1, "y"))).alias("s")).select("a", "b", "x0", "y0", "s.*")
    cut = asked.join(items, "doc_id").select("a", "b", "x0", "y0", "side", F.expr("substring(items, 4 * lo + 1, 4 * n)").alias("part"))
    texts = lambda k: F.collect_set(F.when(F.col("side") == k, F.col("part")))  # noqa: E731  several if rows repeat an id
    both = cut.groupBy("a", "b", "x0", "y0").agg(texts(0).alias("xs"), texts(1).alias("ys"))

    def rows(batches):
        extra = WIDTH - 1
        names = [f.split()[0] for f in PASSAGE.split(", ")]
        for batch in batches:
            out: list[tuple] = []
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sides = [part.column(c).to_pylist() for c in ("xs", "ys")]
                tokens = iter(_shingled([t for x, y in zip(*sides, strict=True) for t in (*x, *y)]))
                for a, b, x0, y0, xs, ys in zip(*(part.column(c).to_pylist() for c in ("a", "b", "x0", "y0")), *sides, strict=True):
                    own = [next(tokens) for _ in xs]
                    for other in [Side(next(tokens)) for _ in ys]:
                        for x in own:
                            for s, e, u, v, alike in passages(x, other, t, similarity):
                                p, q = (s + x0, e - s + extra), (u + y0, v - u + extra)
                                out += [(a, *p, b, *q, alike), (b, *q, a, *p, alike)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.float64() if n == "similarity" else pa.int64()) for k, n in enumerate(names)], names)

    return checkpoint(both.mapInArrow(rows, PASSAGE))


def marked(hit: DataFrame, lead: DataFrame, found: DataFrame) -> DataFrame:
    """(key, doc_id, place, open) of listed() rows: open is 0 for the first text of the list and where a found passage holds the place and that text's, else 1.

    Passages are laid out in cells of 64 places, so a place meets those near by alone.
    """
    end, other_end = F.col("start") + F.col("words") - WIDTH, F.col("other_start") + F.col("other_words") - WIDTH
    own = F.struct("start", end.alias("last"), F.col("other_start").alias("low"), other_end.alias("high")).alias("p")
    cells = found.where("other_id < doc_id").select("doc_id", F.col("other_id").alias("lo"), F.explode(F.sequence(F.shiftright("start", 6), F.shiftright(end, 6))).alias("cell"), own)
    covered = cells.groupBy("doc_id", "lo", "cell").agg(F.collect_set("p").alias("ps"))  # a passage covers what others do not
    both = hit.join(lead, "key").withColumn("cell", F.shiftright(F.col("place").cast("long"), 6)).join(covered, ["doc_id", "lo", "cell"], "left")
    held = F.exists("ps", lambda p: F.col("place").between(p["start"], p["last"]) & F.col("y").between(p["low"], p["high"]))
    return both.select("key", "doc_id", "place", F.when(F.col("doc_id") == F.col("lo"), 0).when(held, 0).otherwise(1).alias("open"))


def cut_out(hit: DataFrame, items: DataFrame, reach: int) -> DataFrame:
    """(doc_id, part, base, words, place, open): what lies within ``reach`` shingles of a text's places; words from base on, places count in them."""
    own = hit.groupBy("doc_id").agg(F.collect_list(F.struct("place", "open")).alias("p"))  # a text's own places
    schema = "doc_id long, base long, words binary, place array<int>, open array<int>"

    def rows(batches):
        for b in batches:
            out: list[tuple] = []
            for doc, text, p in zip(*(b.column(c).to_pylist() for c in ("doc_id", "items", "p")), strict=True):
                n = len(text) // 4
                at = np.array(sorted({(x["place"], x["open"]) for x in p if x["place"] + WIDTH <= n}), np.int64).reshape(-1, 2)
                for one in np.split(at, np.flatnonzero(np.diff(at[:, 0]) > 2 * reach) + 1):
                    if len(one):
                        lo, hi = max(0, int(one[0, 0]) - reach), int(one[-1, 0]) + reach + WIDTH
                        out.append((doc, lo, text[4 * lo : 4 * hi], (one[:, 0] - lo).astype(np.int32), one[:, 1].astype(np.int32)))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], ["doc_id", "base", "words", "place", "open"])

    return own.join(items, "doc_id").select("doc_id", "items", "p").mapInArrow(rows, schema).withColumn("part", F.xxhash64("base", "words"))


def in_company(parts: DataFrame) -> DataFrame:
    """parts with ``at``: the places of their shingles that another text's parts have as well."""

    def rows(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                some = b.slice(i, 512)
                h = _shingled(some.column("words").to_pylist())
                n = np.array([len(x) for x in h])
                repeated = lambda c: pa.array(np.repeat(some.column(c).to_numpy(), n))  # noqa: B023,E731
                at = np.concatenate([np.arange(k, dtype=np.int32) for k in n])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), repeated("doc_id"), repeated("part"), pa.array(at)], ["shingle", "doc_id", "part", "at"])

    each = parts.select("doc_id", "part", "words").mapInArrow(rows, "shingle long, doc_id long, part long, at int")
    two = each.groupBy("shingle").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("shingle")
    return parts.join(each.join(two, "shingle").groupBy("doc_id", "part").agg(F.collect_set("at").alias("at")), ["doc_id", "part"])


def all_but_one(words: np.ndarray, place: np.ndarray, open_: np.ndarray, shared: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, open, kind) of the passages of a part that hold a place and miss at most one edit.

    ``size - 1`` words that follow each other, or follow but for one or two words in between at
    each place where an edit takes all its shingles (of two words, if it takes one that no other
    text has), and ``size - WIDTH`` words that follow each other. All their shingles are in company (``shared``). The place is the middle. Kind is 1
    with two words in between, else 0.
    """
    n = len(words) - WIDTH + 1
    lone, held, opened = (np.zeros(n + 1, np.int64) for _ in range(3))
    lone[1:], held[place + 1], opened[place + 1] = 1, 1, 0
    lone[shared + 1] = 0
    opened[place[open_ == 1] + 1] = 1
    lone, held, opened = (np.cumsum(x) for x in (lone, held, opened))
    mixed = mix(words.astype(np.uint64) + np.uint64(1))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * powers(_B, len(words)), dtype=np.uint64)))
    back = powers(pow(_B, -1, 1 << 64), len(words) + 1)
    out = []
    for gap, long in ((0, size - WIDTH), (0, size - 1), (1, size - 1), (2, size - 1)):
        tokens = long + gap - WIDTH + 1  # shingles of the passage
        w = np.arange(max(0, n - tokens + 1))
        w = w[(held[w + tokens] > held[w]) & (lone[w + tokens] - lone[w] <= (WIDTH - 1 + gap if gap else 0))]
        if not gap:
            key, at = (sums[w + long] - sums[w]) * back[w] + np.uint64(long), w
        else:
            e = np.arange(WIDTH, long - WIDTH + 1)  # words before the edit
            killed = lone[w[:, None] + e + gap] - lone[w[:, None] + e - WIDTH + 1]
            alone = (lone[w + tokens] - lone[w])[:, None]
            k, m = np.nonzero((killed == alone) & (alone > 0) if gap == 2 else killed == alone)
            at, cut = w[k], w[k] + e[m]
            key = (sums[cut] - sums[at]) * back[at] + (sums[at + long + gap] - sums[cut + gap]) * back[at + gap] + np.uint64(long)
        out.append((mix(key), at + tokens // 2, (opened[at + tokens] > opened[at]).astype(np.int32), np.full(len(at), gap // 2, np.int32)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def alike(parts: DataFrame, size: int) -> DataFrame:
    """(a, x, b, y): for each open passage of a part by all_but_one() one text that has it too.

    Who has one of these keys is alike with all who have it, so any of them will do: the first, or
    for the first the last.
    """

    def rows(batches):
        names = ["key", "doc_id", "place", "open", "kind"]

        def batch(ids, got):
            key, place, open_, kind = (np.concatenate(x) for x in zip(*got, strict=True))
            ids = np.repeat(np.array(ids, np.int64), [len(g[0]) for g in got])
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), ids, place.astype(np.int64), open_, kind)], names)

        for b in batches:
            ids, got, held = [], [], 0
            for doc, base, text, place, open_, at in zip(*(b.column(c).to_pylist() for c in ("doc_id", "base", "words", "place", "open", "at")), strict=True):
                found = all_but_one(np.frombuffer(text, np.uint32), np.array(place), np.array(open_), np.array(at), size)
                ids.append(doc)
                got.append((found[0], found[1] + base, *found[2:]))
                held += len(found[0])
                if held > 100_000:
                    yield batch(ids, got)
                    ids, got, held = [], [], 0
            if got:
                yield batch(ids, got)

    post = lambda d: d.select("doc_id", "base", "words", "place", "open", "at").mapInArrow(rows, "key long, doc_id long, place long, open int, kind int")
    ends = ["min(doc_id) as lo_id", "min_by(place, doc_id) as lo_at", "max(doc_id) as hi_id", "max_by(place, doc_id) as hi_at", "max(open) as o"]
    ends = post(parts).groupBy("key").agg(*map(F.expr, ends)).where("o = 1 and lo_id <> hi_id")
    met = post(parts.where(F.array_contains("open", 1))).where("open = 1").join(ends, "key")
    met = met.selectExpr("doc_id", "place", "kind", "if(doc_id = lo_id, hi_id, lo_id) as id", "if(doc_id = lo_id, hi_at, lo_at) as at")
    one = [f"coalesce({', '.join(f(f'if(kind = {k}, id, null)') for k in (0, 1))}) as {n}" for n, f in (("b", "min({})".format), ("y", "min_by(at, {})".format))]
    return met.groupBy("doc_id", "place").agg(*map(F.expr, one)).select(F.col("doc_id").alias("a"), F.col("place").alias("x"), "b", "y")


def may_pass(tokens: np.ndarray, place: int, shared: np.ndarray, t: int, similarity: float) -> bool:
    """Whether a stretch of t or more that holds the place has enough shingles in company (``shared``) for a passage; one that repeats counts as lacking once."""
    lone = np.zeros(len(tokens), bool)
    lone[np.unique(tokens, return_index=True)[1]] = True
    return bool(alike_around(~(lone & ~shared)[None], place, t, similarity)[0])


def alike_around(same: np.ndarray, place: int, t: int, similarity: float) -> np.ndarray:
    """Of each row, whether a stretch of t or more that holds the place is true to the share of the similarity; a passage's shingles are, in the other text."""
    s = np.zeros((len(same), same.shape[1] + 1))
    np.cumsum(same - similarity, axis=1, out=s[:, 1:])
    hi = np.arange(max(place + 1, t), s.shape[1])
    if not len(hi):
        return np.zeros(len(same), bool)
    return (s[:, hi] - np.minimum.accumulate(s, axis=1)[:, np.minimum(hi - t, place)] >= -1e-9).any(axis=1)


def around(parts: DataFrame, reach: int, t: int, similarity: float) -> DataFrame:
    """(doc_id, place, at, words): the words within ``reach`` shingles of each place of parts that may lie in a passage; the place is ``at`` there."""

    def rows(batches):
        for b in batches:
            out: list[tuple] = []
            columns = (b.column(c).to_pylist() for c in ("doc_id", "base", "words", "place", "at"))
            tokens = _shingled(b.column("words").to_pylist()) if b.num_rows else []
            for (doc, base, text, place, at), h in zip(zip(*columns, strict=True), tokens, strict=True):
                shared = np.zeros(len(h), bool)
                shared[at] = True
                for p in place:
                    lo, hi = max(0, p - reach), p + reach + 1
                    if may_pass(h[lo:hi], p - lo, shared[lo:hi], t, similarity):
                        out.append((doc, base + p, p - lo, text[4 * lo : 4 * (hi + WIDTH - 1)]))
            kinds = {"doc_id": pa.int64(), "place": pa.int32(), "at": pa.int32(), "words": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds.values())], list(kinds))

    return parts.select("doc_id", "base", "words", "place", "at").mapInArrow(rows, "doc_id long, place int, at int, words binary")


class Around:
    """The stretches of ``t`` shingles or more of a text that hold a place, as sets; where: the shingles by numbers from 0."""

    def __init__(self, where: np.ndarray, place: int, t: int) -> None:
        n = len(where)
        self.where = where
        before, order = np.full(n, -1), np.argsort(where, kind="stable")
        again = where[order[1:]] == where[order[:-1]]
        before[order[1:][again]] = order[:-1][again]
        start, at = np.arange(min(place, n - t) + 1)[:, None], np.arange(n)
        #: For each start, where a shingle is the first of its kind; a stretch may end with ``ends``.
        self.new = (at >= start) & (before < start)
        self.ends = np.flatnonzero(at + 1 >= np.maximum(start + t, place + 1))
        self.size = np.cumsum(self.new, axis=1, dtype=np.int16).ravel()[self.ends]
        self.known: dict[bytes, np.ndarray] = {}

    def lacking(self, shared: np.ndarray) -> np.ndarray:
        """For each number of shared shingles (shared: which they are) the fewest others of a stretch that has as many or more."""
        key = shared.tobytes()
        if key not in self.known:
            both = np.cumsum(self.new & shared[self.where], axis=1, dtype=np.int16).ravel()[self.ends]
            few = np.full(len(self.where) + 2, len(self.where) + 1, np.int16)
            np.minimum.at(few, both, self.size - both)
            self.known[key] = np.minimum.accumulate(few[::-1])[::-1]
        return self.known[key]


class Block:
    """Texts of a block pair by the shingles that they have: which others may share a passage with one."""

    def __init__(self, tokens: list[np.ndarray], share: float, t: int) -> None:
        n, self.t, self.share = len(tokens), t, share
        sizes = [len(x) for x in tokens]
        values, where = np.unique(np.concatenate(tokens), return_inverse=True)
        owned, first, where, self.times = np.unique(np.repeat(np.arange(n), sizes) * len(values) + where, return_index=True, return_inverse=True, return_counts=True)
        #: Each shingle of a text once, in order, by text; and by shingle the texts that have it.
        self.own, self.of = owned % len(values), np.concatenate(([0], np.cumsum(np.bincount(owned // len(values), minlength=n))))
        self.owners = (owned // len(values))[np.argsort(self.own, kind="stable")]
        self.many = np.bincount(self.own, minlength=len(values))
        self.at = np.cumsum(self.many) - self.many
        self.common = self.many > max(16, n // 16)
        self.column = np.full(len(values), -1)
        #: Of each text, which of its shingles are at its places, and where each is first.
        ends = np.cumsum(sizes)
        self.where = [x - k for x, k in zip(np.split(where, ends[:-1]), self.of[:-1], strict=True)]
        self.first = [x - k for x, k in zip(np.split(first, self.of[1:-1]), ends - sizes, strict=True)]

    def lacking(self, same: np.ndarray, ends: bool = True) -> np.ndarray:
        """Of each row, how many more places would have to be true, so that a stretch of t or more is to the share; with ends, one between places that are true."""
        n, t = same.shape[1], self.t
        if n < t:
            return np.full(len(same), np.inf)
        s = np.zeros((len(same), n + 1))
        np.cumsum(self.share - same, axis=1, out=s[:, 1:])
        start, end = s[:, : n + 1 - t], s[:, t:]
        if ends:
            at = np.arange(n + 1)
            start = np.where(at[: n + 1 - t] >= same.argmax(axis=1)[:, None], start, -np.inf)
            end = np.where(at[t:] <= n - same[:, ::-1].argmax(axis=1)[:, None], end, np.inf)
        return (end - np.maximum.accumulate(start, axis=1)).min(axis=1, initial=np.inf)

    def met(self, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """(texts, their kinds, which shingles of text i a kind has, which of a text's i has) of those of others that i has a stretch of as passages() needs it.

        Shingles that many have, as those of the line that all do, are no news of each other: a
        passage needs more than the stretch has of them, and as many of the others are looked for.
        """
        mine = slice(self.of[i], self.of[i + 1])
        asked, times, where = self.own[mine], self.times[mine], self.where[i]
        need = float(self.lacking(self.common[asked][where][None], False)[0])
        rare, need = (~self.common[asked], need) if need > 1e-6 else (slice(None), self.share * self.t)
        seek, times = asked[rare], times[rare]
        many = self.many[seek]
        meets = self.owners[np.repeat(self.at[seek] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        found = np.flatnonzero((np.bincount(meets, np.repeat(times, many), len(self.where)) >= need - 1e-6) & others)
        size = self.of[found + 1] - self.of[found]
        start = np.cumsum(size) - size
        self.column[asked] = np.arange(len(asked))
        column = self.column[self.own[np.repeat(self.of[found] - start, size) + np.arange(size.sum())]]
        self.column[asked] = -1
        has = column >= 0
        both = np.zeros((len(found), len(asked)), bool)
        both[np.repeat(np.arange(len(found)), size)[has], column[has]] = True
        packed = np.packbits(both, axis=1)  # many have the same of its shingles
        _, first, kind = np.unique(packed.view(f"S{packed.shape[1]}").ravel(), return_index=True, return_inverse=True)
        kinds = both[first]
        ok = np.flatnonzero((self.lacking(kinds[:, where]) <= 1e-6)[kind])
        return found[ok], kind[ok], kinds, [has[x : x + n] for x, n in zip(start[ok].tolist(), size[ok].tolist(), strict=True)]


def block_links(lo: np.ndarray, hi: np.ndarray, at: np.ndarray, open_: np.ndarray, side: np.ndarray, tokens: list[np.ndarray], same: bool, t: int, similarity: float, given: list | None = None) -> list[tuple[int, int]]:
    """(i, j): links that connect the surroundings of places of a block pair, i open; with same, both blocks are one. ``given`` gets their passages.

    Texts lo to hi have the same surroundings of a place, which is ``at`` in them. Places that are
    not open are connected by the first text of the list. A link is a passage that holds both
    places. passages() looks for them from stretches of i that are in j to its first share, so pairs
    without one are not looked at. Its sets of shingles have the similarity, so in texts that repeat
    shingles those that its two stretches lack are few for those that are shared; a pair without
    such stretches is not looked at further.
    """
    n = len(lo)
    most = (1 - similarity) / similarity * np.arange(max(map(len, tokens), default=0) + 2) + 1e-9  # others to so many shared ones
    sides, other = {}, {}
    block = Block(tokens, shares_of(similarity)[0], t)
    label = np.where(open_ == 1, np.arange(n), n)
    out = []
    for i in np.flatnonzero(open_ == 1).tolist():
        others = (label != label[i]) & ((lo != lo[i]) | (hi != lo[i]) | (hi[i] != lo[i]))
        if not same:
            others &= side != side[i]
        met, kind, kinds, back = block.met(i, others)
        if not len(met):
            continue
        lone = np.zeros(len(tokens[i]), bool)
        lone[block.first[i]] = True
        ok = alike_around(~(lone & ~kinds[:, block.where[i]]), int(at[i]), t, similarity)  # one that repeats counts as lacking once
        few: dict[int, np.ndarray] = {}
        if kinds.shape[1] < len(tokens[i]):
            mine = Around(block.where[i], int(at[i]), t)
            for k in np.flatnonzero(np.bincount(kind, minlength=len(kinds)) * ok).tolist():
                few[k] = mine.lacking(kinds[k])
                ok[k] = (few[k] <= most[: len(few[k])]).any()
        ok = ok[kind]
        for k in np.flatnonzero(ok).tolist():
            j = int(met[k])
            if label[j] == label[i]:
                continue
            if few:
                if j not in other:
                    other[j] = Around(block.where[j], int(at[j]), int(np.ceil(t * similarity)))
                a, b = few[int(kind[k])], other[j].lacking(back[k])
                m = min(len(a), len(b))
                if not (a[:m] + b[:m] <= most[:m]).any():
                    continue
            if j not in sides:
                sides[j] = Side(tokens[j])
            held = next((x for x in passages(tokens[i], sides[j], t, similarity) if x[0] <= at[i] < x[1] and x[2] <= at[j] < x[3]), None)
            if held:
                label[label == label[i]] = label[j]
                out.append((i, j))
                if given is not None:
                    given.append(held)
    return out


def unconnected(place: DataFrame, parts: DataFrame, t: int, similarity: float) -> DataFrame:
    """(a, x, b, y, PASSAGE): links that connect the open places of long lists (listed() rows and their parts) with others of their list, by pairs of blocks.

    Places with the same words around them are compared once. Different texts among them are
    alike(); what one is linked with, the others are held against too. The passage is that of the words around both places.
    """
    link = "a long, x int, b long, y int, s int, m int, u int, w int, similarity double"  # begins of the passage, from the places, and words
    near = checkpoint(around(parts, t + 1, t, similarity).withColumn("form", F.xxhash64("at", "words")))
    member = checkpoint(place.select("key", "doc_id", "place", "open").join(near.select("doc_id", "place", "form").distinct(), ["doc_id", "place"]))
    spot = F.struct("doc_id", "place")
    form = member.groupBy("key", "form").agg(F.max("open").alias("open"), F.min(spot).alias("lo"), F.max(spot).alias("hi"))
    size = form.groupBy("key").agg(F.count("*").alias("c"), F.sum("open").alias("o"), F.min("lo.doc_id").alias("lo"), F.max("hi.doc_id").alias("hi")).where("o > 0 and c > 1 and lo <> hi")
    own = form.join(size.select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "key")
    own = own.withColumn("own", F.pmod("form", F.col("blocks").cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spots = [F.col(f"{k}.doc_id").alias(f"{k}_id") for k in ("lo", "hi")] + [F.col(f"{k}.place").alias(f"{k}_at") for k in ("lo", "hi")]
    dealt = own.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "form", "open", *spots)
    # little data and much work: in a fixed number of tasks, which are not merged by their size
    full = dealt.join(near.groupBy("form").agg(F.min(F.struct("at", "words")).alias("w")).select("form", "w.*"), "form").repartition(tasks(place.sparkSession, 4), "key", "i", "j")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("lo_id", "ascending"), ("lo_at", "ascending"), ("form", "ascending")])
        form, lo, hi, x, y, at, open_, side = (table.column(c).to_numpy() for c in ("form", "lo_id", "hi_id", "lo_at", "hi_at", "at", "open", "side"))
        given: list[tuple] = []
        got = block_links(lo, hi, at, open_, side, _shingled(table.column("words").to_pylist()), key[1].as_py() == key[2].as_py(), t, similarity, given)
        i, j = np.array(got, np.int64).reshape(-1, 2).T
        s, e, u, v, similar = np.array(given).reshape(-1, 5).T
        # the first text of both, or the last of one whose first is that of the other
        last = lo[i] == lo[j]
        a_last, b_last = last & (hi[j] == lo[i]), last & (hi[j] != lo[i])
        a, b = np.where(a_last, hi[i], lo[i]), np.where(b_last, hi[j], lo[j])
        x, y = np.where(a_last, y[i], x[i]), np.where(b_last, y[j], x[j])
        ints = {"x": x, "y": y, "s": s - at[i], "m": e - s + (WIDTH - 1), "u": u - at[j], "w": v - u + (WIDTH - 1)}
        columns = {"key": pa.array([key[0].as_py()] * len(i), pa.int64()), "one": form[i], "two": form[j], "a": a, "b": b, "similarity": similar} | {k: x.astype(np.int32) for k, x in ints.items()}
        return pa.table(columns).select([f.split()[0] for f in f"key long, one long, two long, {link}".split(", ")])

    # few rows of many tasks
    found = checkpoint(full.groupBy("key", "i", "j").applyInArrow(compare, f"key long, one long, two long, {link}")).coalesce(max(1, tasks(place.sparkSession) // 4))
    sides = found.selectExpr("key", "one as form", "struct(b, y, s, m, u, w, similarity) as other").union(
        found.selectExpr("key", "two as form", "struct(a as b, x as y, u as s, w as m, s as u, m as w, similarity) as other")
    )
    rest = member.where("open = 1").join(sides.groupBy("key", "form").agg(F.min("other").alias("other")), ["key", "form"])
    rest = rest.where("doc_id <> other.b").select(F.col("doc_id").alias("a"), F.col("place").alias("x"), "other.*")
    passage = ["a as doc_id", "cast(x + s as long) as start", "cast(m as long) as words", "b as other_id", "cast(y + u as long) as other_start", "cast(w as long) as other_words", "similarity"]
    return checkpoint(found.drop("key", "one", "two").unionByName(rest).selectExpr("a", "x", "b", "y", *passage))


def left_out(links: DataFrame, found: DataFrame) -> DataFrame:
    """The passages of unconnected() links, seen from both documents, whose texts have none together among those found.

    In the hull of all that two texts share, passages() may lay out repeated words in another way than around one place.
    """
    lost = links.join(found.selectExpr("doc_id as a", "other_id as b"), ["a", "b"], "left_anti").select(*(f.split()[0] for f in PASSAGE.split(", ")))
    return lost.union(lost.select("other_id", "other_start", "other_words", "doc_id", "start", "words", "similarity"))


def first_texts(texts: DataFrame, classes: DataFrame, same: DataFrame) -> DataFrame:
    """The rows of texts with the smallest id of their class; what a filter of the other ids does not hold is not moved."""
    packed = bloom_of_ids(same, "doc_id")

    def having(held: bool):
        def rows(batches):
            for b in batches:
                yield b.filter(pa.array(may_hold(packed, b.column("doc_id").to_numpy()) == held))

        return texts.select("doc_id", "digest", "keys", "places").mapInArrow(rows, "doc_id long, digest binary, keys array<long>, places array<int>")

    return having(False).union(having(True).join(classes.select("digest", F.col("lo").alias("doc_id")), ["digest", "doc_id"]).select("doc_id", "digest", "keys", "places"))


def repeated_passages(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, start, words, other_id, other_start, other_words, similarity): passages of docs (doc_id, text) that repeat.

    A row for each passage and partner, from the side of each of the two: first word and number
    of words here and there. Equal texts have one row each, with the smallest of their ids (that
    one with the next), over the whole text; passages shared with other texts are given for the
    smallest id. Texts shorter than ``words``, null ones and rows without an id have no passages;
    rows that repeat an id are not partners, and places count in the row's own text. An empty
    table gives an empty result. Other columns are ignored.
    """
    t = words - WIDTH + 1
    texts = checkpoint(posts(docs, t))
    classes = checkpoint(texts.groupBy("digest").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max("n").alias("n")))
    same = texts.select("doc_id", "digest").join(classes.where("lo < hi"), "digest").where("doc_id <> lo")
    copies = same.select("doc_id", F.col("lo").alias("other"), "n").union(same.groupBy("lo").agg(F.min("doc_id").alias("other"), F.max("n").alias("n")).select("lo", "other", "n"))
    zero, all_ = F.lit(0).cast("long"), F.col("n") + (WIDTH - 1)
    whole = copies.distinct().select("doc_id", zero.alias("start"), all_.alias("words"), F.col("other").alias("other_id"), zero.alias("other_start"), all_.alias("other_words"), F.lit(1.0).alias("similarity"))

    post = first_texts(texts, classes, same).select("doc_id", F.explode(F.arrays_zip("keys", "places")).alias("k")).select(F.col("k.keys").alias("key"), "doc_id", F.col("k.places").alias("place"), F.lit(1).alias("open"))
    member = listed(in_lists(post))
    items = word_sequences(docs, member.select("doc_id"), WIDTH)
    lead = leads(member)
    first = verified(led(member, lead), items, t, similarity)

    place = listed(marked(member, lead, first))
    many = place.where(F.col("c") > FEW)
    parts = checkpoint(in_company(checkpoint(cut_out(many, items, t + 1))))
    links = unconnected(many, parts, t, similarity)
    others = partners(place, FEW).union(alike(parts, words)).union(links.select("a", "x", "b", "y"))
    second = verified(others, items, t, similarity)
    return first.union(second).union(left_out(links, second)).union(whole).distinct()
