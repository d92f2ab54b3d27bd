"""Removal of repeated byte strings by a distributed merge sort of suffixes that knows common prefixes.

Every string of ``length`` bytes that also starts in a document with a smaller id is covered.
Suffixes are taken at anchors: of the ``length - K + 1`` grams of K bytes in a string the one
with the smallest hash, leftmost in a tie, is its anchor, so equal strings have equal anchors at
equal places, about one for 16 bytes of text. The windows that share an anchor are one suffix
context: what is left of the anchor and what follows it.

1. Documents are dealt into groups once. Each group sends the sorted hashes of its anchors, cut
   into buckets by value; a bucket answers each group which of its anchors other documents have.
   Text that occurs once goes no further than this.
2. Each group sorts the contexts of its shared anchors (equal ones become one, with their
   smallest id), front-codes the sorted run and sends each bucket its stretch of it.
3. A bucket merges the runs it gets with a loser tree whose nodes keep the prefix that the
   loser shares with the last winner: only bytes behind that are ever compared. In the merged
   order, contexts of one anchor are neighbours by their common prefixes; the smallest id that
   holds each window of theirs goes back to the groups that have a larger one.
4. Each group covers the windows of its documents and digests the bytes that remain.

The order of suffixes starts with the hash of the anchor, so a bucket's bounds are known without
a sample and buckets are even. Equal contexts are one row for each group. An anchor with
VARIED or more different surroundings in some group is cut into its windows, each a suffix of its
own dealt by its own hash, so a passage in a third of the documents does not meet in one bucket,
however its surroundings differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.llm.common import mix, parts, text_buffer

LENGTH = 50
K = 20
VARIED = 64
SLICE = 1 << 20
_PLACE = 24  # bits of a packed key that hold the position
_HASH = ~np.uint64((1 << _PLACE) - 1)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k bytes from each position, by doubling."""
    h, width, out, done = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    mul = int(_MUL)
    while True:
        if k & width:
            out, done = (h, width) if out is None else (out[: len(h) - done] * np.uint64(pow(mul, width, 1 << 64)) + h[done:], done + width)
        width *= 2
        if width > k:
            return mix(out)
        h = h[: len(h) - width // 2] * np.uint64(pow(mul, width // 2, 1 << 64)) + h[width // 2 :]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of x[i : i + w] for each i."""
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def anchored(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: document, first window, windows, anchor, 40-bit hash of the anchor.

    Works on slices that overlap by a window, so memory does not follow the size of the text.
    """
    w, n = length - K + 1, len(data)
    got: list[list[np.ndarray]] = [[], [], [], [], []]
    for at in range(0, max(0, n - length + 1), SLICE):
        part = data[at : at + SLICE + length - 1]
        h = gram_hashes(part)
        key = (h & _HASH) | np.arange(len(h), dtype=np.uint64)
        low = sliding_min(key, w)
        place = (low & ~_HASH).astype(np.int64)
        start = np.arange(at, at + len(place))
        doc = np.searchsorted(offsets, start, side="right") - 1
        inside = start + length <= offsets[doc + 1]
        new = np.ones(len(place), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | ~inside[:-1]
        first = np.flatnonzero(new & inside)
        if not len(first):
            continue
        ends = np.flatnonzero(np.append(new[1:] | ~inside[1:], True) & inside)
        for store, x in zip(got, (doc[first], start[first], ends - first + 1, place[first] + at, low[first] >> np.uint64(_PLACE)), strict=True):
            store.append(x)
    empty = np.zeros(0, np.int64)
    doc, first, count, place, h = (np.concatenate(x) if x else (empty if k < 4 else empty.astype(np.uint64)) for k, x in enumerate(got))
    return doc, first, count, place, mix(h) >> np.uint64(_PLACE)  # smallest hashes are small: mixed again, they fill their range evenly


def _group(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, their validity, bytes and offsets of a group's documents, by id, so that each call sees one order."""
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    ids = table.column("doc_id")
    data, offsets = text_buffer(table.column("text"))
    return ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(), data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pack(x: np.ndarray | bytes) -> bytes:
    """Compressed bytes with their length in front."""
    raw = x if isinstance(x, bytes) else _bin(x)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(x: bytes) -> bytes:
    return pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True)


def _pack_hashes(h: np.ndarray) -> bytes:
    """Sorted 40-bit hashes as the byte planes of their differences, compressed."""
    step = np.diff(h, prepend=np.uint64(0))
    return _pack(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8)[:, :5].T))


def _unpack_hashes(x: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpack(x), np.uint8).reshape(5, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :5] = planes.T
    return np.cumsum(out.reshape(-1).view(np.uint64), dtype=np.uint64)


def _buckets(hashes: np.ndarray, n: int) -> np.ndarray:
    """The bucket of sorted 40-bit hashes: even steps of their range."""
    return (hashes * np.uint64(n)) >> np.uint64(40)


def _bin(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _varied(h: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of hashes in text order, those that have VARIED or more different neighbours here."""
    ranked = h[order]
    starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.append(starts, len(h)))
    often = np.flatnonzero(size >= VARIED)
    around = mix(np.roll(h, 1) * np.uint64(3) + np.roll(h, -1)) if len(often) else h
    return np.array([ranked[starts[k]] for k in often if len(np.unique(around[order[starts[k] : starts[k] + size[k]]])) >= VARIED], dtype=np.uint64)


def shared_anchors(group: pa.Table, n: int) -> pa.Table:
    """A row for each bucket: the group's different anchors in it, which of them several documents have, and which vary."""
    ids, valid, data, offsets = _group(group)
    doc, _, _, _, h = anchored(data, offsets)
    doc, h = doc[valid[doc]], h[valid[doc]]
    order = np.argsort(h, kind="stable")
    varied = _varied(h, order)
    h, own = h[order], ids[doc][order]
    starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    # shared already here: smallest and largest id differ
    twice = np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts) if len(h) else np.zeros(0, bool)
    h = h[starts]
    many = np.isin(h, varied)
    cut = np.searchsorted(_buckets(h, n).astype(np.int64), np.arange(n + 1))
    some = [k for k in range(n) if cut[k + 1] > cut[k]]
    g = group.column("g")[0].as_py()
    of = lambda f: pa.array([f(slice(cut[k], cut[k + 1])) for k in some], pa.binary())
    return pa.table({
        "b": pa.array(some, pa.int32()), "g": pa.array([g] * len(some), pa.int32()), "h": of(lambda k: _pack_hashes(h[k])),
        "twice": of(lambda k: _bin(np.packbits(twice[k]))), "many": of(lambda k: _bin(np.packbits(many[k])) if many[k].any() else b""),
    })


def answer(bucket: pa.Table) -> pa.Table:
    """For each group, which of its hashes are shared (1), and which of these vary in some group (2)."""
    rows = [_unpack_hashes(x) for x in bucket.column("h").to_pylist()]
    sizes = [len(x) for x in rows]

    def bits(column: str) -> np.ndarray:
        got = [np.unpackbits(np.frombuffer(x, np.uint8), count=s) if x else np.zeros(s, np.uint8) for x, s in zip(bucket.column(column).to_pylist(), sizes, strict=True)]
        return np.concatenate(got).astype(bool)

    values, where, count = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    kind = (count > 1).astype(np.uint8)
    kind[where[bits("twice")]] = 1
    many = np.zeros(len(values), bool)
    many[where[bits("many")]] = True
    mark = np.where(many & (kind > 0), 2, kind).astype(np.uint8)[where]
    cut = np.concatenate(([0], np.cumsum(sizes)))
    own = [mark[cut[k] : cut[k + 1]] for k in range(len(rows))]
    return pa.table({
        "g": bucket.column("g"), "kind": pa.array([0] * len(rows), pa.int32()),
        "x": pa.array([_pack_hashes(h[m > 0]) for h, m in zip(rows, own, strict=True)], pa.binary()), "y": pa.array([_pack(m[m > 0]) for m in own], pa.binary()),
    })


class Contexts:
    """The distinct contexts of a group's shared anchors, in suffix order, and who holds them.

    A context is (key, bytes left of the anchor, windows); key is the suffix: four bytes of hash,
    the text from the anchor on, then the text left of it backwards.
    """

    def __init__(self, group: pa.Table, replies: list[tuple[bytes, bytes]]) -> None:
        ids, valid, data, offsets = _group(group)
        known = [(_unpack_hashes(x), np.frombuffer(_unpack(y), np.uint8)) for x, y in replies]
        h, mark = (np.concatenate([k[i] for k in known] or [np.zeros(0, np.uint64)]) for i in (0, 1))
        order = np.argsort(h)
        h, mark = h[order], mark[order]
        doc, start, count, place, own = anchored(data, offsets)
        if len(h):
            at = np.minimum(np.searchsorted(h, own), len(h) - 1)
            pick = np.flatnonzero(np.where((h[at] == own) & valid[doc], mark[at], 0))
        else:
            at = pick = np.zeros(0, np.int64)
        kind = mark[at[pick]] if len(pick) else pick
        raw = data.tobytes()
        # an anchor that varies is cut into its windows
        each = np.where(kind == 2, count[pick], 1)
        rep = np.repeat(pick, each)
        inner = np.arange(len(rep)) - np.repeat(np.concatenate(([0], np.cumsum(each)[:-1])), each) if len(rep) else rep
        varied = np.repeat(kind == 2, each)
        self.doc, self.start = doc[rep], start[rep] + np.where(varied, inner, 0)
        width = np.where(varied, 1, count[rep])
        seen: dict[tuple[bytes, int, int], int] = {}
        number = []
        for s, c, q, v, m in zip(self.start.tolist(), width.tolist(), place[rep].tolist(), own[rep].tolist(), varied.tolist(), strict=True):
            key = (_digest(raw[s : s + LENGTH]) + raw[s : s + LENGTH], 0, 1) if m else ((v >> 8).to_bytes(4, "big") + raw[q : s + c - 1 + LENGTH] + raw[s:q][::-1], q - s, c)
            number.append(seen.setdefault(key, len(seen)))
        keys = list(seen)
        rank = sorted(range(len(keys)), key=keys.__getitem__)
        place_of = np.empty(len(keys), np.int64)
        place_of[rank] = np.arange(len(keys))
        self.keys = [keys[k] for k in rank]
        self.number = place_of[np.array(number, np.int64)] if number else np.zeros(0, np.int64)
        self.low = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(self.low, self.number, ids[self.doc])


def _digest(window: bytes) -> bytes:
    return hashlib.blake2b(window, digest_size=4).digest()


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """The length of the common prefix of a and b, known to be ``at`` or more."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    step = 16
    while a[at : at + step] == b[at : at + step]:
        at += step
        step *= 2
    while step > 1:
        step //= 2
        if a[at : at + step] == b[at : at + step]:
            at += step
    return at


def front_code(keys: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Of sorted keys, the prefix that each shares with the one before, and what follows it."""
    shared, rest, last = np.zeros(len(keys), np.uint32), [], b""
    for k, key in enumerate(keys):
        n = common(last, key)
        shared[k] = n
        rest.append(key[n:])
        last = key
    return shared, rest


def sorted_runs(c: Contexts, g: int, n: int) -> pa.Table:
    """The group's run cut into a row for each bucket, and a row of who holds each context, which passes a bucket on its way back."""
    first = np.array([int.from_bytes(k[:4], "big") for k, _, _ in c.keys], dtype=np.uint64)
    b = ((first * np.uint64(n)) >> np.uint64(32)).astype(np.int64)
    cut = np.searchsorted(b, np.arange(n + 1))
    rows: dict[str, list] = {x: [] for x in ("b", "g", "base", "shared", "sizes", "rest", "left", "count", "low")}
    for k in range(n):
        lo, hi = int(cut[k]), int(cut[k + 1])
        if lo == hi:
            continue
        own = c.keys[lo:hi]
        shared, rest = front_code([x[0] for x in own])
        left, count = np.array([x[1] for x in own], np.uint16), np.array([x[2] for x in own], np.uint16)
        sizes = np.array([len(r) for r in rest], np.uint32)
        packed = {"shared": shared, "sizes": sizes, "rest": b"".join(rest), "left": left, "count": count, "low": c.low[lo:hi]}
        for name, value in ({"b": k, "g": g, "base": lo} | {n: _pack(x) for n, x in packed.items()}).items():
            rows[name].append(value)
    held = {"shared": c.number.astype(np.int32), "sizes": c.doc.astype(np.int32), "rest": c.start.astype(np.int32 if not len(c.start) or c.start.max() < 1 << 31 else np.int64), "left": b"", "count": np.array([k[2] for k in c.keys], np.uint16), "low": c.low}
    for name, value in ({"b": g % n, "g": g, "base": -1} | {k: _pack(x) for k, x in held.items()}).items():
        rows[name].append(value)
    kinds = {"b": pa.int32(), "g": pa.int32(), "base": pa.int32()}
    return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in rows.items()})


RUNS = "b int, g int, base int, shared binary, sizes binary, rest binary, left binary, count binary, low binary"


def decoded(shared: bytes, sizes: bytes, rest: bytes) -> Iterator[tuple[bytes, int]]:
    """The keys of a front-coded run with the prefix that each shares with the one before."""
    last, at = b"", 0
    for n, size in zip(np.frombuffer(shared, np.uint32).tolist(), np.frombuffer(sizes, np.uint32).tolist(), strict=True):
        last = last[:n] + rest[at : at + size]
        at += size
        yield last, n


def merge(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, bytes, int]]:
    """(run, key, prefix shared with the key before) in order, by a loser tree.

    A node keeps the loser of its match and the prefix it shares with the winner that passed.
    Both sides of a match share a known prefix with the last key put out; if these differ, the
    one that shares more is the smaller and nothing is compared. Else comparing starts behind it.
    """
    size = 1
    while size < max(1, len(runs)):
        size *= 2
    heads: list[bytes | None] = [None] * size
    lcp = [0] * size
    steps = [iter(r) for r in runs]
    for k, r in enumerate(steps):
        heads[k] = next(r, (None, 0))[0]
    tree = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs' heads; the loser's lcp becomes that with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        n = common(x, y, lcp[a])
        if x[n:] <= y[n:] if n >= len(x) or n >= len(y) else x[n] < y[n]:
            lcp[b] = n
            return a, b
        lcp[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        win, lose = play(build(2 * node), build(2 * node + 1))
        tree[node] = lose
        return win

    win = build(1) if size > 1 else 0
    while heads[win] is not None:
        yield win, heads[win], lcp[win]
        heads[win], lcp[win] = next(steps[win], (None, 0))
        node = (win + size) // 2
        while node:
            other = tree[node]
            winner, loser = play(win, other)
            tree[node] = loser
            win = winner
            node //= 2


def resolve(bucket: pa.Table) -> pa.Table:
    """Merges a bucket's runs and answers each group: (context, from window, to window, smallest id) where smaller than its own."""
    own = bucket.filter(pa.compute.less(bucket.column("base"), 0))
    bucket = bucket.filter(pa.compute.greater_equal(bucket.column("base"), 0))
    rows = [{k: _unpack(v) if isinstance(v, bytes) else v for k, v in r.items()} for r in bucket.to_pylist()]
    meta = [(np.frombuffer(r["left"], np.uint16).tolist(), np.frombuffer(r["count"], np.uint16).tolist(), np.frombuffer(r["low"], np.int64).tolist()) for r in rows]
    at = [0] * len(rows)
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in rows]

    def tell(members: list[tuple[int, int]], mins: list[int]) -> None:
        for run, k in members:
            own, spans = meta[run][2][k], []
            for j, m in enumerate(mins):
                if m < own:
                    if spans and spans[-1][1] == j and spans[-1][2] == m:
                        spans[-1][1] = j + 1
                    else:
                        spans.append([j, j + 1, m])
            out[run] += [(rows[run]["base"] + k, a, b, m) for a, b, m in spans]

    def settle(group: dict[tuple[bytes, int, int], list[tuple[int, int]]]) -> None:
        """group: who holds each distinct context of one anchor."""
        if len(group) == 1:
            (((_, _, n), members),) = group.items()
            if len(members) > 1:
                low = min(meta[r][2][k] for r, k in members)
                for run, k in members:
                    if low < meta[run][2][k]:
                        out[run].append((rows[run]["base"] + k, 0, n, low))
            return
        best: dict[bytes, int] = {}
        windows = []
        for (key, left, n), members in group.items():
            right = key[4 : len(key) - left]
            text = key[len(key) - left :][::-1] + right if left else right
            low = min(meta[r][2][k] for r, k in members)
            # the place of the anchor is part of the window: equal strings have it at one place
            own = [text[j : j + LENGTH] for j in range(n)]
            windows.append((members, own))
            for x in own:
                have = best.get(x)
                if have is None or low < have:
                    best[x] = low
        for members, own in windows:
            tell(members, [best[x] for x in own])

    group: dict[tuple[bytes, int, int], list[tuple[int, int]]] = {}
    for run, key, shared in merge([decoded(r["shared"], r["sizes"], r["rest"]) for r in rows]):
        if shared < 4 + K and group:
            settle(group)
            group = {}
        k = at[run]
        at[run] += 1
        group.setdefault((key, meta[run][0][k], meta[run][1][k]), []).append((run, k))
    if group:
        settle(group)
    xs = [_pack(np.array([t[:3] for t in o], np.int32)) for o in out]
    ys = [_pack(np.array([t[3] for t in o], np.int64)) for o in out]
    told = pa.table({"g": bucket.column("g"), "kind": pa.array([1] * len(rows), pa.int32()), "x": pa.array(xs, pa.binary()), "y": pa.array(ys, pa.binary())})
    # who holds the contexts: on to its group, in two rows
    passed = [pa.table({"g": own.column("g"), "kind": pa.array([k] * own.num_rows, pa.int32()), "x": own.column(x), "y": own.column(y)}) for k, x, y in ((2, "shared", "sizes"), (3, "rest", "low"), (4, "count", "left"))]
    return pa.concat_tables([told, *passed])


def _replies(table: pa.Table, kind: int) -> list[tuple[bytes, bytes]]:
    return [(x, y) for k, x, y in zip(*(table.column(c).to_pylist() for c in ("kind", "x", "y")), strict=True) if k == kind]


def covered(group: pa.Table, replies: pa.Table) -> pa.Table:
    """The result row of each document of a group."""
    ids_, valid, data, offsets = _group(group)
    ids = ids_.tolist()
    marks = np.zeros(len(data) + LENGTH + 1, np.int32)
    part = {k: [(_unpack(x), _unpack(y)) for x, y in _replies(replies, k)] for k in (1, 2, 3, 4)}
    if part[2]:
        number, doc = (np.frombuffer(x, np.int32) for x in part[2][0])
        start = np.frombuffer(part[3][0][0], np.int32 if len(part[3][0][0]) == 4 * len(number) else np.int64).astype(np.int64)
        low, count = np.frombuffer(part[3][0][1], np.int64), np.frombuffer(part[4][0][0], np.uint16).astype(np.int64)
        later = low[number] < ids_[doc]
        np.add.at(marks, start[later], 1)
        np.add.at(marks, start[later] + count[number[later]] - 1 + LENGTH, -1)
        # others have it under a smaller id: for the documents that have the group's smallest
        order = np.argsort(number, kind="stable")
        ranked = number[order]
        for x, y in part[1]:
            spans, least = np.frombuffer(x, np.int32).reshape(-1, 3), np.frombuffer(y, np.int64)
            lo, hi = np.searchsorted(ranked, spans[:, 0]), np.searchsorted(ranked, spans[:, 0], side="right")
            for (_, a, b), m, i, j in zip(spans.tolist(), least.tolist(), lo.tolist(), hi.tolist(), strict=True):
                for k in order[i:j].tolist():
                    if m < ids[doc[k]]:
                        marks[start[k] + a] += 1
                        marks[start[k] + b - 1 + LENGTH] -= 1
    gone = np.cumsum(marks[: len(data)]) > 0
    rows = []
    for d in range(len(ids)):
        lo, hi = int(offsets[d]), int(offsets[d + 1])
        own = gone[lo:hi]
        spans = int((own[1:] & ~own[:-1]).sum() + own[0]) if hi > lo else 0
        rows.append((ids[d] if valid[d] else None, hi - lo, int(own.sum()), spans, hashlib.sha256(data[lo:hi][~own].tobytes()).hexdigest()))
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return pa.table({n: pa.array([r[k] for r in rows], pa.string() if k == 4 else pa.int64()) for k, n in enumerate(names)})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of docs (doc_id, text).

    A null text is empty; texts of fewer than 50 bytes lose nothing; of equal texts the one with
    the smallest id keeps its bytes; rows that repeat an id are not repeats of each other; rows
    without an id neither lose bytes nor make others lose any. An empty table gives an empty
    result. Other columns are ignored.
    """
    n = parts(docs.sparkSession)
    groups = 3 * n
    dealt = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("g"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    reply = "g int, kind int, x binary, y binary"
    known = dealt.groupBy("g").applyInArrow(lambda t: shared_anchors(t, n), "b int, g int, h binary, twice binary, many binary").groupBy("b").applyInArrow(answer, reply)

    def runs_of(group: pa.Table, replies: pa.Table) -> pa.Table:
        return sorted_runs(Contexts(group, _replies(replies, 0)), group.column("g")[0].as_py(), n)

    runs = dealt.groupBy("g").cogroup(known.groupBy("g")).applyInArrow(runs_of, RUNS)
    lows = runs.groupBy("b").applyInArrow(resolve, reply)
    return dealt.groupBy("g").cogroup(lows.groupBy("g")).applyInArrow(covered, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
