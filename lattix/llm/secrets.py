"""Secret scan: fixed patterns, and a linear-chain conditional random field that adds spans.

Every text is cut into tokens, runs of the characters that keys and passwords are made of, and all
tokens are tagged begin, inside or outside. Tokens with nothing but separators between them are
a chain, each decoded by Viterbi. Features are the token's shape (length, character classes,
entropy, first characters), the tokens around it and what is between, and the file's own
statistics; all are numbers of arrays over a chunk of texts. A chain in which no token gains
enough by being in a span to pay for the transitions is outside as a whole (``threshold``), so
Viterbi runs on the others alone, many side by side, with the same tags. The field is trained by
gradient ascent on its likelihood, on tokens of the
``sample`` documents that come first by a digest of the id; spans of the fixed patterns there
(of an assignment, what is assigned) are the labels, and chains with a match that is too short for its pattern are left out. Where
the field tags a span that touches none of the fixed ones, that span is added.

Each document is scanned by itself: no shuffle but that of the bounded training sample.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattix.llm.common import chunks, mix, span_hashes

KINDS = ("assign", "access", "hex", "crf")
SAMPLE = 20_000
TOKENS = 16
DIM = 1 << 14
O, B, I = range(3)
STEPS = 120
# Fixed patterns, and the least length of what they must match.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

_TOKEN_BYTES = np.zeros(256, dtype=bool)
_TOKEN_BYTES[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.-~@#$%^&*")] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[list(b"0123456789")] = True
_HEX = np.zeros(256, dtype=bool)
_HEX[list(b"0123456789abcdef")] = True
_SIGNS = np.zeros(256, dtype=bool)
_SIGNS[list(b" \t\r\n\"':=")] = True
_SEPARATORS = np.zeros(256, dtype=bool)
_SEPARATORS[list(b" \t\r\n\"'`,;:=|()[]{}<>")] = True
#: Bytes between two tokens of a chain, at most.
GAP = 8
#: Tokens shorter than this have no entropy among their features.
ENTROPY = 6


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and not overlapping within a kind, ordered."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def label_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the secrets themselves in what the fixed patterns match."""
    return sorted([m.span(2) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12] + [(s, e) for s, kind, e in base_spans(text) if kind])


def unsure_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of what the patterns match but is too short for them: neither a secret nor none."""
    return [m.span(2) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) < 12] + [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() < 18]


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: starts, ends and document numbers of its tokens."""
    ok = np.zeros(len(data) + 2, dtype=bool)
    ok[1:-1] = _TOKEN_BYTES[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    starts = np.flatnonzero(ok[1:-1] & (~ok[:-2] | cut[:-1]))
    ends = np.flatnonzero(ok[1:-1] & (~ok[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _flagged(data: np.ndarray, offsets: np.ndarray) -> set[int]:
    """The documents of a chunk that the fixed patterns can match in."""
    flag = np.zeros(len(offsets) - 1, dtype=bool)
    not_hex = np.flatnonzero(~_HEX[data])
    run = np.diff(np.concatenate(([-1], not_hex, [len(data)])))
    at = np.concatenate(([-1], not_hex))[run > 16] + 1
    for a, size in zip(at.tolist(), run[run > 16].tolist(), strict=True):
        first = int(np.searchsorted(offsets, a, side="right")) - 1
        last = int(np.searchsorted(offsets, a + size - 2, side="right")) - 1
        flag[first : last + 1] = True
    raw = data.tobytes()
    low = raw.lower()
    for where, what in ((raw, b"AKIA"), *((low, w) for w in WORDS)):
        k = where.find(what)
        while k >= 0:
            d = int(np.searchsorted(offsets, k, side="right")) - 1
            flag[d] = True
            k = where.find(what, int(offsets[d + 1]) - len(what) + 1 if offsets[d + 1] - len(what) + 1 > k else k + 1)
    return set(np.flatnonzero(flag).tolist())


def _begins(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether a chain begins with each token: the document does, or what is before is long or no separator."""
    other = np.concatenate(([0], np.cumsum(~_SEPARATORS[data])))
    out = np.ones(len(starts), dtype=bool)
    out[1:] = (docs[1:] != docs[:-1]) | (starts[1:] - ends[:-1] > GAP) | (other[starts[1:]] > other[ends[:-1]])
    return out


def _shifted(values: np.ndarray, by: int, docs: np.ndarray) -> np.ndarray:
    """The value of the token ``by`` places before (after, if negative) in the same document, else 0."""
    out = np.zeros_like(values)
    if len(values) > abs(by):
        here, there = (slice(by, None), slice(None, -by)) if by > 0 else (slice(None, by), slice(-by, None))
        out[here] = np.where(docs[here] == docs[there], values[there], 0)
    return out


def _entropy(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bits of entropy of the bytes of each token."""
    n = ends - starts
    first = np.cumsum(n) - n
    at = np.repeat(starts - first, n) + np.arange(n.sum())
    letters = np.sort(np.repeat(np.arange(len(n)), n) * 256 + data[at])
    new = np.flatnonzero(np.concatenate(([True], letters[1:] != letters[:-1])))
    times = np.diff(np.concatenate((new, [len(letters)])))
    return np.log2(n) - np.bincount(letters[new] >> 8, times * np.log2(times), len(n)) / n


def features(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, docs: np.ndarray, begins: np.ndarray) -> Iterator[np.ndarray]:
    """Feature numbers of all tokens of a chunk, one kind after the other."""
    if not len(starts):
        return
    n = ends - starts

    def count(which: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(which, dtype=np.int32)))
        return sums[ends] - sums[starts]

    def before(k: int) -> np.ndarray:
        """The k-th byte before each token, 0 where that is not between it and the one before."""
        at = starts - k
        return np.where(at >= floor, data[np.maximum(at, 0)], 0).astype(np.uint64)

    lower, upper, digit = count((data >= 97) & (data <= 122)), count((data >= 65) & (data <= 90)), count(_DIGIT[data])
    shape = (lower > 0) * 8 + (upper > 0) * 4 + (digit > 0) * 2 + (lower + upper + digit < n)
    entropy = np.full(len(n), -1)
    long = n >= ENTROPY
    if long.any():
        entropy[long] = 2 * _entropy(data, starts[long], ends[long])
    head = np.zeros(len(n), dtype=np.uint64)
    for k in range(4):
        head = head << np.uint64(8) | np.where(n > k, data[np.minimum(starts + k, len(data) - 1)], 0).astype(np.uint64)
    ahead = np.concatenate(([0], ends[:-1]))
    floor = np.where(np.concatenate(([True], docs[1:] != docs[:-1])), offsets[docs], ahead)
    gap, seen = np.zeros(len(n), dtype=np.uint64), np.zeros(len(n), dtype=np.int8)
    for k in range(1, 7):  # up to three bytes that are no blanks
        byte = before(k)
        take = (byte > 32) & (seen < 3)
        gap = np.where(take, gap << np.uint64(8) | byte, gap)
        seen += take
    odd = np.concatenate(([0], np.cumsum(~_SIGNS[data])))
    signed = (odd[starts] == odd[floor]) & (starts > floor)
    tail = span_hashes(data, np.maximum(starts, ends - 16), ends)
    named = span_hashes(data, np.maximum(starts, ends - 12), ends)
    digits = np.concatenate(([0], np.cumsum(_DIGIT[data])))[offsets]
    kinds = (
        0, np.minimum(n, 64) // 4, shape, entropy, 8 * digit // n, count(_HEX[data]) == n, digit == n, count(data == 64) > 0, np.minimum(count(data == 46), 4),
        head, shape * 16 + np.minimum(n, 64) // 8, gap, np.where(signed, _shifted(named, 1, docs), 0), _shifted(tail, 1, docs), _shifted(tail, 2, docs),
        _shifted(span_hashes(data, starts, np.minimum(ends, starts + 16)), -1, docs), begins, gap * np.uint64(16) + shape.astype(np.uint64),
        np.log2(1 + np.diff(digits)).astype(np.int64)[docs], np.log2(1 + np.diff(offsets)).astype(np.int64)[docs],
    )
    for kind, value in enumerate(kinds):
        value = np.broadcast_to(np.asarray(value), n.shape)
        value = value if value.dtype == np.uint64 else value.astype(np.int64).view(np.uint64)
        yield (mix(value + np.uint64((kind + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(40)).astype(np.int64) % DIM


def forward_backward(unary: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log partition, tag marginals and pair marginals of chains of one length; unary is (chains, length, 3)."""
    n, length, _ = unary.shape
    alpha, beta = np.empty_like(unary), np.zeros_like(unary)
    alpha[:, 0] = unary[:, 0]
    for t in range(1, length):
        alpha[:, t] = np.logaddexp.reduce(alpha[:, t - 1, :, None] + trans, axis=1) + unary[:, t]
    for t in range(length - 2, -1, -1):
        beta[:, t] = np.logaddexp.reduce(trans + (unary[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
    z = np.logaddexp.reduce(alpha[:, -1], axis=1)
    pairs = np.zeros((3, 3))
    for t in range(1, length):
        pairs += np.exp(alpha[:, t - 1, :, None] + trans + (unary[:, t] + beta[:, t])[:, None, :] - z[:, None, None]).sum(axis=0)
    return z, np.exp(alpha + beta - z[:, None, None]), pairs


FORBIDDEN = -1e4  # inside never comes first or after outside


def train(groups: dict[int, tuple[np.ndarray, np.ndarray]], steps: int = STEPS, penalty: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """(weights (DIM, 3), transitions (3, 3)) from chains by length: features (n, length, k) and tags (n, length)."""
    w, trans = np.zeros((DIM, 3)), np.zeros((3, 3))
    trans[O, I] = FORBIDDEN
    mw, vw, mt, vt = np.zeros_like(w), np.zeros_like(w), np.zeros((3, 3)), np.zeros((3, 3))
    total = sum(len(y) for _, y in groups.values())
    for step in range(1, steps + 1):
        gw, gt = -penalty * w / total, -penalty * trans / total
        for x, y in groups.values():
            unary = w[x].sum(axis=2)
            unary[:, 0, I] += FORBIDDEN
            _, tags, pairs = forward_backward(unary, trans)
            delta = (np.eye(3)[y] - tags) / total
            for c in range(3):
                gw[:, c] += np.bincount(x.ravel(), np.repeat(delta[:, :, c].ravel(), x.shape[2]), minlength=DIM)
            np.add.at(gt, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1 / total)
            gt -= pairs / total
        gt[O, I] = 0
        mw, vw, mt, vt = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw**2, 0.9 * mt + 0.1 * gt, 0.99 * vt + 0.01 * gt**2
        a, b = 1 - 0.9**step, 1 - 0.99**step
        w += 0.1 * (mw / a) / (np.sqrt(vw / b) + 1e-8)
        trans += 0.1 * (mt / a) / (np.sqrt(vt / b) + 1e-8)
    return w, trans


def viterbi(unary: np.ndarray, trans: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """The best tags of chains that lie one after the other; unary is (tokens, 3), sizes their lengths (one chain, if none)."""
    sizes = np.array([len(unary)]) if sizes is None else sizes
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    left = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")  # chains that have a token at each place
    best = unary[first] + np.array([0, 0, FORBIDDEN])
    final, back = best.copy(), np.zeros((len(unary), 3), dtype=np.int8)
    for t in range(1, int(sizes[0])):
        a = left[t]
        ways = best[:a, :, None] + trans
        at = first[:a] + t
        back[at] = ways.argmax(axis=1)
        best = ways.max(axis=1) + unary[at]
        final[:a] = best
    tags = np.zeros(len(unary), dtype=np.int8)
    now = final.argmax(axis=1)
    tags[first + sizes - 1] = now
    for t in range(int(sizes[0]) - 1, 0, -1):
        a = left[t]
        now[:a] = back[first[:a] + t, now[:a]]
        tags[first[:a] + t - 1] = now[:a]
    return tags


def threshold(trans: np.ndarray) -> float:
    """What a token must gain by being in a span, over being outside, for a span that holds it to pay.

    A span of the best tags gains at least nothing over the same tokens outside. Transitions give
    it at most what follows for its first token and for each other one; so if all its tokens gain less than
    the greater of the two costs, it is not among the best tags.
    """
    enter = max(0.0, *(trans[:, B] - trans[:, O]))
    leave = max(0.0, *(trans[y, q] - trans[O, q] for y in (B, I) for q in (O, B)))
    return -max(enter + leave, max(trans[B, I], trans[I, I]) - trans[O, O])


def _spans(data: np.ndarray, offsets: np.ndarray, w: np.ndarray, trans: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(document, start, end) of what the field tags in a chunk, bytes of the chunk, in order."""
    starts, ends, docs = _tokens(data, offsets)
    begins = _begins(data, starts, ends, docs)
    unary = np.zeros((len(starts), 3))
    for x in features(data, offsets, starts, ends, docs, begins):
        unary += w[x]
    hot = np.maximum(unary[:, B], unary[:, I]) - unary[:, O] >= threshold(trans)
    chain = np.cumsum(begins) - 1
    if not hot.any():
        return
    some = np.zeros(chain[-1] + 1, dtype=bool)
    some[chain[hot]] = True
    at = np.flatnonzero(some[chain])
    tags = viterbi(unary[at], trans, np.bincount(chain)[some])
    for k in np.flatnonzero(tags == B).tolist():
        m = k
        while m + 1 < len(tags) and tags[m + 1] == I:  # inside never comes first in a chain
            m += 1
        yield int(docs[at[k]]), int(starts[at[k]]), int(ends[at[m]])


def _byte_places(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of characters as spans of bytes, in one pass over the text."""
    at, size, places = 0, 0, {}
    for p in sorted({p for span in spans for p in span}):
        size += len(text[at:p].encode())
        at = p
        places[p] = size
    return [(places[s], places[e]) for s, e in spans]


def _char_places(raw: bytes) -> np.ndarray:
    """The characters before each byte, and before the end."""
    return np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))


def _nearest(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]], tokens: int) -> np.ndarray:
    """The tokens that are nearest to a span, the first of equals, in order."""
    if not spans:
        return np.arange(min(tokens, len(starts)))
    own = np.array(sorted(spans))
    reach = np.maximum.accumulate(own[:, 1])
    k = np.searchsorted(own[:, 0], ends, side="right")
    far = np.iinfo(np.int64).max
    left = np.where(k > 0, np.maximum(0, starts - reach[np.maximum(k - 1, 0)]), far)
    right = np.where(k < len(own), own[np.minimum(k, len(own) - 1), 0] - ends, far)
    return np.sort(np.argsort(np.minimum(left, right), kind="stable")[:tokens])


def _untouched(added: list[tuple[int, int, int]], found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The added spans that share nothing with those found, which are in order."""
    starts = [s for s, _, _ in found]
    reach = list(accumulate((e for _, _, e in found), max))
    out = []
    for a in added:
        k = bisect_left(starts, a[2])
        if not k or reach[k - 1] <= a[0]:
            out.append(a)
    return out


def _labelled(own: np.ndarray, starts: np.ndarray, ends: np.ndarray, begins: np.ndarray, spans: list[tuple[int, int]], unsure: list[tuple[int, int]]) -> tuple[list[int], list[int], list[int]]:
    """Tokens of a document's sample, their tags, and the lengths of their chains; without chains that touch an unsure span."""
    keep, tags, sizes = [], [], []
    new = begins[own].copy()
    if len(own):
        new[0] = True
        new[1:] |= np.diff(own) > 1
    spans = sorted(spans)
    for part in np.split(own, np.flatnonzero(new)[1:]) if len(own) else []:
        places = list(zip(starts[part].tolist(), ends[part].tolist(), strict=True))
        if any(a < e and b > s for s, e in places for a, b in unsure):
            continue
        y, inside = [], -1
        for s, e in places:
            k = bisect_left(spans, (e,)) - 1  # the last that begins before the token ends
            hit = next((m for m in range(max(0, k - 2), k + 1) if spans[m][1] > s), -1)
            y.append(O if hit < 0 else I if hit == inside else B)
            inside = hit
        keep += part.tolist()
        tags += y
        sizes.append(len(part))
    return keep, tags, sizes


def fit(docs: DataFrame, sample: int = SAMPLE, tokens: int = TOKENS) -> tuple[np.ndarray, np.ndarray] | None:
    """The field, trained on at most ``sample`` documents; None if none of them has a secret.

    What reaches the driver is tags and feature numbers of the chains in the sample: of each
    document the ``tokens`` tokens that are nearest to its secrets, at most, and of one without secrets a quarter
    as many, in a row from a place that its digest names. Of the texts of an id that repeats, that
    with the smallest digest is taken.
    """
    picked = docs.select("doc_id").where("doc_id is not null").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked.distinct()), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text")  # at most ``sample`` ids

    def tagged(batches):
        for batch in batches:
            ids, marks, found = batch.column("doc_id").to_pylist(), [], []
            for i, j, data, offsets in chunks(batch.column("text")):
                starts, ends, docs = _tokens(data, offsets)
                begins = _begins(data, starts, ends, docs)
                edge, flagged, keep, tags, sizes = np.searchsorted(docs, np.arange(j - i + 1)), _flagged(data, offsets), [], [], []
                for d in range(j - i):
                    lo, hi = int(offsets[d]), int(offsets[d + 1])
                    raw = data[lo:hi].tobytes()
                    mark = hashlib.blake2b(raw, digest_size=8).digest()
                    marks.append((ids[i + d], mark))
                    spans, unsure = [], []
                    if d in flagged:
                        text = raw.decode("utf-8", "replace")
                        spans, unsure = (_byte_places(text, x) for x in (label_spans(text), unsure_spans(text)))
                    own = np.arange(edge[d], edge[d + 1])
                    few = tokens if spans else max(1, tokens // 4)
                    if len(own) > few:
                        first = int.from_bytes(mark, "little") % (len(own) - few + 1)
                        own = own[_nearest(starts[own] - lo, ends[own] - lo, spans, few)] if spans else own[first : first + few]
                    mine, y, size = _labelled(own, starts - lo, ends - lo, begins, spans, unsure)
                    keep += mine
                    tags.append(y)
                    sizes.append(size)
                x = np.zeros((len(keep), 0), dtype=np.uint16)
                if keep:
                    x = np.stack([f[keep] for f in features(data, offsets, starts, ends, docs, begins)], axis=1).astype(np.uint16)
                at = 0
                for y, size in zip(tags, sizes, strict=True):
                    found.append((np.array(size, dtype=np.int32).tobytes(), np.array(y, dtype=np.uint8).tobytes(), x[at : at + len(y)].tobytes()))
                    at += len(y)
            columns = ([m[0] for m in marks], [m[1] for m in marks], *([f[k] for f in found] for k in range(3)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k else pa.int64()) for k, c in enumerate(columns)], ["doc_id", "mark", "size", "y", "x"])

    groups: dict[int, list] = {}
    positive = 0
    chains_of = rows.mapInArrow(tagged, "doc_id long, mark binary, size binary, y binary, x binary")
    for r in chains_of.groupBy("doc_id").agg(F.min_by(F.struct("size", "y", "x"), "mark").alias("c")).select("c.*").toLocalIterator():  # a row for each id
        y = np.frombuffer(r["y"], np.uint8).astype(np.int64)
        x = np.frombuffer(r["x"], np.uint16).reshape(len(y), -1) if len(y) else None
        positive += int((y != O).sum())
        at = 0
        for n in np.frombuffer(r["size"], np.int32).tolist():
            groups.setdefault(n, []).append((x[at : at + n], y[at : at + n]))
            at += n
    if not positive:
        return None
    return train({n: (np.array([x for x, _ in g]), np.array([y for _, y in g])) for n, g in groups.items()})


def finder(field: tuple[np.ndarray, np.ndarray] | None) -> Callable[[pa.Array], list[list[tuple[int, int, int]]]]:
    """What finds the spans (start, kind, end) of each text of a column, in order; it travels with its weights. Null counts as empty."""
    packed = None
    if field is not None:
        at = np.flatnonzero(np.abs(field[0]).sum(axis=1) > 1e-6).astype(np.int32)
        packed = (at, field[0][at].astype(np.float32), field[1])

    def find(column: pa.Array) -> list[list[tuple[int, int, int]]]:
        w = None
        if packed is not None:
            w = np.zeros((DIM, 3))
            w[packed[0]] = packed[1]
        out: list[list] = [[] for _ in range(len(column))]
        for i, j, data, offsets in chunks(column):
            added: dict[int, list[tuple[int, int]]] = {}
            for d, s, e in _spans(data, offsets, w, packed[2]) if w is not None else ():
                added.setdefault(d, []).append((s, e))
            flagged = _flagged(data, offsets)
            for d in sorted(flagged | added.keys()):
                lo = int(offsets[d])
                raw = data[lo : offsets[d + 1]].tobytes()
                found = base_spans(raw.decode("utf-8")) if d in flagged else []
                if d in added:
                    chars = _char_places(raw)
                    found = sorted(found + _untouched([(int(chars[s - lo]), 3, int(chars[e - lo])) for s, e in added[d]], found))
                out[i + d] = found
        return out

    return find


def scan(text: Column, field: tuple[np.ndarray, np.ndarray] | None) -> Column:
    """array<struct<start, end, kind>> of each text's spans by start, then kind; null counts as empty."""
    find, kind = finder(field), pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    @F.arrow_udf("array<struct<start:long,end:long,kind:string>>")
    def spans_of(column: pa.Array) -> pa.Array:
        return pa.array([[{"start": s, "end": e, "kind": KINDS[k]} for s, k, e in own] for own in find(column)], pa.list_(kind))

    return spans_of(text)


def find_secrets(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, spans) of each row of docs (doc_id, text): array<struct<start, end, kind>> in code points.

    Kinds are assign, access and hex for the fixed patterns and crf for what the field adds.
    A null or empty text has no span; rows that repeat an id or a text are scanned one by one;
    without a secret in the training sample the field adds nothing. Other columns are ignored.
    """
    return docs.select("doc_id", scan(F.col("text"), fit(docs, sample)).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]", sample: int = SAMPLE) -> DataFrame:
    """docs with each secret's text replaced by the mark (overlapping spans by one).

    All rows and columns stay; a column n_chars follows the text.
    """
    find = finder(fit(docs, sample))

    @F.arrow_udf("string")
    def cut(texts: pa.Array) -> pa.Array:  # scans and cuts, so that a task needs one Python worker
        out = []
        for text, own in zip(texts, find(texts), strict=True):
            text = text.as_py()
            if own:
                parts, at = [], 0
                for start, _, end in own:
                    if end <= at:
                        continue
                    if start >= at:
                        parts += [text[at:start], mark]
                    at = end
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pa.array(out, pa.string())

    out = docs.withColumn("text", cut(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def digest(found: DataFrame) -> DataFrame:
    """The counts and joined spans of find_secrets()'s rows."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("crf"))
