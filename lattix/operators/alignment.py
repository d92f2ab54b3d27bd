"""Local alignment with affine gaps (Smith-Waterman after Gotoh), in Arrow batches.

No expression of Spark's computes it. Many pairs are aligned together, a row of each matrix at a
time: scores that end in a gap along the row come from a running maximum, so numpy does all cells of
the rows together. Rows are all that is kept, whatever the lengths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, EXTEND = -10.0, -0.5
# The BLOSUM62 substitution scores.
LETTERS = "ARNDCQEGHILKMFPSTWYVBZX*"
BLOSUM62 = """
 4 -1 -2 -2  0 -1 -1  0 -2 -1 -1 -1 -1 -2 -1  1  0 -3 -2  0 -2 -1  0 -4
-1  5  0 -2 -3  1  0 -2  0 -3 -2  2 -1 -3 -2 -1 -1 -3 -2 -3 -1  0 -1 -4
-2  0  6  1 -3  0  0  0  1 -3 -3  0 -2 -3 -2  1  0 -4 -2 -3  3  0 -1 -4
-2 -2  1  6 -3  0  2 -1 -1 -3 -4 -1 -3 -3 -1  0 -1 -4 -3 -3  4  1 -1 -4
 0 -3 -3 -3  9 -3 -4 -3 -3 -1 -1 -3 -1 -2 -3 -1 -1 -2 -2 -1 -3 -3 -2 -4
-1  1  0  0 -3  5  2 -2  0 -3 -2  1  0 -3 -1  0 -1 -2 -1 -2  0  3 -1 -4
-1  0  0  2 -4  2  5 -2  0 -3 -3  1 -2 -3 -1  0 -1 -3 -2 -2  1  4 -1 -4
 0 -2  0 -1 -3 -2 -2  6 -2 -4 -4 -2 -3 -3 -2  0 -2 -2 -3 -3 -1 -2 -1 -4
-2  0  1 -1 -3  0  0 -2  8 -3 -3 -1 -2 -1 -2 -1 -2 -2  2 -3  0  0 -1 -4
-1 -3 -3 -3 -1 -3 -3 -4 -3  4  2 -3  1  0 -3 -2 -1 -3 -1  3 -3 -3 -1 -4
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4 -2  2  0 -3 -2 -1 -2 -1  1 -4 -3 -1 -4
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5 -1 -3 -1  0 -1 -3 -2 -2  0  1 -1 -4
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5  0 -2 -1 -1 -1 -1  1 -3 -1 -1 -4
-2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6 -4 -2 -2  1  3 -1 -3 -3 -1 -4
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7 -1 -1 -4 -3 -2 -2 -1 -2 -4
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4  1 -3 -2 -2  0  0  0 -4
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5 -2 -2  0 -1 -1  0 -4
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11  2 -3 -4 -3 -2 -4
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7 -1 -3 -2 -1 -4
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4 -3 -2 -1 -4
-2 -1  3  4 -3  0  1 -1  0 -3 -4  0 -3 -3 -2  0 -1 -4 -3 -3  4  1 -1 -4
-1  0  0  1 -3  3  4 -2  0 -3 -3  1 -1 -3 -1  0 -1 -3 -2 -2  1  4 -1 -4
 0 -1 -1 -1 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -2  0  0 -2 -1 -1 -1 -1 -1 -4
-4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4  1
"""
_SCORES = np.array(BLOSUM62.split(), dtype=float).reshape(len(LETTERS), -1)
_NUMBER = np.full(256, LETTERS.index("X"))
for _k, _c in enumerate(LETTERS):
    _NUMBER[ord(_c)] = _NUMBER[ord(_c.lower())] = _k
#: The same with a letter that fills pairs up and matches nothing.
_PADDED = np.pad(_SCORES, (0, 1), constant_values=-1e9).astype(np.float32)
#: Letters of the rows that are computed together, but TOGETHER pairs at least up to MOST_CELLS, and pairs that are sorted by length together.
TOGETHER, MOST_CELLS = 256, 1 << 20
CELLS, PAIRS = 1 << 15, 4096
KIND = "align_score double, parent_start int, parent_end int, query_start int, query_end int"


def _codes(s: str) -> np.ndarray:
    return _NUMBER[np.frombuffer(s.encode("latin-1", "replace"), dtype=np.uint8)]


def _chosen(first: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a where first, else b: without branches, as neither is rare."""
    return b + first * (a - b)


def _batch(targets: list[np.ndarray], queries: list[np.ndarray], open_: float, extend: float) -> np.ndarray:
    """(score, target start, target end, query start, query end) of each pair, all zero where nothing aligns.

    All pairs move down their targets together, a row of each at a time; an array has a column for
    each pair. Each cell carries where the alignment that ends in it begins, so no matrix is kept
    and nothing is traced back.
    """
    pairs, n, m = len(targets), max(map(len, targets)), max(map(len, queries))
    t, q = np.full((n, pairs), len(LETTERS)), np.full((m, pairs), len(LETTERS))
    for k, (x, y) in enumerate(zip(targets, queries, strict=True)):
        t[: len(x), k], q[: len(y), k] = x, y
    table, t = _PADDED.ravel(), (t * len(_PADDED)).astype(np.int32)
    q = q.astype(np.int32)
    # halves and whole numbers are exact in 32 bits
    h, down = np.zeros((m + 1, pairs), np.float32), np.full((m + 1, pairs), -np.inf, np.float32)
    # a cell's alignment begins at letter (code // (m + 1), code % (m + 1))
    start, start_down = np.zeros((m + 1, pairs), np.int32), np.zeros((m + 1, pairs), np.int32)
    place = np.arange(m + 1, dtype=np.int32)[:, None]
    slope, open_, extend = np.float32(extend) * place.astype(np.float32), np.float32(open_), np.float32(extend)
    best, out = np.zeros(pairs, np.float32), np.zeros((pairs, 5))
    for i in range(1, n + 1):
        # in a gap of the query: opened here or, if that is better, going on
        opened = h + open_
        down += extend
        start_down = _chosen(down > opened, start_down, start)
        np.maximum(down, opened, out=down)
        match = np.take(table, q + t[i - 1])
        match += h[:-1]
        begin = _chosen(h[:-1] > 0, start[:-1], (i - 1) * (m + 1) + place[:-1])
        cell = np.maximum(down, np.float32(0))
        cell[0] = 0
        from_ = start_down.copy()
        from_[1:] = _chosen(match >= cell[1:], begin, start_down[1:])
        np.maximum(cell[1:], match, out=cell[1:])
        # in a gap of the target: opened at the best cell before, the nearest of equals
        # (levels are not negative, so their bits are in their order; the place is the smaller part of the key)
        key = ((cell - slope).view(np.int32).astype(np.int64) << 32) | place
        np.maximum.accumulate(key, axis=0, out=key)
        along = (key[:-1] >> 32).astype(np.int32).view(np.float32) + (slope[1:] + (open_ - extend))
        row, col = np.nonzero(along > cell[1:])
        if len(row):
            from_[row + 1, col] = from_[key[row, col] & 0xFFFFFFFF, col]
            cell[row + 1, col] = along[row, col]
        h, start = cell, from_
        score = h.max(axis=0)
        new = np.flatnonzero(score > best)
        if len(new):
            end = h[:, new].argmax(axis=0)
            code = start[end, new]
            best[new] = score[new]
            out[new] = np.stack((score[new], code // (m + 1), np.full(len(new), i), code % (m + 1), end), axis=1)
    return out


def local_alignments(pairs: list[tuple[str | None, str | None]], open_: float = OPEN, extend: float = EXTEND) -> list[tuple[float, int, int, int, int] | None]:
    """(score, target start, target end, query start, query end) of (target, query) pairs, ends behind the last; None if nothing aligns.

    Of equal cells the first in target order, then in query order, ends the alignment; in a cell a
    letter on both sides goes before a gap of the query, that before one of the target, and shorter
    gaps before longer ones. Pairs of similar lengths are aligned together, CELLS letters of a row at most.
    """
    codes = [(_codes(t or ""), _codes(q or "")) for t, q in pairs]
    out: list[tuple[float, int, int, int, int] | None] = [None] * len(pairs)
    todo = sorted((k for k, (t, q) in enumerate(codes) if len(t) and len(q)), key=lambda k: (len(codes[k][1]), len(codes[k][0])))
    while todo:
        width = len(codes[todo[-1]][1]) + 1
        n = max(1, CELLS // width, min(TOGETHER, MOST_CELLS // width))
        part, todo = todo[-n:], todo[:-n]
        part.sort(key=lambda k: len(codes[k][0]))
        while part:  # targets of similar lengths
            shortest = len(codes[part[0]][0])
            own = [k for k in part if len(codes[k][0]) <= 1.5 * shortest]
            part = part[len(own) :]
            for k, r in zip(own, _batch([codes[k][0] for k in own], [codes[k][1] for k in own], open_, extend).tolist(), strict=True):
                out[k] = (r[0], *map(int, r[1:])) if r[0] > 0 else None
    return out


def local_alignment(target: str, query: str, open_: float = OPEN, extend: float = EXTEND) -> tuple[float, int, int, int, int] | None:
    """local_alignments() of one pair."""
    return local_alignments([(target, query)], open_, extend)[0]


def align(df: DataFrame, target: str, query: str) -> DataFrame:
    """df with align_score and the half-open spans on target and query; null where nothing aligns."""

    @F.arrow_udf(f"struct<{KIND.replace(' ', ':').replace(',:', ',')}>")
    def aligned(a: pa.Array, b: pa.Array) -> pa.Array:
        names = [x.split()[0] for x in KIND.split(", ")]
        rows = []
        for i in range(0, len(a), PAIRS):
            rows += local_alignments(list(zip(a.slice(i, PAIRS).to_pylist(), b.slice(i, PAIRS).to_pylist(), strict=True)))
        kinds = pa.struct([(n, pa.float64() if k == 0 else pa.int32()) for k, n in enumerate(names)])
        return pa.array([dict(zip(names, r, strict=True)) if r else dict.fromkeys(names) for r in rows], kinds)

    # a filter on what comes out is not to align once more before it
    return df.withColumn("_a", aligned.asNondeterministic()(F.col(target), F.col(query))).select(*df.columns, "_a.*")
