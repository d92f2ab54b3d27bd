"""Scores of designs from the scores of their fragments.

With a scorer whose residue scores depend on the residue and the one before, a fragment's
residues score the same in every design but for its first, which depends on the last residue of
the fragment in front. So each fragment is scored once behind each that can stand in front of it,
some hundred short texts whatever the number of designs. A design's running sums are then added up
from those of its fragments, and the sum over a window is the difference of two of them: no
sequence is made, and a batch of designs is a few dozen array operations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.functions import combos, junctions
from lattix.operators import library
from lattix.operators.scorers import Scorer

N = len(combos.ALPHABET)
SCORES = "struct<global_score:double,junction_mean:double,junction_min:double>"


@dataclass
class Tables:
    """By slot and letter: lengths, running sums behind the first residue; by slot, letter in front and letter: scores of first residues."""

    sizes: np.ndarray
    sums: np.ndarray
    firsts: np.ndarray


def tables(fragments: DataFrame, scorer: Scorer) -> Tables:
    """Scores every fragment (letter, slot, aa_sequence) behind each of the slot before; an error if one lacks or is empty."""
    rows = fragments.select("letter", "slot", F.col("aa_sequence").alias("own"))
    front = rows.select(F.col("letter").alias("before"), (F.col("slot") + 1).alias("slot"), F.substr("own", F.lit(-1), F.lit(1)).alias("last"))
    texts = rows.join(front, "slot", "left").withColumn("sequence_aa", F.concat(F.coalesce("last", F.lit("")), "own"))
    most = library.MOST_FRAGMENTS * N
    got = scorer(texts).select("slot", "letter", "before", F.length("own").alias("n"), "token_ll").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError("the library has too many fragments")
    sizes = np.zeros((combos.SLOTS, N), np.int64)
    sums = np.zeros((combos.SLOTS, N, max([r["n"] for r in got], default=0) + 1))
    firsts = np.full((combos.SLOTS, N, N), np.nan)
    for r in got:
        if r["slot"] not in range(1, combos.SLOTS + 1) or r["letter"] not in combos.ALPHABET:
            continue
        s, c, ll = r["slot"] - 1, combos.ALPHABET.index(r["letter"]), r["token_ll"][-r["n"] :] if r["n"] else []
        sizes[s, c] = r["n"]
        if r["n"]:
            sums[s, c, 1:] = np.cumsum(np.append(np.concatenate(([0.0], ll[1:])), np.zeros(sums.shape[2] - 1 - r["n"])))
            firsts[s, slice(None) if r["before"] is None else combos.ALPHABET.index(r["before"]), c] = ll[0]
    if not sizes.all():
        raise ValueError("the library lacks a fragment, or has an empty one")
    return Tables(sizes, sums, firsts)


def scored(index: np.ndarray, t: Tables, left: int, right: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """global_score, junction_mean and junction_min of designs by index."""
    rows, slots = np.arange(len(index)), np.arange(combos.SLOTS)
    own = (index[:, None] >> (2 * (combos.SLOTS - 1 - slots))) & (N - 1)
    size = t.sizes[slots, own]
    first = t.firsts[slots, np.concatenate((np.zeros((len(index), 1), np.int64), own[:, :-1]), axis=1), own]
    start = np.concatenate((np.zeros((len(index), 1), np.int64), np.cumsum(size, axis=1)), axis=1)
    total = np.concatenate((np.zeros((len(index), 1)), np.cumsum(first + t.sums[slots, own, size], axis=1)), axis=1)

    def upto(place: np.ndarray) -> np.ndarray:
        """The sum of the scores before a place of each design."""
        s = np.minimum((start[:, 1:] <= place[:, None]).sum(axis=1), combos.SLOTS - 1)
        k = place - start[rows, s]
        return total[rows, s] + np.where(k > 0, first[rows, s] + t.sums[s, own[rows, s], k], 0.0)

    n, means = start[:, -1], np.empty((len(index), combos.SLOTS - 1))
    for j in range(combos.SLOTS - 1):
        low, high = np.maximum(start[:, j + 1] - left, 1), np.minimum(start[:, j + 1] + right, n)  # the first residue has no score
        means[:, j] = (upto(high) - upto(low)) / np.where(high > low, high - low, np.nan)
    known = ~np.isnan(means)
    count = known.sum(axis=1)
    mean = np.where(known, means, 0).sum(axis=1) / np.where(count, count, np.nan)
    return total[:, -1] / np.maximum(n, 1), mean, np.where(count, np.where(known, means, np.inf).min(axis=1), np.nan)


def scores(designs: DataFrame, fragments: DataFrame, scorer: Scorer, index: str = "idx", left: int = junctions.LEFT, right: int = junctions.RIGHT) -> DataFrame:
    """designs with global_score, junction_mean and junction_min of the index column; the same as those of their sequences but for rounding."""
    known = tables(fragments, scorer)

    @F.arrow_udf(SCORES)
    def run(column: pa.Array) -> pa.Array:
        got = scored(column.to_numpy(zero_copy_only=False).astype(np.int64), known, left, right)
        return pa.StructArray.from_arrays([pa.array(x) for x in got], ["global_score", "junction_mean", "junction_min"])

    return designs.withColumn("_s", run(F.col(index).cast("long"))).select(*designs.columns, "_s.*")
