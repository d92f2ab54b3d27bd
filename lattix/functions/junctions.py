"""Scores of windows around the junctions of a design, over arrays of per-residue log-likelihoods.

Arrays hold null where a residue has no score (the first never has one) and may hold NaN, which
is a value: it goes through window means and is left out of summaries over junctions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattix.functions.sequences import number_or_nan

JUNCTIONS = 10
LEFT = RIGHT = 25
NAN = float("nan")


def boundaries(lengths: Column) -> Column:
    """Running sums of the first ten of eleven lengths."""
    sums = F.transform(F.sequence(F.lit(1), F.lit(JUNCTIONS)), lambda i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0).cast("int"), lambda s, x: s + x.cast("int")))
    return F.when(F.size(lengths) == JUNCTIONS + 1, sums).otherwise(F.raise_error(F.lit("eleven lengths are needed")).cast("array<int>"))


def mean(values: Column) -> Column:
    """Mean of an array without nulls; NaN if it is empty."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)).otherwise(F.lit(NAN))


def window(n: Column, boundary: Column, left: int = LEFT, right: int = RIGHT) -> tuple[Column, Column]:
    """First place, from 0, and end of the window around a boundary."""
    return F.greatest(F.lit(0), boundary - left), F.least(n, boundary + right)


def window_means(ll: Column, bounds: Column, left: int = LEFT, right: int = RIGHT) -> Column:
    """Mean over each boundary's window of what is not null behind the first residue; NaN if nothing is."""
    n = F.size(ll)

    def one(b: Column) -> Column:
        lo, hi = window(n, b, left, right)
        lo = F.greatest(lo, F.lit(1))
        part = F.slice(ll, lo + 1, F.greatest(hi - lo, F.lit(0)))
        return mean(F.filter(part, lambda x: x.isNotNull()))

    return F.transform(bounds, one)


def to_residues(token_ll: Column, n: Column) -> Column:
    """Scores of n residues from those of any number of tokens: residue i takes the token at its share of the way."""
    size = F.size(token_ll)
    tail = F.transform(
        F.sequence(F.lit(0), F.greatest(n, F.lit(2)) - 2),
        lambda i: F.when(size > 0, F.get(token_ll, F.least(F.floor(i * size / (n - 1)).cast("int"), size - 1))).otherwise(F.lit(NAN)),
    )
    nothing = F.array(F.lit(None).cast("double"))
    return F.when(n <= 0, F.array().cast("array<double>")).when(n == 1, nothing).otherwise(F.concat(nothing, tail))


def from_tokens(token_ll: Column) -> Column:
    """The array with its first score taken away."""
    return F.concat(F.array(F.lit(None).cast("double")), F.slice(token_ll, F.lit(2), F.greatest(F.size(token_ll) - 1, F.lit(0))))


def _numbers(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x))


def junction_mean(scores: Column) -> Column:
    return mean(_numbers(scores))


def junction_min(scores: Column) -> Column:
    return F.coalesce(F.array_min(_numbers(scores)), F.lit(NAN))


def global_score(token_ll: Column) -> Column:
    """Mean over all tokens, the first with them; 0 of none."""
    return F.aggregate(token_ll, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(token_ll), F.lit(1))


def padded(scores: Column, n: int = JUNCTIONS) -> Column:
    return F.slice(F.concat(scores, F.array_repeat(F.lit(NAN), n)), 1, n)


def flat(scores: Column, n: int = JUNCTIONS) -> list[Column]:
    """Columns junction_01 and so on."""
    return [scores[k].alias(f"junction_{k + 1:02d}") for k in range(n)]


def gathered(columns: list[str], n: int = JUNCTIONS) -> Column:
    """The array of the columns junction_01 and so on; NaN for those that columns lacks or that hold no number."""
    names = [f"junction_{k + 1:02d}" for k in range(n)]
    return F.array(*[number_or_nan(F.col(c).cast("string")) if c in columns else F.lit(NAN) for c in names])


def rank_score(global_: Column, mean_: Column, min_: Column, weights: tuple[float, float, float] = (1.0, 0.5, 0.5)) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(float(w)) * c for w, c in zip(weights, (global_, mean_, min_), strict=True)])


def orderable(score: Column) -> Column:
    """The score with NaN as null, so that descending orders put it last."""
    return F.when(~F.isnan(score), score)
