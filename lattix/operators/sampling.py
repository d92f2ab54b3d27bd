"""Samples of designs and splits of rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattix.functions import combos

MOST_DRAWN = 1_000_000


def drawn(spark: SparkSession, n: int, seed: int, prefix: str = "", slots: int = combos.SLOTS) -> DataFrame:
    """(combo_compact) of n different keys, drawn letter by letter by the standard generator, sorted.

    The generator is sequential, so this is for samples of up to MOST_DRAWN keys that have to be
    those of earlier runs; hashed_sample() has no such bound.
    """
    prefix = prefix.strip().upper()
    if set(prefix) - set(combos.ALPHABET) or len(prefix) > slots:
        raise ValueError("invalid prefix")
    free = slots - len(prefix)
    if n > len(combos.ALPHABET) ** free or n > MOST_DRAWN:
        raise ValueError("more keys asked for than there are")
    rng, seen = random.Random(seed), set()
    while len(seen) < n:
        seen.add(prefix + "".join(rng.choice(combos.ALPHABET) for _ in range(free)))
    return spark.createDataFrame([(c,) for c in sorted(seen)], "combo_compact string")


ROUNDS = 6


def round_keys(seed: int) -> list[int]:
    """The numbers that a seed gives the rounds of permuted()."""
    return [int(hashlib.sha256(f"{seed}:{k}".encode()).hexdigest()[:7], 16) for k in range(ROUNDS)]


def permuted(i: Column, half: int, seed: int) -> Column:
    """A permutation of the numbers below 4 ** half, keyed by seed: rounds that add a scrambled half to the other."""
    mask = F.lit((1 << half) - 1).cast("long")
    high, low = F.shiftright(i.cast("long"), half), i.cast("long").bitwiseAND(mask)
    for key in round_keys(seed):
        high, low = low, high.bitwiseXOR(F.shiftright((low * low + key) * 40503 + low * 2654435761, 9).bitwiseAND(mask))
    return F.shiftleft(high, half).bitwiseOR(low)


def distinct_designs(spark: SparkSession, n: int, seed: int, prefix: str = "") -> DataFrame:
    """(idx, combo_compact) of n different keys that begin with prefix, n up to their number, in the order of the draw's index.

    The n first numbers are permuted, each where it is used; nothing is remembered, sorted or compared.
    """
    prefix = prefix.strip().upper()
    if set(prefix) - set(combos.ALPHABET) or len(prefix) > combos.SLOTS:
        raise ValueError("invalid prefix")
    free = combos.SLOTS - len(prefix)
    if n > len(combos.ALPHABET) ** free:
        raise ValueError("more keys asked for than there are")
    first = 0
    for c in prefix:
        first = first * len(combos.ALPHABET) + combos.ALPHABET.index(c)
    idx = permuted(F.col("id"), free, seed) + F.lit(first << (2 * free)).cast("long") if free else F.lit(first).cast("long")
    return spark.range(n).select(idx.alias("idx")).withColumn("combo_compact", combos.from_index(F.col("idx")))


def design_rounds(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(idx, combo_compact) of n draws of designs, of any number: none comes twice before all have come.

    Draws beyond combos.SPACE begin another round. Their number's high half is longer, and what it has
    more stays on top through permuted(), so idx is round * SPACE plus a permutation of the round's own.
    """
    return spark.range(n).select(permuted(F.col("id"), combos.SLOTS, seed).alias("idx")).withColumn("combo_compact", combos.from_index(F.col("idx") % combos.SPACE))


def hashed_sample(df: DataFrame, n: int, seed: int, key: str = "combo_compact") -> DataFrame:
    """n rows with the smallest hashes of key and seed, the same in every run."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def split_indices(n: int, fraction: float, seed: int) -> tuple[list[int], list[int]]:
    """Sorted numbers of training and validation rows: round(n * fraction) of the latter, one of each at least."""
    if n < 2:
        raise ValueError("at least two rows are needed")
    order = np.arange(n)
    np.random.default_rng(seed).shuffle(order)
    k = min(max(round(n * fraction), 1), n - 1)
    return sorted(order[k:].tolist()), sorted(order[:k].tolist())


def split(df: DataFrame, fraction: float, seed: int, key: str, most: int = 1 << 16) -> DataFrame:
    """df with is_val: round(n * fraction) rows, one of each kind at least, with the smallest hashes of key and seed.

    The hash is of a digest that other engines have as well. Rows are counted in ``most`` bins of
    it; only the bin in which the share ends is ordered, by key and then by the whole row.
    """
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    b = F.pmod(h, F.lit(most))
    counts = {r["b"]: r["count"] for r in df.groupBy(b.alias("b")).count().collect()}  # at most ``most`` rows
    n = sum(counts.values())
    if n < 2:
        raise ValueError("at least two rows are needed")
    rest = min(max(round(n * fraction), 1), n - 1)
    for edge in sorted(counts):
        if counts[edge] >= rest:
            break
        rest -= counts[edge]
    whole = df.where(b != edge).withColumn("is_val", b < edge)
    own = W.orderBy(h, key, F.xxhash64(*df.columns))
    return whole.unionByName(df.where(b == edge).withColumn("is_val", F.row_number().over(own) <= rest))
