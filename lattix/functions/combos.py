"""Design keys: an 11-letter string over A, L, F, M stands for one fragment of each slot.

Column functions only, so keys are made, checked, taken apart and compared inside codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS = 11
ALPHABET = "ALFM"
SPACE = len(ALPHABET) ** SLOTS
# Letters, and the parents they stand for.
PARENTS = {"A": "As", "L": "Lb", "F": "Fn", "M": "Mb2"}


def from_index(index: Column) -> Column:
    """The key of an index from 0 to 4**11 - 1, the first slot most significant; an error outside of it."""
    digits = F.lpad(F.conv(index.cast("string"), 10, len(ALPHABET)), SLOTS, "0")
    bad = F.raise_error(F.concat(F.lit("index out of range: "), index.cast("string")))
    return F.when((index < 0) | (index >= SPACE), bad).otherwise(F.translate(digits, "".join(map(str, range(len(ALPHABET)))), ALPHABET))


def to_index(combo: Column) -> Column:
    return F.conv(F.translate(combo, ALPHABET, "".join(map(str, range(len(ALPHABET))))), len(ALPHABET), 10).cast("long")


def normalised(combo: Column) -> Column:
    return F.upper(F.trim(combo))


def is_valid(combo: Column) -> Column:
    return F.coalesce(normalised(combo).rlike(f"^[{ALPHABET}]{{{SLOTS}}}$"), F.lit(False))


def problem(combo: Column) -> Column:
    """What is wrong with a key: its length first, then its sorted bad letters; null if nothing is."""
    c = normalised(combo)
    bad = F.array_join(F.array_sort(F.array_distinct(F.split(F.translate(c, ALPHABET, ""), ""))), ",")
    return F.when(c.isNull(), "missing").when(F.length(c) != SLOTS, F.concat(F.lit("length "), F.length(c).cast("string"))).when(~is_valid(combo), F.concat(F.lit("letters "), bad))


def validated(combo: Column) -> Column:
    """The normalised key; an error if it is none."""
    return F.when(problem(combo).isNull(), normalised(combo)).otherwise(F.raise_error(F.concat(F.lit("invalid design key: "), problem(combo))))


def letters(combo: Column) -> Column:
    return F.split(combo, "")


def decoded(combo: Column) -> Column:
    """The parent of each slot."""
    names = F.create_map(*[F.lit(x) for kv in PARENTS.items() for x in kv])
    return F.transform(letters(combo), lambda c: names[c])


def encoded(parents: Column) -> Column:
    """The key of an array of 11 parents; Mb is taken for Mb2; an error for other names or another number."""
    names = F.create_map(*[F.lit(x) for k, v in (*((v, k) for k, v in PARENTS.items()), ("Mb", "M")) for x in (k, v)])
    got = F.transform(parents, lambda p: names[p])
    ok = (F.size(parents) == SLOTS) & F.forall(got, lambda x: x.isNotNull())
    return F.when(ok, F.array_join(got, "")).otherwise(F.raise_error(F.lit("unknown parent or wrong number of slots")))


def domain_keys(combo: Column) -> Column:
    """array<struct<parent, slot>>, slots from 1."""
    return F.transform(decoded(combo), lambda p, i: F.struct(p.alias("parent"), (i + 1).alias("slot")))


def hamming(a: Column, b: Column) -> Column:
    """Slots in which two indices differ: pairs of bits that are not equal."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(sum(1 << (2 * k) for k in range(SLOTS)))))


def hamming_text(a: Column, b: Column) -> Column:
    """The same for two keys of one length; an error for others."""
    differ = F.size(F.filter(F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y")), lambda p: p["x"] != p["y"]))
    return F.when(F.length(a) == F.length(b), differ).otherwise(F.raise_error(F.lit("lengths differ")))
