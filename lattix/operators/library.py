"""The fragment library: lookups of fragments by slot, and choosing them from candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattix.functions import combos, sequences
from lattix.operators.alignment import align

#: A lookup is a literal in the plan, so a library has to stay small: slots times letters.
MOST_FRAGMENTS = 10_000


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def duplicates(library: DataFrame) -> DataFrame:
    """(parent, slot, count) of fragments that the library has more than once."""
    return require_columns(library, "parent", "slot", "aa_sequence").groupBy("parent", "slot").count().where("count > 1")


def lookup(library: DataFrame, value: str = "aa_sequence", key: str = "letter") -> DataFrame:
    """One row with a map from letter and slot to the value, for lookups without a join of each slot.

    The library is small by nature; more than MOST_FRAGMENTS rows are an error, not a broadcast.
    """
    rows = library.select(F.concat(F.col(key), F.col("slot").cast("string")).alias("k"), F.col(value).alias("v"))
    size = F.when(F.count("*") <= MOST_FRAGMENTS, F.map_from_entries(F.collect_list(F.struct("k", "v"))))
    return rows.limit(MOST_FRAGMENTS + 1).agg(F.coalesce(size, F.raise_error(F.lit("the library has too many fragments"))).alias("library"))


def fragments(combo: Column, library: Column) -> Column:
    """The fragments of a key by slot; an error if the library lacks one."""
    return F.transform(combos.letters(combo), lambda c, i: F.coalesce(library[F.concat(c, (i + 1).cast("string"))], F.raise_error(F.concat(F.lit("no fragment for "), c, (i + 1).cast("string")))))


def built(designs: DataFrame, library: DataFrame, combo: str = "combo_compact") -> DataFrame:
    """designs with sequence_aa and domain_lengths of their keys, in one pass and without a shuffle."""
    rows = designs.crossJoin(F.broadcast(lookup(library)))  # a single row: a map of bounded size
    return rows.withColumn("_parts", fragments(F.col(combo), F.col("library"))).withColumn("sequence_aa", F.array_join("_parts", "")).withColumn("domain_lengths", F.transform("_parts", F.length)).drop("_parts", "library")


def completed(given: Column, made: Column) -> Column:
    """The given sequence, trimmed and upper case, or else the one made from the key; an error if there is neither."""
    return F.coalesce(F.nullif(F.upper(F.trim(given)), F.lit("")), made, F.raise_error(F.lit("neither a sequence nor a key")))


def active_rows(df: DataFrame, slots: list[str] | None = None, allowed: str = combos.ALPHABET) -> DataFrame:
    """Rows in which all eleven slot columns, by default the first eleven, hold an allowed letter."""
    slots = slots or df.columns[: combos.SLOTS]
    if len(slots) != combos.SLOTS:
        raise ValueError(f"{combos.SLOTS} slot columns are needed")
    require_columns(df, *slots)
    return df.where(reduce(lambda a, b: a & b, [sequences.is_letter(F.col(f"`{c}`"), allowed) for c in slots]))


def with_combo(df: DataFrame, slots: list[str] | None = None) -> DataFrame:
    slots = slots or df.columns[: combos.SLOTS]
    return df.withColumn("combo_compact", F.concat(*[F.upper(F.trim(F.col(f"`{c}`"))) for c in slots]))


def within_stops(candidates: DataFrame, most: int = 0) -> DataFrame:
    """Candidates with at most ``most`` stops; all of a fragment of which none is left."""
    own = W.partitionBy("parent", "slot")
    return candidates.withColumn("_any", F.max((F.col("stop_count") <= most).cast("int")).over(own)).where((F.col("stop_count") <= most) | (F.col("_any") == 0)).drop("_any")


def ranked(candidates: DataFrame, *keys: str, score: str = "adjusted_score", tie: str = "gen_idx") -> DataFrame:
    """candidates with their rank in the group by score, first made first in ties."""
    return candidates.withColumn("rank", F.row_number().over(W.partitionBy(*(keys or ("parent", "slot"))).orderBy(F.col(score).desc_nulls_last(), tie)))


def best(candidates: DataFrame, *keys: str, **how: str) -> DataFrame:
    return ranked(candidates, *keys, **how).where("rank = 1")


def top(candidates: DataFrame, n: int, *keys: str, **how: str) -> DataFrame:
    return ranked(candidates, *keys, **how).where(F.col("rank") <= n)


def ambiguous(candidates: DataFrame, delta: float = 25.0, *keys: str, score: str = "adjusted_score", tie: str = "gen_idx") -> DataFrame:
    """The best of each group with whether the second is less than delta behind."""
    w = W.partitionBy(*(keys or ("parent", "slot"))).orderBy(F.col(score).desc_nulls_last(), tie)
    return candidates.withColumn("rank", F.row_number().over(w)).withColumn("_next", F.lead(score).over(w)).where("rank = 1").withColumn("ambiguous", F.coalesce(F.col(score) - F.col("_next") < delta, F.lit(False))).drop("_next")


def slots_increasing(library: DataFrame, overlap: int = 5, key: str = "parent") -> DataFrame:
    """(parent, slots_increasing): whether each slot starts behind the end of the one before, less the overlap."""
    w = W.partitionBy(key).orderBy("slot")
    return library.withColumn("_end", F.lag("parent_end", 1, -1).over(w)).groupBy(key).agg(F.bool_and(F.col("parent_start") >= F.col("_end") - overlap).alias("slots_increasing"))


def chain(candidates: DataFrame, keep: int = 3, overlap: int = 5, key: str = "parent") -> DataFrame:
    """Of each parent one candidate for each slot, so that starts follow ends and the scores add up to the most.

    A step of the dynamic program is a state for each of the ``keep`` best candidates of a slot.
    It runs as a fold over the parent's slots inside one expression, on arrays of at most
    slots * keep candidates. Of equal sums the first candidate is taken; a parent without any
    chain gets the best of each slot.
    """
    columns = [c for c in candidates.columns if c != "rank"]
    options = ranked(candidates, key, "slot").where(F.col("rank") <= keep)
    slots = options.groupBy(key, "slot").agg(F.array_sort(F.collect_list(F.struct("rank", *columns))).alias("options"))
    rows = slots.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("slot", "options"))).alias("steps"))
    item = options.select(F.struct("rank", *columns).alias("x")).schema["x"].dataType.simpleString()
    state = f"array<struct<score:double,stop:int,path:array<{item}>>>"

    def first_states(step: Column) -> Column:
        return F.transform(step["options"], lambda c: F.struct(c["adjusted_score"].cast("double").alias("score"), c["parent_end"].cast("int").alias("stop"), F.array(c).alias("path")))

    def first_best(states: Column) -> Column:
        """Of the states the one with the most, the first of equals; null of none."""
        return F.aggregate(states, F.lit(None).cast(state[6:-1]), lambda a, s: F.when(a.isNull() | (s["score"] > a["score"]), s).otherwise(a))

    def step(states: Column, now: Column) -> Column:
        def extend(c: Column) -> Column:
            before = first_best(F.filter(states, lambda s: c["parent_start"] >= s["stop"] - overlap))
            return F.when(before.isNotNull(), F.struct((before["score"] + c["adjusted_score"].cast("double")).alias("score"), c["parent_end"].cast("int").alias("stop"), F.concat(before["path"], F.array(c)).alias("path")))

        return F.filter(F.transform(now["options"], extend), lambda s: s.isNotNull()).cast(state)

    ends = F.aggregate(F.slice("steps", F.lit(2), F.greatest(F.size("steps") - 1, F.lit(0))), first_states(F.col("steps")[0]).cast(state), step)
    fallback = F.transform("steps", lambda s: s["options"][0])
    chosen = rows.select(F.coalesce(first_best(ends)["path"], fallback).alias("path"), first_best(ends).isNull().alias("fell_back"))
    return chosen.select(F.explode("path").alias("c"), "fell_back").select(*[f"c.{c}" for c in columns], "fell_back")


def six_frame_candidates(fragments_: DataFrame, dna: str = "dna", reverse: bool = True) -> DataFrame:
    """fragments with a row for each frame: gen_idx, orientation, frame, aa_raw; the reads are cleaned first."""
    clean = fragments_.withColumn("_dna", sequences.sanitised(F.col(dna)))
    return clean.withColumn("_f", F.explode(sequences.six_frames(F.col("_dna"), reverse))).select(*fragments_.columns, "_f.gen_idx", "_f.orientation", "_f.frame", F.col("_f.aa").alias("aa_raw"))


def translated_candidates(fragments_: DataFrame, parents: DataFrame, reverse: bool = True) -> DataFrame:
    """Aligned and scored candidates of fragments (parent, slot, dna) against parents (parent, protein), of which MOST_FRAGMENTS are the most."""
    proteins = parents.select("parent", "protein")
    if proteins.limit(MOST_FRAGMENTS + 1).count() > MOST_FRAGMENTS:
        raise ValueError("too many parents to send to all tasks")
    named = six_frame_candidates(fragments_, reverse=reverse).join(F.broadcast(proteins), "parent", "left")
    checked = named.withColumn("protein", F.coalesce("protein", F.raise_error(F.concat(F.lit("no protein of "), F.col("parent")))))
    found = align(checked, "protein", "aa_raw").where("align_score is not null")
    aa = sequences.trimmed(F.col("aa_raw"), F.col("query_start"), F.col("query_end"))
    return found.withColumn("aa_trimmed", aa).withColumn("stop_count", sequences.count_of(F.col("aa_trimmed"), "*")).withColumn("x_fraction", sequences.x_fraction(F.col("aa_trimmed"))).withColumn("adjusted_score", sequences.adjusted_score(F.col("align_score"), F.col("aa_trimmed")))
