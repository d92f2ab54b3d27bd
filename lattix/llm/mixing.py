"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

Each source gets a target of words: its weight's share of the mix, at most ``most`` times its
own size, the excess going to the others by weight. Inside a source the expected copies of a
document grow with its length, ``e = min(most, c * log2(2 + size))``, with c such that the
expected words make the target. ``floor(e)`` copies are certain. The rest of e is the inclusion
probability p of one more copy, drawn by Pareto order sampling: documents are ranked by
``(u / (1 - u)) / (p / (1 - p))`` with u from a digest of the id, and taken in that order until
the words still missing are reached, to within half of the last document.

Scale: after one pass over the texts only (id, source, size, u) moves on. Nothing is sorted
inside a source: c comes from one row for each distinct size, and the cut of the ranking from
counts in ``BINS`` bins, then in ``BINS`` bins of the bin that holds the cut, and only what
falls in that last bin is put in order. What holds for a source reaches its rows as a broadcast
of a row for each source if there are at most ``MOST_SOURCES`` of them, else by a join on the
source and a salt. A source with a third of all rows thus gives no task more than its share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattix.llm.common import checkpoint

WORDS = r"[^\x20\x09-\x0D]+"
BINS = 512
#: Sources whose rows are broadcast; a row has a few numbers and the source's name.
MOST_SOURCES = 10_000
SALTS = 64


#: What a mix says of each document.
MIXED = ("size", "source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def uniform(key: Column, seed: int = 0) -> Column:
    """A number in (0, 1) from a digest of the key; the same in every run and engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def with_source(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (doc_id, src, ...) with the columns that known has for their source, one row for each."""
    known = checkpoint(known)
    if known.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES:
        return rows.join(F.broadcast(known), "src")
    salted = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "u" if "u" in rows.columns else "size"), F.lit(SALTS)).cast("int")).join(salted, ["src", "_salt"]).drop("_salt")


def source_targets(sizes: DataFrame, weights: Sequence[float], total: float, most: float) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) for each source.

    ``weights`` repeat over the sources in code point order, null last. Filling goes by the
    size that a source can take for its weight: the sources that fill up first are at their
    limit, and the others share what is left. The input has a row per source, not per document.
    """
    rank = W.orderBy(F.col("source").asc_nulls_last())
    fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (
        sizes.withColumn("k", F.row_number().over(rank) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("goal", F.sum("source_size").over(every) * F.lit(float(total)))
        .withColumn("rate", (F.col("goal") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))))
        .withColumn("full", F.col("rate") * F.col("weight") >= F.col("cap"))
        .withColumn("level", F.max(F.when(~F.col("full"), F.col("rate"))).over(every))
        .withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))))
        .select("source", "source_size", "target")
    )


def pareto_mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), total: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every row of docs (doc_id, text, source).

    A null text has size 0 and takes nothing; a null source is a source of its own, last in
    order; rows that repeat an id draw the same u, and those at the cut are told apart by size.
    An empty table gives an empty result. Other columns are ignored.
    """
    slim = checkpoint(docs.select("doc_id", F.struct("source").alias("src"), word_count(F.col("text")).alias("size")))
    return pareto_mix_of(slim, weights, total, most, seed).select("doc_id", *MIXED)


def pareto_mix_of(slim: DataFrame, weights: Sequence[float] = (5, 2, 1), total: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """pareto_mix() of a written table (doc_id, src, size), src being the source in a struct; the result has src too."""
    slim = slim.withColumn("u", uniform(F.col("doc_id"), seed))
    targets = checkpoint(
        source_targets(slim.groupBy("src").agg(F.sum("size").alias("source_size")).select("src.source", "source_size"), weights, total, most).select(F.struct("source").alias("src"), "source_size", "target")
    )

    # c of each source: sizes from the longest down; those at the limit first, c from the rest
    gain = F.log2(F.col("size") + F.lit(2.0))
    down = W.partitionBy("src").orderBy(F.col("size").desc())
    rest = down.rowsBetween(W.currentRow, W.unboundedFollowing)
    sizes = slim.groupBy("src", "size").agg(F.count("*").alias("n")).withColumn("words", F.col("n") * F.col("size"))
    rates = (
        sizes.join(targets, "src")
        .withColumn("over", F.coalesce(F.sum("words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("c", F.try_divide(F.col("target") - most * F.col("over"), F.sum(F.col("words") * gain).over(rest)))
        .groupBy("src", "source_size", "target")
        .agg(F.max(F.when((F.col("c") >= 0) & (F.col("c") * gain <= most), F.col("c"))).alias("c"))
    )
    e = F.least(F.lit(most), F.coalesce(F.col("c") * gain, F.lit(most)))
    q = F.col("u") / (1 - F.col("u")) * (1 - F.col("p")) / F.col("p")
    # z in (0, 1) keeps the order of q; bins are cut at its even steps
    ranked = checkpoint(
        with_source(slim, rates)
        .withColumn("sure", F.floor(e + 1e-12).cast("long"))
        .withColumn("p", F.when(F.col("size") > 0, e - F.col("sure")))
        .withColumn("z", F.when(F.col("p") > 1e-9, q / (1 + q)))
        .withColumn("b1", F.least(F.floor(F.col("z") * BINS), F.lit(BINS - 1)))
        .withColumn("b2", F.least(F.floor((F.col("z") * BINS - F.col("b1")) * BINS), F.lit(BINS - 1)))
        .select("doc_id", "src", "size", "source_size", "target", "sure", "z", "b1", "b2")
    )
    need = ranked.groupBy("src").agg((F.max("target") - F.sum(F.col("sure") * F.col("size"))).alias("need"))

    def cut(rows: DataFrame, need: DataFrame, bin_: str) -> DataFrame:
        """The bin in which the words of lower bins no longer fill the need, and what is needed of it."""
        upto = W.partitionBy("src").orderBy(bin_)
        return (
            rows.groupBy("src", bin_).agg(F.sum("size").alias("w"))
            .join(need, "src")
            .withColumn("before", F.coalesce(F.sum("w").over(upto.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
            .where((F.col("before") < F.col("need")) & (F.col("before") + F.col("w") >= F.col("need")))
            .select("src", F.col(bin_).alias(f"cut_{bin_}"), (F.col("need") - F.col("before")).alias("need"))
        )

    first = checkpoint(cut(ranked.where("z is not null"), need, "b1"))
    # joined on source and bin, so that a large source's rows do not meet in one task
    inner = ranked.where("z is not null").join(first.withColumnRenamed("cut_b1", "b1"), ["src", "b1"])
    second = checkpoint(cut(inner.drop("need"), first.select("src", "need"), "b2"))
    last = (
        inner.drop("need").join(second.withColumnRenamed("cut_b2", "b2"), ["src", "b2"])
        .withColumn("run", F.sum("size").over(W.partitionBy("src").orderBy("z", "size", "doc_id").rowsBetween(W.unboundedPreceding, -1)))
        .where(F.coalesce("run", F.lit(0)) + F.col("size") / 2 <= F.col("need"))
        .groupBy("src").agg(F.max(F.struct("z", "size", "doc_id")).alias("last"))
    )
    ends = need.join(first.drop("need"), "src", "left").join(second.drop("need"), "src", "left").join(last, "src", "left").drop("need")
    # without a cut bin the whole ranking does not fill the need, or nothing is needed
    wanted = need.select("src", (F.col("need") > 0).alias("wants"))
    more = F.when(F.col("z").isNull() | ~F.col("wants"), False).when(F.col("cut_b1").isNull() | (F.col("b1") < F.col("cut_b1")), True).when(F.col("b1") > F.col("cut_b1"), False).when(
        F.col("cut_b2").isNull() | (F.col("b2") < F.col("cut_b2")), True).when(F.col("b2") > F.col("cut_b2"), False).otherwise(
        F.coalesce(F.struct("z", "size", "doc_id") <= F.col("last"), F.lit(False)))
    copies = F.col("sure") + more.cast("long")
    return with_source(ranked, ends.join(wanted, "src")).select("doc_id", "src", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def with_mix(docs: DataFrame, **how) -> DataFrame:
    """docs, all rows and columns, with size, source_size, target, copies and taken of pareto_mix(); columns of those names are replaced.

    Rows of one id, source and size have the same number of copies, so texts are joined on these.
    """
    docs = docs.select(*(f"`{c}`" for c in docs.columns if c not in MIXED))
    known = lambda c: F.struct(F.col(c).alias("v"))  # noqa: E731  nulls are equal to each other
    slim = checkpoint(docs.select("doc_id", F.struct("source").alias("src"), word_count(F.col("text")).alias("size")))
    mix = pareto_mix_of(slim, **how).groupBy(known("doc_id").alias("d"), known("src").alias("s"), F.col("size").alias("n")).agg(*(F.first(c).alias(c) for c in MIXED))
    own = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), known("doc_id").alias("d"), F.struct(F.struct("source").alias("v")).alias("s"), word_count(F.col("text")).alias("n"))
    return own.join(mix, ["d", "s", "n"]).select("row.*", *MIXED)


ORACLE_SQL = r"""
WITH slim AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM slim GROUP BY source),
w AS (SELECT source, source_size, ([5, 2, 1])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
        source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS goal FROM src),
f AS (SELECT *, (goal - coalesce(sum(cap) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS rate FROM w
      WINDOW p AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN rate * weight >= cap THEN cap
        ELSE least(cap, max(CASE WHEN rate * weight < cap THEN rate END) OVER () * weight) END AS target FROM f),
s AS (SELECT source, size, count(*) * size AS words FROM slim GROUP BY source, size),
r AS (SELECT s.source, size, source_size, target, log2(size + 2.0::DOUBLE) AS gain,
        (target - 2.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY s.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(words * log2(size + 2.0::DOUBLE)) OVER (PARTITION BY s.source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
k AS (SELECT source, source_size, target, max(CASE WHEN c >= 0 AND c * gain <= 2 THEN c END) AS c FROM r GROUP BY ALL),
e AS (SELECT doc_id, size, u, k.*, least(2.0::DOUBLE, coalesce(c * log2(size + 2.0::DOUBLE), 2.0::DOUBLE)) AS e FROM slim JOIN k ON slim.source IS NOT DISTINCT FROM k.source),
p AS (SELECT *, floor(e + 1e-12)::BIGINT AS sure, CASE WHEN size > 0 AND e - floor(e + 1e-12) > 1e-9 THEN e - floor(e + 1e-12) END AS p FROM e),
z AS (SELECT *, u / (1 - u) * (1 - p) / p AS q, target - sum(sure * size) OVER (PARTITION BY source) AS need FROM p),
o AS (SELECT *, sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, size, doc_id ROWS UNBOUNDED PRECEDING) - size AS run FROM z)
SELECT doc_id, size, source_size, target, sure + (q IS NOT NULL AND need > 0 AND run + size / 2 <= need)::BIGINT AS copies,
  (sure + (q IS NOT NULL AND need > 0 AND run + size / 2 <= need)::BIGINT) * size AS taken
FROM o
"""
