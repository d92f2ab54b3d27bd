"""Ranking of designs: exhaustive and sampled top-k, diversity, final order.

A score that is NaN counts as missing and comes last; ties go by the key, so every run agrees.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattix.functions import combos, junctions


def enumerated(spark: SparkSession, start: int = 0, end: int = combos.SPACE, partitions: int | None = None) -> DataFrame:
    """(idx, combo_compact) of the indices from start on, before end; made where it is used, stored nowhere."""
    return spark.range(start, end, 1, partitions).select(F.col("id").alias("idx"), combos.from_index(F.col("id")).alias("combo_compact"))


def weighted(spark: SparkSession, weights: DataFrame) -> DataFrame:
    """(idx, combo_compact, score): all designs with the sums of their fragments' weights.

    weights is one row with the array w: four weights for each slot, in the order of the alphabet.
    A design's score is read from it by the digits of its index, two bits a slot, so nothing but
    integers is handled for the designs that lose.
    """
    n = len(combos.ALPHABET)
    digit = lambda slot: F.shiftright("idx", 2 * (combos.SLOTS - 1 - slot)).bitwiseAND(F.lit(n - 1)).cast("int")
    score = sum((F.get("w", digit(s) + n * s) for s in range(1, combos.SLOTS)), F.get("w", digit(0)))
    return enumerated(spark).crossJoin(F.broadcast(weights)).select("idx", "combo_compact", score.alias("score"))  # a single row


def exhaustive(spark: SparkSession, weights: DataFrame, k: int) -> DataFrame:
    """The k best of weighted() designs; each task keeps its best k."""
    return weighted(spark, weights).orderBy(F.desc("score"), "combo_compact").limit(k)


def top_k(df: DataFrame, k: int, score: str | Column = "student_rank_score", key: str = "combo_compact") -> DataFrame:
    """The k rows with the highest scores: a bounded heap in each task, merged. Narrow rows first, wide columns after."""
    score = F.col(score) if isinstance(score, str) else score
    return df.orderBy(junctions.orderable(score).desc_nulls_last(), F.col(key)).limit(k)


def top_k_bucketed(df: DataFrame, k: int, path: str, bucket: Column, n: int, score: str = "student_rank_score") -> DataFrame:
    """top_k() that can be resumed: the top k of each of n buckets is written once; buckets that are there are left.

    A top-k of top-ks is the top-k of all. The bucket is a filter on the scan, so a run that was
    cut off does the missing part only.
    """
    spark = df.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for b in range(n):
        if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}/_SUCCESS")):
            top_k(df.where(bucket == b), k, score).write.mode("overwrite").parquet(f"{path}/bucket={b}")
    return top_k(spark.read.parquet(path), k, score)


def greedy_diversity(df: DataFrame, k: int, score: str = "calibrated_prob", key: str = "combo_compact", least: int = 2, most: int = 20_000) -> DataFrame:
    """k rows of df, the best first, each ``least`` slots from those before, then the best of the rest if too few.

    The choice depends on all earlier ones, so it is a fold over one sorted array; more than
    ``most`` rows are an error, for they may hold some that are far enough: cut a shortlist first. Adds
    selection_order, diversity_selected and selection_reason (distance or backfill).
    """
    rows = df.limit(most + 1)
    items = rows.select(F.struct(F.negate(F.coalesce(junctions.orderable(F.col(score)), F.lit(float("-inf")))).alias("_s"), F.col(key).alias("_key"), F.struct(*df.columns).alias("_row")).alias("x"))
    bounded = F.when(F.count("*") <= most, F.array_sort(F.collect_list("x")))
    all_ = items.agg(F.coalesce(bounded, F.raise_error(F.lit("too many rows to choose from"))).alias("xs"))
    kind = all_.schema["xs"].dataType.simpleString()
    wanted = max(k, 1)
    near = lambda acc, x: F.exists(acc, lambda y: combos.hamming_text(x["_key"], y["_key"]) < least)
    chosen = F.aggregate("xs", F.array().cast(kind), lambda acc, x: F.when((F.size(acc) < wanted) & ~near(acc, x), F.array_append(acc, x)).otherwise(acc))
    folded = all_.select("xs", chosen.alias("a")).select("a", F.slice(F.array_except("xs", "a"), F.lit(1), F.lit(wanted) - F.size("a")).alias("b"))
    tagged = lambda xs, why: F.transform(xs, lambda x: F.struct(x["_row"].alias("r"), F.lit(why).alias("why")))
    out = folded.select(F.posexplode(F.concat(tagged(F.col("a"), "distance"), tagged(F.col("b"), "backfill"))).alias("n", "x"))
    return out.select("x.r.*", (F.col("n") + 1).alias("selection_order"), F.lit(True).alias("diversity_selected"), F.col("x.why").alias("selection_reason"))


HEAD = 2_000


def diverse(df: DataFrame, k: int, score: str = "score", least: int = 2, head: int = HEAD) -> DataFrame:
    """What greedy_diversity() chooses by distance among any number of rows (idx, score): (idx, score, selection_order).

    A round takes the first ``head`` rows behind those decided that are far enough from all that
    were accepted, a filter and a bounded heap in each task, and decides them in order; the first
    one is always accepted, so there are k rounds at most. Only keys of heads come to the driver.
    df is read once for each round: a written table, or one that costs little to make.
    """
    s = junctions.orderable(F.col(score))
    rows = df.select("idx", F.coalesce(s, F.lit(float("-inf"))).alias(score))
    chosen: list[tuple[int, float]] = []
    last = None
    while len(chosen) < k:
        left = rows if last is None else rows.where((F.col(score) < last[1]) | ((F.col(score) == last[1]) & (F.col("idx") > last[0])))
        for idx, _ in chosen:
            left = left.where(combos.hamming(F.col("idx"), F.lit(idx).cast("long")) >= least)
        first = [(r["idx"], r[score]) for r in left.orderBy(F.desc(score), "idx").limit(head).collect()]
        for idx, value in first:
            if len(chosen) < k and all(_distance(idx, c) >= least for c, _ in chosen):
                chosen.append((idx, value))
        if len(first) < head:
            break
        last = first[-1]
    return df.sparkSession.createDataFrame([(i, v, n + 1) for n, (i, v) in enumerate(chosen)], f"idx long, {score} double, selection_order int")


def _distance(a: int, b: int) -> int:
    return sum((a >> 2 * k & 3) != (b >> 2 * k & 3) for k in range(combos.SLOTS))


#: Rows of a block of slots that are compared in one task; larger ones are cut into pieces.
MOST_BLOCK = 4_096


def near_pairs(df: DataFrame, below: int, blocks: int | None = None, most: int = MOST_BLOCK) -> DataFrame:
    """(a, b, distance) of all pairs a < b of different indices (idx) that differ in fewer than ``below`` slots.

    Slots are cut into blocks; a pair that differs in fewer than ``below`` slots agrees in all but
    below - 1 blocks, so rows meet under each choice of that many blocks and are compared there. A
    pair is given under the first choice on which it agrees. Choices of more than ``most`` rows are cut into
    pieces that meet in pairs. More blocks make more and longer keys, and fewer rows under each.
    """
    if not 1 <= below <= combos.SLOTS:
        raise ValueError("the distance lies between 1 and the number of slots")
    n = min(combos.SLOTS, blocks or below + 2)
    edges = [combos.SLOTS * k // n for k in range(n + 1)]
    masks = [sum(3 << 2 * slot for slot in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    choices = [sum(masks[k] for k in kept) for kept in itertools.combinations(range(n), n - below + 1)]
    key = F.array(*[F.struct(F.lit(c).alias("choice"), F.col("idx").bitwiseAND(F.lit(m).cast("long")).alias("value")) for c, m in enumerate(choices)])
    rows = df.select(F.col("idx").cast("long").alias("idx")).distinct().select("idx", F.explode(key).alias("k")).select("idx", "k.*")
    size = rows.groupBy("choice", "value").agg(F.count("*").alias("n")).where("n > 1").select("choice", "value", F.ceil(F.col("n") / most).cast("int").alias("pieces"))
    met = rows.join(size, ["choice", "value"]).withColumn("piece", F.pmod(F.xxhash64("idx"), F.col("pieces")).cast("int"))
    left = met.select("choice", "value", F.col("idx").alias("x"), F.col("piece").alias("p"), F.explode(F.sequence("piece", F.col("pieces") - 1)).alias("q"))
    right = met.select("choice", "value", F.col("idx").alias("y"), F.explode(F.sequence(F.lit(0), "piece")).alias("p"), F.col("piece").alias("q"))
    differ = F.col("x").bitwiseXOR(F.col("y"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(c)) for c, m in enumerate(choices)])
    distance = combos.hamming(F.col("x"), F.col("y"))
    pairs = left.join(right, ["choice", "value", "p", "q"]).where((F.col("x") < F.col("y")) | (F.col("p") < F.col("q"))).where((distance < below) & (first == F.col("choice")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), distance.alias("distance"))


def final_rank(selected: DataFrame, score: str = "calibrated_prob", key: str = "combo_compact") -> DataFrame:
    """selected with final_rank 1 .. n; its size is that of a report, so one task orders it."""
    return selected.withColumn("final_rank", F.row_number().over(W.orderBy(junctions.orderable(F.col(score)).desc_nulls_last(), key)))


def flagged(df: DataFrame, selected: DataFrame, key: str = "combo_compact", name: str = "diversity_selected") -> DataFrame:
    """df with whether its key is among the selected."""
    return df.join(selected.select(F.col(key)).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


RANKING = ["final_rank", "combo_compact", "sequence_aa", "sequence_hash", "global_score", "junction_mean", "junction_min", "calibrated_score", "calibrated_prob", "passes_s_min", "diversity_selected", "source_run_id", "seed",
           *[f"junction_{k:02d}" for k in range(1, junctions.JUNCTIONS + 1)]]


def export_columns(df: DataFrame) -> DataFrame:
    """The columns of a ranking in their order; absent ones are null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in RANKING])
