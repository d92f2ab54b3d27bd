"""The ranking job: a cheap score over all designs, a dear one over the shortlist, a diverse top.

``rank`` is the plan from designs to the ranking's columns; ``run`` is the job around it: all
designs or a drawn sample, a shortlist that is made bucket by bucket and can be resumed, a memo
of dear scores, and the ranking and its metadata on disk.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.functions import combos, junctions, sequences
from lattix.operators import calibration, library, memo, ranking, sampling, scorers, seams
from lattix.sources import writers

SHORTLIST, RERANK, TOP, LEAST = 2000, 500, 50, 2


def cheap_scores(designs: DataFrame, fragments: DataFrame) -> DataFrame:
    """(idx, combo_compact, student_rank_score) of designs (idx, combo_compact) by the letter-pair model of the fragments."""
    cheap = scorers.bigram_scorer(scorers.bigram_fit(fragments, "aa_sequence"))
    score = junctions.rank_score(F.col("global_score"), F.col("junction_mean"), F.col("junction_min"))
    return seams.scores(designs.select("idx", "combo_compact"), fragments, cheap).select("idx", "combo_compact", score.alias("student_rank_score"))


def rescored(short: DataFrame, fragments: DataFrame, scorer: scorers.Scorer, known: DataFrame | str | None = None, model: str = "") -> DataFrame:
    """short with sequence_aa, global_score, junction scores and teacher_cache_hit: from the memo ``known``, its rows or its path, if it has them, else by the scorer."""
    rows = library.built(short, fragments)
    if known is None:
        got = scorers.summaries(scorer(rows)).withColumn("teacher_cache_hit", F.lit(False))
    else:
        keyed = rows.withColumn("key", sequences.cache_key(F.col("sequence_aa"), F.col("domain_lengths"), model))
        got = memo.scored(keyed, memo.lookup(keyed, known) if isinstance(known, str) else known, lambda d: scorers.summaries(scorer(d)))
    scores = F.col("junction_scores")
    return got.withColumn("junction_mean", junctions.junction_mean(scores)).withColumn("junction_min", junctions.junction_min(scores)).drop("token_ll")


def finished(again: DataFrame, artifact: dict, top: int = TOP, least: int = LEAST, run_id: str | None = None, seed: int | None = None) -> DataFrame:
    """The columns of a ranking from rescored() rows: calibrated, diversified, in order."""
    full = calibration.apply(again, artifact).withColumn("sequence_hash", sequences.sha256(F.col("sequence_aa"))).select("*", *junctions.flat(F.col("junction_scores"))).drop("junction_scores", "domain_lengths")
    chosen = ranking.greedy_diversity(full.withColumn("source_run_id", F.lit(run_id).cast("string")).withColumn("seed", F.lit(seed).cast("long")), top, least=least)
    return ranking.export_columns(ranking.final_rank(chosen))


def rank(designs: DataFrame, fragments: DataFrame, artifact: dict, shortlist: int = SHORTLIST, rerank: int = RERANK, top: int = TOP, least: int = LEAST, rescore: scorers.Scorer | None = None,
         known: DataFrame | str | None = None, model: str = "", run_id: str | None = None, seed: int | None = None) -> DataFrame:
    """The columns of a ranking for designs (combo_compact, idx) over fragments (letter, slot, aa_sequence).

    Keys and scores only move until the shortlist is there; sequences are made for it alone.
    """
    rescore = rescore or scorers.bigram_scorer(scorers.bigram_fit(fragments, "aa_sequence"))
    short = ranking.top_k(ranking.top_k(cheap_scores(designs, fragments), shortlist), rerank).select("combo_compact", "student_rank_score")
    return finished(rescored(short, fragments, rescore, known, model), artifact, top, least, run_id, seed)


def run(spark: SparkSession, fragments: DataFrame, artifact: dict, folder: str, sample: int | None = None, prefix: str = "", seed: int = 0, buckets: int = 8, shortlist: int = SHORTLIST, rerank: int = RERANK, top: int = TOP, least: int = LEAST,
        rescore: scorers.Scorer | None = None, model: str = "pairs", memo_path: str | None = None, run_id: str = "") -> DataFrame:
    """Ranks all designs, or ``sample`` drawn ones that begin with prefix, and writes the run to folder; returns the ranking.

    A run that was cut off makes only the buckets of the shortlist that are missing, if it has
    the same parameters; dear scores are read from the memo and new ones added to it.
    """
    rescore = rescore or scorers.bigram_scorer(scorers.bigram_fit(fragments, "aa_sequence"))
    parameters: dict[str, Any] = {"sample": sample, "prefix": prefix, "seed": seed, "buckets": buckets, "shortlist": shortlist}
    designs = ranking.enumerated(spark) if sample is None else sampling.drawn(spark, sample, seed, prefix).withColumn("idx", combos.to_index(F.col("combo_compact")))
    path = f"{folder}/shortlist-{writers.fingerprint(parameters)}"
    first = ranking.top_k_bucketed(cheap_scores(designs, fragments), shortlist, path, F.pmod("idx", F.lit(buckets)), buckets)
    short = ranking.top_k(first, rerank).select("combo_compact", "student_rank_score")
    again = writers.stage(spark, folder, "rerank", parameters | {"rerank": rerank, "model": model, "run_id": run_id}, lambda: rescored(short, fragments, rescore, memo_path, model))
    if memo_path:
        new = again.where("not teacher_cache_hit")
        memo.append(memo_path, new.select("key", sequences.sha256(F.col("sequence_aa")).alias("seq_hash"), F.length("sequence_aa").alias("seq_len"), "global_score", "junction_scores", F.lit("{}").alias("meta"), F.unix_timestamp().cast("double").alias("created_at")))
    out = finished(again, artifact, top, least, run_id, seed)
    writers.export_csv(out, f"{folder}/ranking", "final_rank")
    hits = again.agg(F.count("*").alias("n"), F.count_if("teacher_cache_hit").alias("hits")).first()
    writers.metadata(spark, f"{folder}/metadata", parameters | {"rerank": rerank, "top": top, "least": least, "model": model, "run_id": run_id, "designs": combos.SPACE if sample is None else sample, "rescored": hits["n"], "from_memo": hits["hits"], "s_min_threshold": artifact["s_min_threshold"]})
    return out
