"""Scoring of designs as they arrive: each micro-batch goes through the memo."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lattix.functions import sequences
from lattix.operators import memo
from lattix.operators.scorers import Scorer, summaries


def score_stream(designs: DataFrame, scorer: Scorer, model: str, memo_path: str, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query from designs (sequence_aa, domain_lengths) to a Parquet table of scores.

    A batch that runs again after a failure finds its scores in the memo and writes to the same
    folder of the output, so each batch counts once.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keyed = batch.withColumn("key", sequences.cache_key(F.col("sequence_aa"), F.col("domain_lengths"), model))
        done = memo.scored(keyed, memo.lookup(keyed, memo_path), lambda d: summaries(scorer(d)))
        done.write.mode("overwrite").parquet(f"{out}/batch={number}")
        got = spark.read.parquet(f"{out}/batch={number}").where("not teacher_cache_hit").dropDuplicates(["key"])
        memo.append(memo_path, got.select("key", sequences.sha256(F.col("sequence_aa")).alias("seq_hash"), F.length("sequence_aa").alias("seq_len"), "global_score", "junction_scores", F.lit("{}").alias("meta"), F.lit(float(number)).alias("created_at")))

    return designs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
