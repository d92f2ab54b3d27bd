"""Windows over scores in long form: a row for each place of a sequence, of any number of places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.functions import junctions


def window_means(scores: DataFrame, bounds: DataFrame, left: int = junctions.LEFT, right: int = junctions.RIGHT) -> DataFrame:
    """(seq, junction, score): what junctions.window_means() gives for scores (seq, pos, value) and bounds (seq, junction, at).

    Places are cut into buckets as long as a window, so a window reaches into two; scores and windows
    are joined on sequence and bucket, and a long sequence is spread over its buckets. Scores are added up
    before they move on. The first place (0) and null values are in no window; a window without values has NaN,
    one with a NaN too. Sequences without scores keep their windows; repeated rows count each.
    """
    size = left + right
    if size < 1:
        raise ValueError("a window has one place at least")
    bucket = lambda c: F.floor(c / F.lit(size)).cast("long")
    own = scores.where("pos >= 1 and value is not null").select(F.col("seq"), F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value"))
    own = own.withColumn("bucket", bucket(F.col("pos")))
    lo, hi = F.col("at").cast("long") - left, F.col("at").cast("long") + right
    asked = bounds.where("at is not null").select("seq", "junction", lo.alias("lo"), hi.alias("hi")).distinct()
    spread = asked.withColumn("bucket", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi") - 1))))
    met = spread.join(own, ["seq", "bucket"]).where("lo <= pos and pos < hi")
    sums = met.groupBy("seq", "junction", "lo").agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    score = F.coalesce(F.col("total") / F.col("n"), F.lit(float("nan")))
    return asked.join(sums, ["seq", "junction", "lo"], "left").select("seq", "junction", score.alias("score"))
