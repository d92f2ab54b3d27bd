"""Tables of earlier runs, replayed."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lattix.functions import junctions, sequences
from lattix.jobs.queries import ARTIFACT
from lattix.operators import calibration, library, ranking, sampling
from lattix.sources import readers

HERE = Path(__file__).parent / "golden"
LETTERS = {"As": "A", "Lb": "L", "Fn": "F", "Mb2": "M"}


@pytest.fixture(scope="module")
def fragments(spark):
    rows = readers.table(spark, str(HERE / "library.csv"), readers.LIBRARY, "parent", "slot")
    names = F.create_map(*[F.lit(x) for kv in LETTERS.items() for x in kv])
    return rows.withColumn("letter", names[F.col("parent")])


@pytest.fixture(scope="module")
def reranked(spark):
    return readers.table(spark, str(HERE / "reranked.csv"), readers.RERANKED, "combo_compact").cache()


def test_library(fragments):
    r = fragments.agg(F.count("*"), F.sum(F.length("aa_sequence")), F.min("aa_length"), F.max("aa_length")).first()
    assert tuple(r) == (44, 5065, 14, 312) and library.duplicates(fragments).count() == 0


def test_sequences_and_hashes(fragments, reranked):
    made = library.built(reranked.select("combo_compact", F.col("sequence_aa").alias("want"), "sequence_hash"), fragments)
    assert made.where((F.col("want") != F.col("sequence_aa")) | (F.col("sequence_hash") != sequences.sha256(F.col("sequence_aa")))).count() == 0


def test_junction_summaries(reranked):
    j = junctions.gathered(reranked.columns)
    off = reranked.where((F.abs(junctions.junction_mean(j) - F.col("junction_mean")) > 1e-9) | (F.abs(junctions.junction_min(j) - F.col("junction_min")) > 1e-9))
    assert reranked.count() == 20 and off.count() == 0


def test_top_ten(spark, reranked):
    want = spark.read.csv(str(HERE / "top.csv"), header=True).orderBy(F.col("final_rank").cast("int")).collect()
    top = ranking.final_rank(ranking.greedy_diversity(calibration.apply(reranked, ARTIFACT), 10, least=1)).orderBy("final_rank").collect()
    assert [r["combo_compact"] for r in top] == [w["combo_compact"] for w in want]
    assert [r["calibrated_prob"] for r in top] == pytest.approx([float(w["calibrated_prob"]) for w in want], rel=1e-6)
    columns = ranking.export_columns(ranking.final_rank(ranking.greedy_diversity(calibration.apply(reranked, ARTIFACT), 10, least=1))).columns
    assert columns == list(want[0].asDict())


def test_sample(spark):
    want = (HERE / "sample_13.txt").read_text().split()
    assert sorted(r[0] for r in sampling.drawn(spark, len(want), 13).collect()) == sorted(want)


def test_candidates_give_the_library(spark, fragments):
    cand = readers.table(spark, str(HERE / "candidates.csv"), readers.CANDIDATES).withColumn("gen_idx", F.col("rank")).drop("rank")
    chosen = library.chain(cand, keep=3, overlap=5)
    key = ["parent", "slot", "orientation", "frame", "parent_start", "parent_end", "adjusted_score"]
    assert chosen.select(key).exceptAll(fragments.select(key)).count() == 0 and chosen.count() == 44
    assert {r["parent"] for r in chosen.where("fell_back").collect()} == {"Fn", "Lb"}
    flags = library.ambiguous(cand).select("parent", "slot", F.col("ambiguous").alias("got"))
    assert flags.join(fragments, ["parent", "slot"]).where("got <> ambiguous").count() == 0
    want = {r["parent"]: r["slots_increasing"] == "True" for r in spark.read.csv(str(HERE / "qc.csv"), header=True).collect()}
    assert {r["parent"]: r["slots_increasing"] for r in library.slots_increasing(fragments).collect()} == want
