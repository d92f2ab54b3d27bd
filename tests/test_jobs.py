"""The jobs: ranking, distillation set, calibration, fragment library."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattix.functions import combos
from lattix.jobs import calibrate, distill, fragment_library, rank
from lattix.operators import calibration, library, memo, ranking, sampling, scorers, seams

ARTIFACT = {"features": list(calibration.FEATURES), "coefficients": [0.4, -0.2, 0.3], "intercept": 1.0, "s_min_threshold": -3.0}


@pytest.fixture(scope="module")
def fragments(spark):
    rng = random.Random(3)
    rows = [(c, s, "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(rng.randrange(1, 40)))) for c in "ALFM" for s in range(1, 12)]
    return spark.createDataFrame(rows, "letter string, slot int, aa_sequence string")


@pytest.fixture(scope="module")
def scorer(fragments):
    return scorers.bigram_scorer(scorers.bigram_fit(fragments, "aa_sequence"))


def test_seams_score_as_sequences_do(spark, fragments, scorer):
    designs = sampling.drawn(spark, 300, 5).withColumn("idx", combos.to_index(F.col("combo_compact")))
    names = ("global_score", "junction_mean", "junction_min")
    fast = {r["combo_compact"]: [r[n] for n in names] for r in seams.scores(designs, fragments, scorer).collect()}
    slow = {r["combo_compact"]: [r[n] for n in names] for r in scorers.summaries(scorer(library.built(designs, fragments))).collect()}
    assert fast.keys() == slow.keys() and all(np.allclose(fast[k], slow[k], atol=1e-9) for k in fast)
    for bad in (fragments.where("slot < 11"), fragments.withColumn("aa_sequence", F.expr("if(slot = 4, '', aa_sequence)"))):
        with pytest.raises(ValueError, match="lacks"):
            seams.tables(bad, scorer)


def test_summaries_are_the_window_functions(spark):
    from lattix.functions import junctions

    rng = random.Random(1)
    rows = [(k, [rng.choice([math.nan, None, rng.random()]) if k % 2 else rng.random() for _ in range(rng.randrange(0, 90))], [rng.randrange(0, 9) for _ in range(11)]) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, token_ll array<double>, domain_lengths array<int>")
    want = df.select("k", junctions.window_means(junctions.from_tokens(F.col("token_ll")), junctions.boundaries(F.col("domain_lengths"))).alias("w"))
    got = {r["k"]: r["junction_scores"] for r in scorers.summaries(df).collect()}
    for r in want.collect():
        assert np.allclose(got[r["k"]], r["w"], equal_nan=True)
    with pytest.raises(Exception, match="eleven"):
        scorers.summaries(df.withColumn("domain_lengths", F.array(F.lit(1)))).collect()


def test_ranking_run_resumes_and_fills_the_memo(spark, fragments, tmp_path):
    where = {"folder": str(tmp_path / "run"), "sample": 400, "prefix": "AL", "seed": 7, "buckets": 3, "shortlist": 60, "rerank": 25, "top": 10, "memo_path": str(tmp_path / "memo"), "run_id": "r7"}
    first = rank.run(spark, fragments, ARTIFACT, **where).orderBy("final_rank").collect()
    assert [r["final_rank"] for r in first] == list(range(1, 11)) and {(r["source_run_id"], r["seed"]) for r in first} == {("r7", 7)}
    assert all(r["combo_compact"].startswith("AL") and r["sequence_hash"] for r in first)
    text = spark.read.text(f"{where['folder']}/metadata").first()["value"]
    assert json.loads(text)["rescored"] == 25 and json.loads(text)["from_memo"] == 0
    assert memo.read(spark, where["memo_path"]).count() == 25
    assert [tuple(r) for r in rank.run(spark, fragments, ARTIFACT, **where).orderBy("final_rank").collect()] == [tuple(r) for r in first]
    other = where | {"folder": str(tmp_path / "other"), "run_id": "r8"}
    rank.run(spark, fragments, ARTIFACT, **other)
    assert json.loads(spark.read.text(f"{other['folder']}/metadata").first()["value"])["from_memo"] == 25
    # the same designs without the job around
    designs = sampling.drawn(spark, 400, 7, "AL").withColumn("idx", combos.to_index(F.col("combo_compact")))
    plain = rank.rank(designs, fragments, ARTIFACT, 60, 25, 10).orderBy("final_rank").collect()
    assert [r["combo_compact"] for r in plain] == [r["combo_compact"] for r in first]


def test_distillation_set(spark, fragments, scorer):
    sample, active = sampling.drawn(spark, 20, 1), spark.createDataFrame([("A" * 11,), ("L" * 11,)], "combo_compact string")
    known = spark.createDataFrame([], memo.SCHEMA)
    out = distill.distill(sample.union(sample), active, fragments, scorer, known, "m", "d1", 1).collect()
    assert len({r["combo_compact"] for r in out}) == len(out) == 22 and not any(r["teacher_cache_hit"] for r in out)
    assert all(r["junction_min"] == min(r[f"junction_{k:02d}"] for k in range(1, 11)) for r in out)
    wide = spark.createDataFrame([["a"] * 11 + ["x"], ["A"] * 10 + [None, "y"]], [f"s{k:02d}" for k in range(11)] + ["note"])
    rows = distill.reconstructed(wide, fragments).collect()
    assert [r["combo_compact"] for r in rows] == ["A" * 11] and rows[0]["sequence_aa"] == library.built(active, fragments).where("combo_compact like 'A%'").first()["sequence_aa"]


def test_calibration_run(spark, fragments, scorer, tmp_path):
    active, background = sampling.drawn(spark, 60, 2, "A"), sampling.drawn(spark, 200, 3)
    artifact, both = calibrate.calibrate(spark, active, background.union(active), fragments, scorer, str(tmp_path), size=90, run_id="c")
    assert artifact == calibration.load(spark, f"{tmp_path}/artifact") and artifact["train_summary"] == {"active": 60, "background": 90}
    assert both.count() == 150 and both.where("label = 1").count() == 60
    # the penalised loss has no slope at the fit
    x = both.toPandas()
    f, y = x[list(calibration.FEATURES)].to_numpy(), x["label"].to_numpy()
    m, s = f.mean(axis=0), f.std(axis=0)
    w = np.where(y == 1, 1.0, calibration.BACKGROUND_WEIGHT)
    beta = np.array(artifact["coefficients"]) * s
    slope = ((w * (x["calibrated_prob"].to_numpy() - y))[:, None] * (f - m) / s).sum(axis=0) + beta / calibration.C
    assert np.abs(slope).max() < 1e-3 * w.sum()
    low = np.quantile(x[y == 1]["junction_min"], 0.1)
    assert artifact["s_min_threshold"] == pytest.approx(low)
    calibration.save(spark, artifact | {"s_min_threshold": math.nan}, f"{tmp_path}/none")
    assert math.isnan(calibration.load(spark, f"{tmp_path}/none")["s_min_threshold"])


def test_quantile_by_counts(spark):
    rng = random.Random(4)
    rows = [(k % 3, rng.choice([math.nan, None, 1.0, 2.5, rng.gauss(0, 1)])) for k in range(500)] + [(4, 7.0), (5, None)]
    df = spark.createDataFrame(rows, "g int, junction_min double")
    for q in (0.0, 0.1, 0.37, 1.0):
        got = {r["g"]: r["s_min"] for r in calibration.s_min_grouped(df, "g", q=q).collect()}
        for g in (0, 1, 2, 4):
            values = [v for k, v in rows if k == g and v is not None and not math.isnan(v)]
            assert got[g] == pytest.approx(np.quantile(values, q))
        assert 5 not in got
    assert calibration.s_min_grouped(df.where("g = 5"), q=0.1).first()["s_min"] is None


def test_library_run(spark, tmp_path):
    rng = random.Random(6)
    codon = {"A": "GCT", "L": "CTG", "F": "TTT", "M": "ATG", "K": "AAA", "D": "GAT"}
    proteins, reads = {}, []
    for parent in ("As", "Lb"):
        parts = ["".join(rng.choice("ALFMKD") for _ in range(30)) for _ in range(11)]
        proteins[parent] = "".join(parts)
        for s, p in enumerate(parts, start=1):
            dna = "".join(codon[c] for c in p)
            reads.append((parent, s, "C" * (s % 3) + dna if s % 2 else dna[::-1].translate(str.maketrans("ACGT", "TGCA"))))
    df = spark.createDataFrame(reads, "parent string, slot int, dna string")
    parents = spark.createDataFrame(list(proteins.items()), "parent string, protein string")
    out = fragment_library.run(spark, df, parents, str(tmp_path)).orderBy("parent", "slot").collect()
    assert len(out) == 22 and all(r["orientation"] == ("fwd" if r["slot"] % 2 else "rev") and r["stop_count"] == 0 for r in out)
    for parent in proteins:
        assert "".join(r["aa_sequence"] for r in out if r["parent"] == parent) == proteins[parent]
    assert set(json.loads(spark.read.text(f"{tmp_path}/library_json").first()["value"])) == {f"{p}_{s:02d}" for p in proteins for s in range(1, 12)}
    assert all(r["slots_increasing"] == "true" for r in spark.read.csv(f"{tmp_path}/order", header=True).collect())
    with pytest.raises(Exception, match="no protein"):
        fragment_library.run(spark, df, parents.limit(1), str(tmp_path / "x"))


def test_rows_without_a_key_and_long_shortlists(spark):
    known = spark.createDataFrame([("a", "h", 1, 0.5, [0.5], "{}", 1.0)], memo.SCHEMA)
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), (None, 4)], "key string, n int")
    out = memo.scored(rows, known, lambda d: d.withColumn("global_score", F.lit(9.0)).withColumn("junction_scores", F.array(F.lit(9.0)))).collect()
    assert {(r["n"], r["global_score"], r["teacher_cache_hit"]) for r in out} == {(1, 0.5, True), (2, 9.0, False), (3, 9.0, False), (4, 9.0, False)}
    many = ranking.enumerated(spark, 0, 50).withColumn("calibrated_prob", F.lit(0.5))
    assert ranking.greedy_diversity(many, 5, most=50).count() == 5
    with pytest.raises(Exception, match="too many rows"):
        ranking.greedy_diversity(many, 5, most=49).collect()
