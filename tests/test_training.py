"""Training of the student: gradient, optimiser, checkpoints, the job."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattix.functions import junctions
from lattix.jobs import queries, train
from lattix.operators import reports, scorers, training
from lattix.sources import weights

SHAPE = training.Shape(embed=3, hidden=4, layers=2, dropout=0.3)


def sequences_of(rng, sizes):
    return [rng.integers(2, 28, n) for n in sizes]


@pytest.mark.parametrize("dropout", [False, True])
def test_gradient_equals_finite_differences(dropout):
    rng = np.random.default_rng(0)
    ids, seeds = sequences_of(rng, [5, 1, 9, 3, 0]), [1, 2, 3, 4, 5] if dropout else None
    w = training.initial(SHAPE, 1)
    values = training.flat(w)
    grad, ll = training.gradient(ids, w, SHAPE, seeds)
    got = training.flat(grad)
    loss = lambda v: -sum(x.sum() for x in training.gradient(ids, training.unflat(v, SHAPE), SHAPE, seeds)[1])
    assert np.isclose(loss(values), -sum(x.sum() for x in ll))
    for k in rng.choice(len(values), 120, replace=False):
        e = np.zeros_like(values)
        e[k] = 1e-5
        want = 0.0 if k < SHAPE.embed else (loss(values + e) - loss(values - e)) / 2e-5  # padding has no gradient
        assert abs(got[k] - want) < 1e-5 * max(1, abs(want))
    assert [len(x) for x in ll] == [len(s) for s in ids]


def test_parts_of_a_batch_add_up(monkeypatch):
    ids = sequences_of(np.random.default_rng(3), [7, 4, 30, 2, 11])
    w = training.initial(SHAPE, 2)
    whole, ll = training.gradient(ids, w, SHAPE, [1, 2, 3, 4, 5])
    monkeypatch.setattr(training, "POSITIONS", 12)
    cut, again = training.gradient(ids, w, SHAPE, [1, 2, 3, 4, 5])
    assert np.allclose(training.flat(whole), training.flat(cut)) and all(np.allclose(a, b) for a, b in zip(ll, again, strict=True))
    plain = [training.gradient([s], w, training.Shape(3, 4, 2, 0.0)) for s in ids]
    both, ll = training.gradient(ids, w, training.Shape(3, 4, 2, 0.0))
    assert np.allclose(training.flat(both), sum(training.flat(g) for g, _ in plain)) and all(np.allclose(a, b[0]) for a, (_, b) in zip(ll, plain, strict=True))


def test_likelihoods_are_those_of_the_scorer():
    ids, w = sequences_of(np.random.default_rng(4), [6, 12, 1]), training.initial(training.Shape(5, 6, 2, 0.0), 7)
    _, ll = training.gradient(ids, w, training.Shape(5, 6, 2, 0.0))
    assert all(np.allclose(a, b) for a, b in zip(ll, scorers.Network(w).log_likelihoods(ids), strict=True))


def test_optimiser_clips_and_decays():
    a = training.Adam(rate=0.1, decay=0.5, clip=1.0)
    out = a.step(np.array([1.0, -2.0]), np.array([300.0, -400.0]))
    assert np.allclose(out, np.array([1.0, -2.0]) * 0.95 - 0.1 * np.array([1, -1]), atol=1e-5)
    x, a = np.array([3.0]), training.Adam(rate=0.1, decay=0.0)
    for _ in range(300):
        x = a.step(x, 2 * x)
    assert abs(x[0]) < 0.05


def test_checkpoints(spark, tmp_path):
    w = training.initial(SHAPE, 5)
    weights.save(spark, f"{tmp_path}/a", w, SHAPE, epoch=4)
    got, shape, about = weights.load(spark, f"{tmp_path}/a")
    assert shape == SHAPE and about["epoch"] == 4 and list(got) == list(w) and all((got[n] == w[n]).all() for n in w)
    df = spark.createDataFrame([("ACDX",), ("A" * 30,)], "sequence_aa string")
    own = [r["token_ll"] for r in scorers.network_scorer(w)(df).collect()]
    assert own == [r["token_ll"] for r in weights.saved_scorer(spark, f"{tmp_path}/a")(df).collect()]
    table = spark.read.parquet(f"{tmp_path}/a")
    broken = {
        "another vocabulary": table.withColumn("about", F.regexp_replace("about", '"A", "C"', '"C", "A"')),
        "description": table.where("about is null"),
        "not those of its shape": table.where("name <> 'lm_head.bias'"),
        "has the shape": table.withColumn("shape", F.when(F.col("name") == "lm_head.bias", F.array(F.lit(2))).otherwise(F.col("shape"))),
    }
    for n, (message, df) in enumerate(broken.items()):
        df.write.parquet(f"{tmp_path}/b{n}")
        with pytest.raises(ValueError, match=message):
            weights.load(spark, f"{tmp_path}/b{n}")


def test_training_job(spark, sf, tmp_path):
    history = queries.student(spark, sf, str(tmp_path))
    rows = history.orderBy("epoch").collect()
    assert history.columns == list(train.HISTORY) and [r["epoch"] for r in rows] == [1, 2, 3]
    assert rows[-1]["val_nll"] < rows[0]["val_nll"] and rows[-1]["train_loss"] < rows[0]["train_loss"]
    best = reports.best_epoch(history).first()["epoch"]
    w, shape, about = weights.load(spark, f"{tmp_path}/best")
    assert about["epoch"] == best and weights.load(spark, f"{tmp_path}/last")[2]["epoch"] == 3
    summary = json.loads(spark.read.text(f"{tmp_path}/summary").first()[0])
    assert summary["best_epoch"] == best and summary["n_train"] + summary["n_val"] <= queries.TAUGHT
    data = spark.read.parquet(f"{tmp_path}/batches")
    # what validation says, once more from the saved network
    val = data.where("is_val = 1").collect()
    net = scorers.Network(w)
    ids = [r["tokens"] for r in data.where("is_val = 1").select(scorers.tokens_of(F.col("sequence_aa")).alias("tokens")).collect()]
    ll = net.log_likelihoods([np.array(x) for x in ids])
    mae = np.mean([abs(x.mean() - r["teacher_global"]) for x, r in zip(ll, val, strict=True)])
    assert np.isclose(mae, rows[best - 1]["global_mae"], atol=1e-6)
    # a step is the gradient of its rows, whatever tasks they are dealt to
    batch = data.where("is_val = 0 and batch = 0")
    values = training.flat(w)
    grad, stats = train.step_gradient(batch.repartition(3), values, shape, None)
    tokens = [np.array(r[0]) for r in batch.select(scorers.tokens_of(F.col("sequence_aa"))).collect()]
    want, own = training.gradient(tokens, w, shape)
    assert np.allclose(grad, training.flat(want), atol=1e-2) and np.isclose(stats[0], sum(x.sum() for x in own), rtol=1e-4) and stats[1] == sum(map(len, tokens))
    scored = scorers.summaries(scorers.network_scorer(w)(batch)).collect()
    assert np.isclose(stats[2], sum((r["global_score"] - r["teacher_global"]) ** 2 for r in scored), rtol=1e-3) and stats[5] == junctions.JUNCTIONS * len(scored)
