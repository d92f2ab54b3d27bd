"""Library, ranking, calibration, memo, reports, sampling, scorers."""

import math
import random
import re
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattix.functions import combos, junctions
from lattix.operators import alignment, bands, calibration, library, memo, ranking, reports, sampling, scorers
from lattix.sources import readers, writers


@pytest.fixture(scope="module")
def fragments(spark):
    return spark.createDataFrame([(c, s, f"{c}{'P' * s}") for c in "ALFM" for s in range(1, 12)], "letter string, slot int, aa_sequence string")


def test_build_sequence(spark, fragments):
    df = spark.createDataFrame([("ALFMALFMALF",)], "combo_compact string")
    r = library.built(df, fragments).first()
    assert r["sequence_aa"] == "".join(f"{c}{'P' * (k + 1)}" for k, c in enumerate("ALFMALFMALF"))
    assert r["domain_lengths"] == list(range(2, 13))
    with pytest.raises(Exception, match="no fragment"):
        library.built(df, fragments.where("slot < 11")).collect()


def test_active_rows(spark):
    cols = [f"s{k}" for k in range(11)] + ["note"]
    df = spark.createDataFrame([["a"] * 11 + ["x"], [" L "] * 11 + ["y"], ["A"] * 10 + ["Q", "z"], ["A"] * 10 + [None, "w"]], cols)
    assert [r["combo_compact"] for r in library.with_combo(library.active_rows(df)).collect()] == ["A" * 11, "L" * 11]
    with pytest.raises(ValueError):
        library.active_rows(df.select("s0", "s1"))


def test_file_names(spark):
    df = spark.createDataFrame([("/a/As_01.dna",), ("x/mb_11.DNA",)], "p string")
    assert [tuple(r["f"]) for r in df.select(readers.fragment_name(F.col("p")).alias("f")).collect()] == [("As", 1), ("Mb2", 11)]
    with pytest.raises(Exception, match="not a fragment file"):
        spark.createDataFrame([("BadName.txt",)], "p string").select(readers.fragment_name(F.col("p")).alias("f")).collect()


def test_greedy_diversity(spark):
    df = spark.createDataFrame([("AAAAAAAAAAA", 0.99), ("AAAAAAAAAAL", 0.98), ("LLLLLLLLLLL", 0.97)], "combo_compact string, calibrated_prob double")
    assert {r["combo_compact"] for r in ranking.greedy_diversity(df, 2).collect()} == {"A" * 11, "L" * 11}
    got = ranking.greedy_diversity(df, 3).orderBy("selection_order").collect()
    assert [(r["combo_compact"][-1], r["selection_reason"]) for r in got] == [("A", "distance"), ("L", "distance"), ("L", "backfill")]
    assert ranking.greedy_diversity(df, 2, least=12).count() == 2
    assert ranking.greedy_diversity(df.limit(0), 2).count() == 0


def test_top_k_puts_nan_last_and_resumes(spark, tmp_path):
    rows = [(combos_of(k), math.nan if k % 5 == 0 else float(k % 7)) for k in range(40)]
    df = spark.createDataFrame(rows, "combo_compact string, student_rank_score double")
    want = sorted(rows, key=lambda r: (math.isnan(r[1]), -r[1] if not math.isnan(r[1]) else 0, r[0]))[:20]
    assert [r[0] for r in ranking.top_k(df, 20).collect()] == [w[0] for w in want]
    path = str(tmp_path / "buckets")
    bucket = F.pmod(F.xxhash64("combo_compact"), F.lit(4))
    for _ in range(2):
        assert [r["combo_compact"] for r in ranking.top_k_bucketed(df, 20, path, bucket, 4).collect()] == [w[0] for w in want]


def combos_of(k):
    return "".join("ALFM"[k >> 2 * i & 3] for i in range(10, -1, -1))


def test_exhaustive(spark):
    rng = random.Random(1)
    w = [rng.randrange(1000) for _ in range(44)]
    got = ranking.exhaustive(spark, spark.createDataFrame([(w,)], "w array<long>"), 3).collect()
    best = [max(w[4 * s : 4 * s + 4]) for s in range(11)]
    assert got[0]["score"] == sum(best) and got[0]["score"] >= got[1]["score"] >= got[2]["score"]
    assert sum(w[4 * s + "ALFM".index(c)] for s, c in enumerate(got[1]["combo_compact"])) == got[1]["score"]


def test_calibration_agrees_with_newton(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(1, 1, (12, 3)), rng.normal(0, 1, (30, 3))])
    y = np.array([1.0] * 12 + [0.0] * 30)
    names = list(calibration.FEATURES)
    a = spark.createDataFrame(x[:12].tolist(), names)
    b = spark.createDataFrame(x[12:].tolist(), names)
    art = calibration.fit(a, b)
    z = (x - x.mean(0)) / x.std(0)
    d, w = np.column_stack([z, np.ones(len(z))]), np.where(y == 1, 1.0, 0.2)
    beta = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-d @ beta))
        g = d.T @ (w * (p - y)) + np.append(beta[:3], 0)
        beta -= np.linalg.solve((d.T * (w * p * (1 - p))) @ d + np.diag([1, 1, 1, 0]), g)
    assert np.allclose(art["coefficients"], beta[:3] / x.std(0), atol=1e-6)
    assert art["s_min_threshold"] == pytest.approx(np.quantile(x[:12, 2], 0.1))
    out = calibration.apply(a, art).toPandas()
    assert np.allclose(out["calibrated_prob"], (1 / (1 + np.exp(-d @ beta)))[:12], atol=1e-6)
    assert (out["passes_s_min"] == (x[:12, 2] >= art["s_min_threshold"])).all()
    with pytest.raises(ValueError):
        calibration.fit(a.limit(0), b)


def test_memo(spark, tmp_path):
    path = str(tmp_path / "memo")
    row = ("k1", "h", 3, -1.5, [float(k) for k in range(10)], "{}", 1.0)
    memo.append(path, spark.createDataFrame([row], memo.SCHEMA))
    assert tuple(memo.read(spark, path).first()) == row
    memo.append(path, spark.createDataFrame([("k1", "h", 3, -2.5, [0.0] * 10, "{}", 2.0)], memo.SCHEMA))
    assert memo.read(spark, path).first()["global_score"] == -2.5
    asked = spark.createDataFrame([("k1",), ("k2",), ("k2",)], "key string")
    calls = []

    def score(df):
        calls.append(df.count())
        return df.withColumn("global_score", F.lit(9.0)).withColumn("junction_scores", F.array(F.lit(0.0)))

    got = memo.scored(asked, memo.read(spark, path), score).collect()
    assert calls == [1] and sorted((r["key"], r["teacher_cache_hit"], r["global_score"]) for r in got) == [("k1", True, -2.5), ("k2", False, 9.0), ("k2", False, 9.0)]
    assert memo.read(spark, str(tmp_path / "none")).count() == 0


def test_memo_is_read_by_buckets(spark, tmp_path):
    path = str(tmp_path / "memo")
    made = spark.range(20_000).selectExpr("concat('k', id) key", "'h' seq_hash", "3 seq_len", "id / 2.0d global_score", "array(1.0d) junction_scores", "'{}' meta", "1.0d created_at")
    memo.append(path, made, 16)
    memo.append(path, made.limit(0), 16)
    memo.append(path, made.where("global_score < 10"), 16)  # nothing new
    assert memo.rows(spark, path).count() == 20_000
    asked = spark.range(100, 30_000, 7).selectExpr("concat('k', id) key", "id")
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        many = memo.marked(asked, memo.lookup(asked, path, few=10))
        plan = many._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # of the rows that ask
        few = memo.lookup(asked.where("id < 115"), path)
        plan = memo.latest(few)._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"SelectedBucketsCount: [123] out of 16", plan) and "In(key, [" in plan and "Exchange" not in plan
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert {r["id"] for r in many.where("teacher_cache_hit and global_score = id / 2").collect()} == set(range(100, 20_000, 7))
    assert sorted(r["key"] for r in few.collect()) == ["k100", "k107", "k114"]
    assert [r["global_score"] for r in memo.get(spark, path, "k5", "none", "k9").orderBy("key").collect()] == [2.5, 4.5]
    memo.compact(spark, path, str(tmp_path / "other"), 4)
    assert memo.read(spark, str(tmp_path / "other")).exceptAll(memo.read(spark, path)).count() == 0
    assert memo.read(spark, str(tmp_path / "other")).count() == 20_000
    with pytest.raises(FileExistsError):
        memo.compact(spark, path, str(tmp_path / "other"))


def test_memo_of_two_writers_and_of_plain_files(spark, tmp_path):
    path = str(tmp_path / "memo")
    made = [spark.range(k * 400, k * 400 + 600).selectExpr("concat('k', id) key", "'h' seq_hash", "3 seq_len", f"{k}.0d global_score", "array(1.0d) junction_scores", "'{}' meta", f"{k}.0d created_at") for k in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: memo.append(path, made[k], 8), range(4)))
    got = {r["key"]: r["global_score"] for r in memo.read(spark, path).collect()}
    assert got == {f"k{i}": float(min(i // 400, 3)) for i in range(1800)}  # of keys of two, the later row
    assert sorted(p.name for p in (tmp_path / "memo").iterdir()) == ["buckets=8"]

    def broken(i):
        raise ValueError("no score")

    bad = made[0].withColumn("global_score", F.udf(broken, "double")("key")).withColumn("created_at", F.lit(9.0))
    with pytest.raises(Exception, match="no score"):
        memo.append(path, bad, 8)
    assert sorted(p.name for p in (tmp_path / "memo").iterdir()) == ["buckets=8"] and memo.rows(spark, path).count() == 2400
    made[1].write.parquet(str(tmp_path / "plain"))
    assert memo.read(spark, str(tmp_path / "plain")).count() == 600
    memo.append(str(tmp_path / "plain"), made[2], 8)
    memo.append(str(tmp_path / "plain"), made[3], 4)
    assert {r["key"]: r["global_score"] for r in memo.read(spark, str(tmp_path / "plain")).collect()} == {k: v for k, v in got.items() if int(k[1:]) >= 400}


def test_chain(spark):
    """The fold against all choices, on small random libraries."""
    rng = random.Random(5)
    rows, want = [], {}
    for parent in range(6):
        slots = {}
        for slot in range(1, 5):
            for gen in range(3):
                start = rng.randrange(60)
                c = (parent, slot, gen, float(rng.randrange(50)), start, start + rng.randrange(1, 25))
                rows.append(c)
                slots.setdefault(slot, []).append(c)
        best, paths = None, [[]]
        for s in range(1, 5):
            paths = [p + [c] for p in paths for c in slots[s] if not p or c[4] >= p[-1][5] - 5]
        if paths:
            best = max(sum(c[3] for c in p) for p in paths)
        want[parent] = best
    df = spark.createDataFrame(rows, "parent int, slot int, gen_idx int, adjusted_score double, parent_start int, parent_end int")
    got = library.chain(df).groupBy("parent").agg(F.sum("adjusted_score").alias("s"), F.max("fell_back").alias("f"), F.count("*").alias("n")).collect()
    for r in got:
        assert r["n"] == 4 and r["f"] == (want[r["parent"]] is None)
        assert want[r["parent"]] is None or r["s"] == want[r["parent"]]


def brute_alignment(t, q):
    n, m = len(t), len(q)
    s = lambda a, b: alignment._SCORES[alignment._NUMBER[ord(a)], alignment._NUMBER[ord(b)]]
    h = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            gaps = [h[i - k][j] - 10 - 0.5 * (k - 1) for k in range(1, i + 1)] + [h[i][j - k] - 10 - 0.5 * (k - 1) for k in range(1, j + 1)]
            h[i][j] = max(0.0, h[i - 1][j - 1] + s(t[i - 1], q[j - 1]), *gaps)
    return max(map(max, h))


def test_local_alignment(spark):
    rng = random.Random(2)
    for _ in range(30):
        t = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(rng.randrange(1, 30)))
        cut = rng.randrange(len(t))
        q = t[:cut] + "".join(rng.choice("WYK") for _ in range(rng.randrange(4))) + t[cut + rng.randrange(3) :]
        got, want = alignment.local_alignment(t, q), brute_alignment(t, q)
        assert (got[0] if got else 0.0) == pytest.approx(want)
        if got:
            assert 0 <= got[1] < got[2] <= len(t) and 0 <= got[3] < got[4] <= len(q)
            assert brute_alignment(t[got[1] : got[2]], q[got[3] : got[4]]) == pytest.approx(want)
    assert alignment.local_alignment("", "A") is None
    df = spark.createDataFrame([("MKV", "MKV"), ("W", "A"), (None, "A")], "t string, q string")
    assert [r["align_score"] for r in alignment.align(df, "t", "q").collect()] == [14.0, None, None]


def test_long_windows(spark):
    """In long form what arrays give; a bucket join, no nested loop; windows at the ends, without values, over NaN."""
    rng = random.Random(6)
    nan = math.nan
    rows = [(i, [None, *(rng.choice([rng.random(), rng.random(), None, nan] if i % 5 == 0 else [rng.random()]) for _ in range(rng.choice([0, 3, 40, 700])))], [rng.randrange(-5, 720) for _ in range(10)]) for i in range(40)]
    df = spark.createDataFrame(rows, "seq long, ll array<double>, bounds array<int>")
    own = df.select("seq", F.posexplode(junctions.window_means(F.col("ll"), F.col("bounds"), 3, 4)).alias("junction", "score"))
    scores, bounds = df.select("seq", F.posexplode("ll").alias("pos", "value")), df.select("seq", F.posexplode("bounds").alias("junction", "at"))
    got = bands.window_means(scores.repartition(5), bounds, 3, 4)
    plain = lambda d: sorted((r["seq"], r["junction"], str(round(r["score"], 9))) for r in d.collect())
    assert plain(got) == plain(own)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_near_pairs(spark):
    """All pairs below a distance, with a hot block that is cut in pieces, whatever the blocks."""
    rng = random.Random(3)
    ids = [rng.randrange(combos.SPACE) for _ in range(60)] + [rng.randrange(4**4) for _ in range(90)] + [5, 5, 6]
    df = spark.createDataFrame([(i,) for i in ids], "idx long").repartition(4)
    own = sorted(set(ids))
    distance = {(a, b): ranking._distance(a, b) for k, b in enumerate(own) for a in own[:k]}
    for below, blocks, most in ((1, None, 10), (2, None, 7), (3, 5, 20), (4, 4, 4096), (11, 11, 30)):
        got = [tuple(r) for r in ranking.near_pairs(df, below, blocks, most).collect()]
        assert len(got) == len(set(got)) and sorted(got) == sorted((a, b, n) for (a, b), n in distance.items() if n < below)
    with pytest.raises(ValueError):
        ranking.near_pairs(df, 0)


def test_diversity_of_any_size(spark):
    """In rounds of any size what the fold chooses."""
    rng = random.Random(8)
    rows = [(i, rng.choice([1.0, 2.0, math.nan, None, rng.random()])) for i in rng.sample(range(4**6), 400)]
    df = spark.createDataFrame(rows, "idx long, score double").repartition(3).cache()
    named = df.withColumn("key", F.lpad("idx", 5, "0")).withColumn("combo_compact", combos.from_index(F.col("idx")))
    for least in (1, 3, 5):
        # the fold breaks ties by the key, of which the alphabet's order is not that of the index
        fold = spark.createDataFrame([(r["idx"], r["score"], "".join("0123"[r["idx"] >> 2 * k & 3] for k in reversed(range(11)))) for r in named.collect()], "idx long, score double, k string")
        want = [r["idx"] for r in ranking.greedy_diversity(fold, 30, "score", "k", least).where("selection_reason = 'distance'").orderBy("selection_order").collect()]
        for head in (1, 7, 400, 5000):
            assert [r["idx"] for r in ranking.diverse(df, 30, "score", least, head).orderBy("selection_order").collect()] == want
    assert ranking.diverse(df.limit(0), 3).count() == 0


def test_permutation(spark):
    for half in (1, 2, 5):
        got = [r[0] for r in spark.range(4**half).select(sampling.permuted(F.col("id"), half, 5)).collect()]
        assert sorted(got) == list(range(4**half)) and (half < 5 or got != sorted(got))
    whole = {r["combo_compact"] for r in sampling.distinct_designs(spark, 4**4, 9, "almfall").collect()}
    assert len(whole) == 4**4 and all(c.startswith("ALMFALL") for c in whole)
    a, b = ([r["idx"] for r in sampling.distinct_designs(spark, 5000, seed).collect()] for seed in (1, 2))
    assert len(set(a)) == 5000 and abs(sum(a) / 5000 / combos.SPACE - 0.5) < 0.03 and len(set(a) & set(b)) < 50
    assert [r["combo_compact"] for r in sampling.distinct_designs(spark, 1, 1, "ALFMALFMALF").collect()] == ["ALFMALFMALF"]
    for n, prefix in ((5, "ALFMALFMAL"), (1, "Q")):
        with pytest.raises(ValueError):
            sampling.distinct_designs(spark, n, 1, prefix)


def test_draws_in_rounds(spark):
    """More draws than there are designs: each comes once in each round, under a number of its own."""
    got = sampling.design_rounds(spark, combos.SPACE + 1000, 13)
    assert got.limit(5000).collect() == sampling.distinct_designs(spark, 5000, 13).collect()
    more = got.where(F.col("idx") >= combos.SPACE).collect()
    assert got.count() == combos.SPACE + 1000 and len(more) == len({r["idx"] for r in more}) == len({r["combo_compact"] for r in more}) == 1000
    assert all(r["idx"] < 2 * combos.SPACE and set(r["combo_compact"]) <= set(combos.ALPHABET) for r in more)


def test_alignments_of_many_pairs(monkeypatch):
    """Pairs of all lengths together are what each is alone, empty ones and null ones included; and for any size of a batch."""
    rng = random.Random(7)
    letters = ["ACDEFGHIKLMNPQRSTVWY", "AW", "acX*Z-"]
    pairs = [tuple("".join(rng.choice(own) for _ in range(rng.choice([0, 1, 3, 20, 90]))) for _ in range(2)) for own in letters * 25] + [(None, "A"), ("A", None)]
    alone = [alignment.local_alignment(*p) for p in pairs]
    assert alignment.local_alignments(pairs) == alone
    monkeypatch.setattr(alignment, "CELLS", 50)
    monkeypatch.setattr(alignment, "TOGETHER", 3)
    assert alignment.local_alignments(pairs) == alone
    for (t, q), got in zip(pairs, alone, strict=True):
        if t and q and len(t) * len(q) < 500:
            assert (got[0] if got else 0.0) == pytest.approx(brute_alignment(t, q))


def test_a_filter_does_not_align_twice(spark):
    df = spark.createDataFrame([("MKV", "MKV")], "t string, q string")
    plan = alignment.align(df, "t", "q").where("align_score is not null")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1


def test_reports(spark):
    nan = math.nan
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (nan, 1.0), (3.0, math.inf)], "x double, y double")
    r = reports.regression_metrics(df, "x", "y").first()
    assert (r["n"], r["corr"], r["mae"], r["mse"]) == (2, pytest.approx(1.0), 1.5, 2.5)
    assert math.isnan(reports.regression_metrics(df.limit(0), "x", "y").first()["mae"])
    a = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "combo_compact string, rank int")
    b = spark.createDataFrame([("B", 1), ("A", 2), ("D", 3), ("E", 4)], "combo_compact string, rank int")
    assert [r["overlap"] for r in reports.overlap_curve(a, b).orderBy("k").collect()] == [0.0, 1.0, pytest.approx(2 / 3)]


def test_sampling(spark):
    a, b = (sorted(r[0] for r in sampling.drawn(spark, 12, 13).collect()) for _ in range(2))
    assert a == b and len(set(a)) == 12
    assert all(r[0].startswith("AL") for r in sampling.drawn(spark, 5, 1, "al").collect())
    with pytest.raises(ValueError):
        sampling.drawn(spark, 5, 1, "A" * 11)
    train, val = sampling.split_indices(10, 0.2, 7)
    assert not set(train) & set(val) and len(val) == 2 and len(train) == 8
    part = ranking.enumerated(spark, 0, 20_000)
    assert abs(sampling.split(part, 0.2, 1, "combo_compact").where("is_val").count() - 4000) < 300




def test_network_depends_only_on_the_past(spark):
    rng = np.random.default_rng(0)
    v, e, h = 28, 6, 5
    w = {"embed.weight": rng.normal(size=(v, e)), "lm_head.weight": rng.normal(size=(v, h)), "lm_head.bias": rng.normal(size=v)}
    for k, size in ((0, e), (1, h)):
        w |= {f"gru.weight_ih_l{k}": rng.normal(size=(3 * h, size)), f"gru.weight_hh_l{k}": rng.normal(size=(3 * h, h)), f"gru.bias_ih_l{k}": rng.normal(size=3 * h), f"gru.bias_hh_l{k}": rng.normal(size=3 * h)}
    df = spark.createDataFrame([("ACDEF",), ("ACDWW",), ("",)], "sequence_aa string").repartition(1)
    a, b, c = (r["token_ll"] for r in scorers.network_scorer(w)(df).collect())
    assert a[:3] == pytest.approx(b[:3]) and len(a) == 5 and a[3] != b[3] and c == [] and all(x < 0 for x in a)


def test_writers(spark, tmp_path, fragments):
    lib = fragments.where("slot = 1").withColumn("parent", F.col("letter"))
    assert writers.library_json(lib).first()["json"] == '{"A_01":"AP","F_01":"FP","L_01":"LP","M_01":"MP"}'
    calls = []

    def make():
        calls.append(1)
        return lib

    for _ in range(2):
        assert writers.stage(spark, str(tmp_path), "x", {"a": 1}, make).count() == 4
    writers.stage(spark, str(tmp_path), "x", {"a": 2}, make)
    assert len(calls) == 2
    writers.metadata(spark, str(tmp_path / "m"), {"x": math.nan})
    assert spark.read.text(str(tmp_path / "m")).first()[0] == '{"x": null}'


def test_stream_scores_once(spark, tmp_path, fragments):
    from lattix.streaming.scoring import score_stream

    df = library.built(ranking.enumerated(spark, 0, 6), fragments).select("sequence_aa", "domain_lengths")
    df.write.parquet(str(tmp_path / "in"))
    scorer = scorers.bigram_scorer(scorers.bigram_fit(df))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for k in range(2):
        q = score_stream(stream, scorer, "m", str(tmp_path / "memo"), str(tmp_path / "out"), str(tmp_path / f"c{k}"))
        q.awaitTermination()
        got = spark.read.parquet(str(tmp_path / "out"))
        assert got.count() == 6 and got.where("teacher_cache_hit").count() == 6 * k
    assert memo.read(spark, str(tmp_path / "memo")).count() == 6


def test_all_frames_of_reads_are_aligned(spark, sf):
    from lattix.jobs import queries

    reads = {r["doc_id"]: r["dna"] for r in queries.reads(spark, sf).collect()}
    target = {(r["letter"], r["slot"]): r["aa_sequence"] for r in queries.parts(spark, sf).collect()}
    got = queries.local_alignment(spark, sf).collect()
    assert len(got) == 6 * len(reads) and {(r["letter"], r["slot"]) for r in got} == set(target)
    aa = {(r["doc_id"], r["orientation"], r["frame"]): r["aa_raw"] for r in queries.six_frame_translate(spark, sf).collect()}
    for r in got[::40]:
        want = alignment.local_alignment(target[r["letter"], r["slot"]], aa[r["doc_id"], r["orientation"], r["frame"]])
        assert r["align_score"] == (want[0] if want else None)
    found = queries.translated_candidates(spark, sf).collect()
    assert {r["doc_id"] for r in found} == set(reads) and {r["gen_idx"] for r in found} == set(range(6)) and {r["slot"] for r in found} == set(range(1, 12))
    for r in found[::40]:
        protein = "".join(target[r["parent"], k] for k in range(1, 12))
        assert (r["align_score"], r["parent_start"], r["parent_end"], r["query_start"], r["query_end"]) == alignment.local_alignment(protein, aa[r["doc_id"], r["orientation"], r["frame"]])


def test_split_is_exact_and_models_are_whole(spark, fragments):
    for n, keys in ((3, 3), (7, 1), (1000, 40)):
        rows = spark.range(n).select("id", (F.col("id") % keys).cast("string").alias("k"))
        for most in (4, 1 << 16):
            got = sampling.split(rows, 0.2, 5, "k", most).collect()
            assert len(got) == n and sum(r["is_val"] for r in got) == max(1, round(n * 0.2)) and {r["id"] for r in got} == set(range(n))
            assert sorted(got) == sorted(sampling.split(rows.repartition(3), 0.2, 5, "k", most).collect())
    with pytest.raises(ValueError):
        sampling.split(rows.limit(1), 0.2, 5, "k")
    model = scorers.bigram_fit(fragments, "aa_sequence")
    with pytest.raises(Exception, match="too many letter pairs"):
        scorers.bigram_scorer(model, most=2)(fragments.withColumnRenamed("aa_sequence", "sequence_aa")).collect()
