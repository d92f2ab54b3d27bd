"""Keys, sequences and junction scores, against the values that the design study's own tests name."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lattix.functions import combos, junctions, sequences


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {t}" for n, t in zip(names, [{int: "long", str: "string", float: "double", list: "array<double>"}[type(v)] for v in values.values()], strict=True))) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_index_to_combo(spark):
    got = spark.createDataFrame([(0,), (1,), (3,), (4,)], "i long").select(combos.from_index(F.col("i")).alias("c")).collect()
    assert [r["c"] for r in got] == ["A" * 11, "A" * 10 + "L", "A" * 10 + "M", "A" * 9 + "LA"]
    with pytest.raises(Exception, match="out of range"):
        one(spark, combos.from_index(F.col("i")), i=combos.SPACE)


def test_round_trip(spark):
    rows = spark.range(0, combos.SPACE, 4099).select("id", combos.from_index(F.col("id")).alias("c"))
    assert rows.where(combos.to_index(F.col("c")) != F.col("id")).count() == 0
    assert rows.where(combos.encoded(combos.decoded(F.col("c"))) != F.col("c")).count() == 0
    assert one(spark, combos.decoded(F.col("c")), c="ALFMALFMALF") == ["As", "Lb", "Fn", "Mb2"] * 2 + ["As", "Lb", "Fn"]


def test_invalid_combo(spark):
    assert one(spark, combos.problem(F.col("c")), c="ALFMALFMALX") == "letters X"
    assert one(spark, combos.problem(F.col("c")), c="AX") == "length 2"
    assert one(spark, combos.validated(F.col("c")), c=" alfmalfmalf ") == "ALFMALFMALF"
    with pytest.raises(Exception, match="invalid design key"):
        one(spark, combos.validated(F.col("c")), c="ALFMALFMALX")


def test_hamming(spark):
    assert one(spark, combos.hamming_text(F.col("a"), F.col("b")), a="AAAAAAAAAAA", b="AAAAAAAALAA") == 1
    rng = random.Random(3)
    pairs = [(rng.randrange(combos.SPACE), rng.randrange(combos.SPACE)) for _ in range(50)]
    df = spark.createDataFrame(pairs, "a long, b long")
    a, b = combos.from_index(F.col("a")), combos.from_index(F.col("b"))
    assert df.where(combos.hamming(F.col("a"), F.col("b")) != combos.hamming_text(a, b)).count() == 0


def test_boundaries_and_windows(spark):
    assert one(spark, junctions.boundaries(F.array(*[F.lit(1)] * 11))) == list(range(1, 11))
    ll = F.concat(F.array(F.lit(None).cast("double")), F.array_repeat(F.lit(1.0), 99))
    assert one(spark, junctions.window_means(ll, F.array(F.lit(10)), 2, 2)) == [1.0]
    assert math.isnan(one(spark, junctions.window_means(F.array(F.lit(None).cast("double")), F.array(F.lit(1)), 2, 2))[0])


@pytest.mark.parametrize("values,mean,least", [([1.0, math.nan, 3.0], 2.0, 1.0), ([math.nan], math.nan, math.nan), ([], math.nan, math.nan)])
def test_summaries_skip_nan(spark, values, mean, least):
    got = spark.createDataFrame([(values,)], "x array<double>").select(junctions.junction_mean(F.col("x")), junctions.junction_min(F.col("x"))).first()
    assert [str(g) for g in got] == [str(mean), str(least)]


def test_token_mapping(spark):
    for n, m in ((0, 3), (1, 3), (5, 3), (9, 4), (3, 7)):
        tok = [float(k) for k in range(m)]
        got = one(spark, junctions.to_residues(F.col("t"), F.lit(n)), t=tok)
        want = [] if n == 0 else [None] + [tok[min(int((i - 1) * m / (n - 1)), m - 1)] for i in range(1, n)]
        assert got == want


def test_sequences(spark):
    assert one(spark, sequences.sanitised(F.col("s")), s="acgtRnxACG") == "ACGTNACG"
    assert one(spark, sequences.reverse_complement(F.col("s")), s="AACGTN") == "NACGTT"
    assert one(spark, sequences.translated(F.col("s"), 0), s="ATGTAACTNNNNAC") == "M*LX"
    assert one(spark, sequences.translated(F.col("s"), 2), s="AT") == ""
    assert one(spark, sequences.longest_run(F.col("s"), 2), s="abc1DEF2gh") == "ABC"
    assert one(spark, sequences.longest_run(F.col("s"), 9), s="abc1DEF2gh") is None
    assert one(spark, sequences.tokens(F.col("s")), s="A?X") == [2, 27, 27]
    assert one(spark, sequences.shifted(sequences.tokens(F.col("s"))), s="AC") == [1, 2]
    assert one(spark, sequences.uniform_split(F.col("n")), n=25) == [2] * 10 + [5]
    assert one(spark, sequences.adjusted_score(F.lit(100.0), F.col("s")), s="A*XX") == 40.0
    assert one(spark, sequences.x_fraction(F.col("s")), s="") == 1.0
    assert one(spark, sequences.warnings(F.lit(True), F.lit(1), F.lit(0.2))) == "ambiguous_top2;stop_in_trimmed;high_X_fraction"
    assert math.isnan(one(spark, sequences.number_or_nan(F.col("s")), s="abc"))


def test_cache_key_depends_on_lengths(spark):
    key = lambda x: sequences.cache_key(F.lit("AAAA"), F.array(*[F.lit(v) for v in x]), "m")
    assert one(spark, key([1, 3])) != one(spark, key([2, 2]))


def test_frames_are_translated_in_one_pass(spark, monkeypatch):
    """Frames are what translated() gives for each way, and no codon is looked up by an expression."""
    import random

    rng = random.Random(5)
    reads = ["", "A", "AT", "ATG", "NNN", "ATGxTA", "AéGTAA", *("".join(rng.choice("ACGTN") for _ in range(rng.randrange(40))) for _ in range(200)), None]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(reads)], "k int, s string")
    ways = [F.col("s"), sequences.reverse_complement(F.col("s"))]
    out = df.select(sequences.six_frames(F.col("s")).alias("f"), sequences.six_frames(F.col("s"), False).alias("g"), F.array(*[sequences.translated(w, f) for w in ways for f in range(3)]).alias("want"))
    for r in out.collect():
        assert [x["aa"] for x in r["f"]] == r["want"] and [x["aa"] for x in r["g"]] == r["want"][:3]
        assert [(x["gen_idx"], x["orientation"], x["frame"]) for x in r["f"]] == [(k, "fwd" if k < 3 else "rev", k % 3) for k in range(6)]
    assert "map(" not in df.select(sequences.six_frames(F.col("s")).alias("f"))._jdf.queryExecution().toString()
