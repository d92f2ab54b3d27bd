"""Operators 11 to 13 against plain re-statements, with odd ids, repeated rows and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattix.llm import common, merkle, resample, topk


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def lower(s):
    return s and re.sub("[A-Z]", lambda m: m[0].lower(), s)


def tree(leaves):
    """Levels of a list of digests, by eights."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([sha("".join(x[i : i + 8])) for i in range(0, len(x), 8)])
    return levels


def proof(levels, k):
    out = []
    for level in levels[:-1]:
        at = k // 8 * 8
        out.append((level[at:k], level[k + 1 : at + 8]))
        k //= 8
    return out


def manifest(rows):
    """[(doc_id, leaf, subroot, root, proof, folded, verified)] of rows (doc_id, source, lang, n_chars, text)."""
    digest = lambda r, text: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], text)))
    langs = {}
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        langs.setdefault(r[2], []).append((r[0], digest(r, r[4]), digest(r, lower(r[4])) if hit else None))
    order = sorted(langs, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for v in order:
        langs[v].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2] or ""))
        trees[v] = tree([x[1] for x in langs[v]])
    top = tree([trees[v][-1][0] for v in order])
    out = []
    for n, v in enumerate(order):
        for k, (doc, leaf, changed) in enumerate(langs[v]):
            path = proof(trees[v], k) + proof(top, n)
            h = changed or leaf
            for a, b in path:
                h = sha("".join(a) + h + "".join(b))
            out.append((doc, leaf, trees[v][-1][0], top[-1][0], sha("".join("".join(a) + "".join(b) for a, b in path)), h, h == top[-1][0]))
    return sorted(out, key=str)


DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, key long, place long"


def documents(spark, rows, n=5):
    return spark.createDataFrame([(*r, "t", 1, 2) for r in rows], DOCS).repartition(n)


def manifest_of(spark, rows):
    df = merkle.manifest(documents(spark, rows))
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, df.collect()), key=str)


def test_manifest_of_odd_rows(spark, prose):
    rng = random.Random(3)
    ids = [0, 1, 63, 64, 65, -1, -64, -65, 2**62, -(2**63), 2**63 - 1, None, None, 7, 7, 7, 7, 100, 100, *rng.sample(range(-(2**40), 2**40), 60), *range(1000, 1100)]
    rows = [(i, rng.choice(["a", None, "é"]), rng.choice(["en", "en", "en", "", None, "ß", "one"]), rng.choice([0, None, 12]), rng.choice([None, "", "ABC é", prose(rng, 9)])) for i in ids]
    rows += [rows[17]] * 3 + [(5, "a", "lone", 1, "Alone")]
    assert manifest_of(spark, rows) == manifest(rows)


def test_manifest_of_several_arrays(spark):
    """More leaves than a slot array has in one language, another with exactly as many, one with eight."""
    rows = [(3 * i, "s", "big", i, f"Text {i}") for i in range(merkle.SLOTS + 9)]
    rows += [(3 * i + 1, "s", "full", i, f"text {i}") for i in range(merkle.SLOTS)] + [(3 * i + 2, "s", "few", i, "x") for i in range(8)]
    rows += [(10**6 + i, "s", f"l{i}", i, "x") for i in range(20)]
    assert manifest_of(spark, rows) == manifest(rows)


def test_manifest_of_nothing(spark):
    assert manifest_of(spark, []) == []
    one = [(4, None, None, None, None)]
    (row,) = manifest_of(spark, one)
    assert [row] == manifest(one) and row[1] == row[2] == row[3] == sha("1:4----") and row[4] == sha("")


def test_in_order(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(50), i) for i in range(500)]
    got = common.in_order(spark.createDataFrame(rows, "x long, y long").repartition(6), "x", "y").collect()
    assert [(r["x"], r["y"]) for r in sorted(got, key=lambda r: r["at"])] == sorted(rows) and {r["at"] for r in got} == set(range(500))


def vectors(spark, rows, n=4):
    return spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, score long, total double").repartition(n)


def top(rows, k=5, every=50):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in ok:
        if i % every == 0:
            queries[i] = max(v, queries.get(i, v))
    out = []
    for q, v in queries.items():
        scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in ok if i != q))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_topk(spark, seed, monkeypatch):
    """Ties, repeated vectors and ids, odd components, lengths that differ; small tiles and passes of a few queries."""
    monkeypatch.setattr(topk, "PASS_BYTES", 8 * 40 * 7)
    monkeypatch.setattr(topk, "SHARD", 60)
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, 40)).round(1 if seed else 3)
    rows = [(i, (base[rng.integers(6)] + rng.normal(size=40) * rng.choice([0, 0.3])).tolist()) for i in range(0, 600, 5)]
    rows += [(i, base[0].tolist()) for i in range(1001, 1030)] + [(50, base[1].tolist()), (50, base[2].tolist()), (7, base[3].tolist()), (7, base[3].tolist())]
    rows += [(2000, [-1.0] * 40), (2050, [1.0]), (2051, []), (2100, None), (2150, [1.0, None]), (2200, [float("nan")] * 40), (2250, [math.inf] + [0.0] * 39), (None, base[0].tolist())]
    got = topk.search(vectors(spark, rows))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == top(rows)


def test_topk_of_few_rows(spark):
    assert topk.search(vectors(spark, [])).count() == 0
    assert topk.search(vectors(spark, [(0, None)])).count() == 0
    assert topk.search(vectors(spark, [(0, [1.0])])).count() == 0
    rows = [(0, [1.0, -1.0]), (3, [0.5, 0.5]), (50, [-1.0, 0.0])]
    assert sorted(map(tuple, topk.search(vectors(spark, rows)).collect())) == top(rows)
    with pytest.raises(ValueError):
        topk.search(vectors(spark, [(0, [1e9, 1.0])]))


def test_uniform_threshold_prunes():
    """What the phases send: rows that cannot reach the bound are not resolved."""
    rng = np.random.default_rng(0)
    x = rng.integers(-50, 50, (4000, 64))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4000)), pa.array(list(x))], ["vec_id", "v"])
    q = topk.Pass(np.array([0]), x[:1].astype(float), [slice(i, i + 16) for i in range(0, 64, 16)], 5)
    (*entries,) = topk.gathered(q)(iter([batch]))
    assert [e.num_rows for e in entries] == [5] * 4
    totals = sorted({(i, t) for e in entries for i, t in zip(e.column("vec_id").to_pylist(), e.column("total").to_pylist(), strict=True)}, key=lambda v: -v[1])
    assert all(t == int(x[0] @ x[i]) for i, t in totals)


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def grams(text):
    w = WORD.findall(lower(text or ""))
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resampling(docs, target, percent=5, least=20):
    bucket = lambda g: zlib.crc32(g.encode()) % 10000
    s, t = Counter(bucket(g) for _, x in docs for g in grams(x)[1]), Counter(bucket(g) for x in target for g in grams(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    rows = []
    for i, x in docs:
        w, g = grams(x)
        weight = sum(gain(bucket(f)) for f in g)
        h = int(sha(f"42:{'' if i is None else i}")[:8], 16)
        rows.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(w) >= least])
    drawn = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    rank = {id(r): n + 1 for n, r in enumerate(drawn[: percent * len(drawn) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


def texts(spark, rows):
    return spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "doc_id long, text string, score long, rank long").repartition(4)


@pytest.mark.parametrize("percent", [5, 37, 100])
def test_resampling(spark, corpus, prose, percent):
    rng = random.Random(9)
    docs = [*corpus.items(), (None, prose(rng, 30)), (None, prose(rng, 30)), (-5, "x" * 65 + " " + "Y" * 64 + " z" * 3), *[(500, prose(rng, 25))] * 9, *((i, prose(rng, 40)) for i in range(600, 700))]
    docs += [(700, "a1,b2;C3 é-ß \x7f日本 don't"), (701, "\x00\x01 . !")]
    target = [prose(rng, 300), None, "", "One two"]
    got = resample.resampled(texts(spark, docs), spark.createDataFrame([(x,) for x in target], "text string"), percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == resampling(docs, target, percent)


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "text string")
    assert resample.resampled(texts(spark, []), none).count() == 0
    assert [tuple(r) for r in resample.resampled(texts(spark, [(1, "a b"), (2, None)]), none).orderBy("doc_id").collect()] == resampling([(1, "a b"), (2, None)], [])


def test_kth_key(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(8) if rng.random() < 0.5 else rng.randrange(10**6), rng.choice([None, *range(40)])) for _ in range(700)] + [(3, 3)] * 200
    order = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))
    df = spark.createDataFrame(rows, "score long, doc_id long").repartition(5).cache()
    for k in (1, 2, 333, 700, 899, 900):
        assert resample.kth_key(df, k) == order[k - 1]
    assert df.where(resample.above(order[100])).count() == order.index(order[100])
    assert df.where(F.lit(True) & resample.at_key((3, 3))).count() == rows.count((3, 3))


def test_joined_checksums():
    rng = random.Random(2)
    words = [bytes(rng.randrange(256) for _ in range(n)) for n in [1, 2, 3, 63, 64, 65, 66, 200, *(rng.randrange(1, 90) for _ in range(60))]]
    one, size = np.array([zlib.crc32(w) for w in words], np.uint32), np.array([len(w) for w in words])
    got = resample.joined(one[:-1], words[1:], one[1:], size[1:])
    assert got.tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:], strict=False)]
