"""Cases that earlier versions lost: articles in odd classes, short benchmark items, texts of the pipeline."""

import hashlib
import random
import time

import brute
import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from lattix.llm import decontam, html, minhash, mixing, secrets, windows

LONG = "A long paragraph of the article, with commas, and more words than that; it goes on and on, and on, for some time. "


@pytest.mark.parametrize("name", ["social-sciences", "menu-of-the-day", "related-quote", "has-sidebar", "loginless"])
def test_classes_that_only_hold_a_word(name):
    page = f"<body><article><p>{LONG * 3}</p><div class='{name}'><p>{LONG * 2}</p></div><p>{LONG}</p></article></body>"
    assert html.main_text(page) == (LONG * 6).strip()


def test_an_element_with_most_of_the_text_stays():
    for name in ("has-sidebar", "sidebar", "ad"):
        got = html.main_text(f"<body><div class='{name}'><p>{LONG * 3}</p></div><div class='copyright'>Copyright 2024 by us.</div></body>")
        assert got.startswith((LONG * 3).strip())
    got = html.main_text(f"<body><div><p>{LONG * 5}</p></div><div class='ad-box-2'><p>{LONG}</p></div><ul class='comment-list'><li>{LONG}</li></ul></body>")
    assert got == (LONG * 5).strip()
    assert html.main_text(f"<body><div class=ad>{LONG}</div><article><p>Short.</p></article></body>") == "Short."


def test_broken_markup_does_not_leak():
    got = html.main_text(f"<body><p><a href='x>A long sentence</a> {LONG}</p></body>")
    assert got == f"A long sentence {LONG}".strip()
    assert html.main_text("<body><p>1 < 2 and 3 <4</p></body>") == "1 < 2 and 3 <4"
    assert html.main_text("<p>one</p><a href='") == "one"
    deep = "<div>" * 3000 + f"<p>{LONG}</p>" + "</div>" * 3000
    assert html.main_text(deep) == LONG.strip()


def overlap(text, item, window=13, share=0.8):
    """Whether any way to lay the item on the text has enough equal words in a window."""
    w = min(window, len(item))
    for shift in range(w - len(item), len(text) - w + 1) if w else ():
        lo, hi = max(0, -shift), min(len(item), len(text) - shift)
        same = [text[shift + k] == item[k] for k in range(lo, hi)]
        if any(sum(same[k : k + w]) >= share * w - 1e-9 for k in range(len(same) - w + 1)):
            return True
    return False


@pytest.mark.parametrize("most", [10**6, 1])
def test_short_items_against_brute_force(spark, most):
    """Items of 1 to 12 words with as many substitutions as they may have: all found, on both paths, and nothing else."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    items = {n * 10 + k: [rng.choice(vocabulary) for _ in range(n)] for n in range(1, 13) for k in range(3)}
    items |= {900: [], 901: ["same"] * 8}
    texts = {}
    for i, own in items.items():
        for k in range(3):
            w = list(own)
            for p in rng.sample(range(len(w)), min(len(w), int(0.2 * len(w) + 1e-9) + (k == 2))):
                w[p] = "zzz"
            texts[len(texts)] = [rng.choice(vocabulary) for _ in range(20)] + w + [rng.choice(vocabulary) for _ in range(20)]
    want = {(d, i) for d, t in texts.items() for i, own in items.items() if overlap(t, own)}
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string").repartition(4)
    test = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()] + [(None, "w1 w2"), (950, None)], "item_id long, text string")
    rows = decontam.contaminated(docs, test, most=most).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len(rows) == len(want)
    kept = {r["doc_id"] for r in decontam.drop_contaminated(docs, test, most=most).collect()}
    assert kept == set(texts) - {d for d, _ in want}


def test_columns_of_any_names_come_back(spark):
    rows = [(1, "a b c d e f", 7, 8, 9), (2, "a b c d e f", 7, 8, 9), (3, "g h", 1, 2, 3), (None, None, 4, 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _k1 int, _k2 int, row int")
    assert sorted(map(str, minhash.drop_near_duplicates(df).collect())) == sorted(map(str, df.where("doc_id is null or doc_id <> 2").collect()))
    test = spark.createDataFrame([(1, "q r s t u v w x y")], "item_id long, text string")
    for most in (10**6, 1):
        assert sorted(map(str, decontam.drop_contaminated(df, test, most=most).collect())) == sorted(map(str, df.collect()))


def test_mix_with_texts(spark, documents):
    odd = documents.union(documents.where("doc_id < 5")).union(documents.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long")))
    got = mixing.with_mix(odd)
    assert got.columns == [*(c for c in odd.columns if c != "size"), *mixing.MIXED]
    plain = sorted(map(tuple, mixing.pareto_mix(odd).select("doc_id", *mixing.MIXED).collect()), key=str)
    assert sorted(map(tuple, got.select("doc_id", *mixing.MIXED).collect()), key=str) == plain
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got.collect()) == sorted((str(r["doc_id"]), r["text"] or "") for r in odd.collect())
    assert mixing.with_mix(odd.limit(0)).count() == 0


def test_pipeline_returns_the_corpus(spark, sf, monkeypatch):
    before = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {"doc_id", "text", "lang", "source", "n_chars", "copies", "taken"} <= set(rows[0].asDict())
    changed = [r for r in rows if r["text"] != before[r["doc_id"]]]
    assert changed and all("[secret]" in r["text"] and r["n_chars"] == len(r["text"]) for r in changed)
    # a stage that fails leaves no folder
    folder = spark.sparkContext.getCheckpointDir()
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    names = lambda: {s.getPath().getName() for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(folder)) if "pipeline-" in s.getPath().getName()}

    def fails(*_):
        raise RuntimeError("no")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [corpus_pipeline.STAGES[0], ("fails", fails), ("mixing", corpus_pipeline.mixed)])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, sf)
    assert not names()


def test_secrets_of_long_texts_take_time_in_proportion(spark):
    """A text of many digests among others; the fit and the scan pass over it a few times, not once for each digest."""
    digests = " é\n".join(hashlib.sha256(str(k).encode()).hexdigest() for k in range(15_000))  # 1 MB
    rows = [(0, digests)] + [(i, f"api_key = {hashlib.md5(str(i).encode()).hexdigest()} and some more words") for i in range(1, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    began = time.perf_counter()
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(df).collect()}
    assert time.perf_counter() - began < 60
    assert [(x["start"], x["end"]) for x in got[0] if x["kind"] == "hex"] == [(67 * k, 67 * k + 64) for k in range(15_000)]


def test_places_and_neighbours_of_secrets():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("aé☃𝄞 ") for _ in range(rng.randrange(1, 60)))
        spans = [tuple(sorted(rng.sample(range(len(text) + 1), 2))) if len(text) > 1 else (0, 1) for _ in range(rng.randrange(4))]
        assert secrets._byte_places(text, spans) == [(len(text[:s].encode()), len(text[:e].encode())) for s, e in spans]
        raw = text.encode()
        chars = secrets._char_places(raw)
        assert all(chars[len(text[:k].encode())] == k for k in range(len(text) + 1))
        starts = np.array(sorted(rng.sample(range(300), 40)))
        ends = starts + 3
        near = sorted(range(40), key=lambda k: min((max(0, s - ends[k], starts[k] - e) for s, e in spans), default=0))[:9]  # noqa: B023
        assert secrets._nearest(starts, ends, spans, 9).tolist() == sorted(near)
        found = sorted((s, 0, e) for s, e in spans)
        added = [(a, 3, a + 4) for a in range(0, 60, 5)]
        assert secrets._untouched(added, found) == [a for a in added if not any(s < a[2] and e > a[0] for s, _, e in found)]


def test_toxic_features_are_counted_in_slices(spark):
    """The features that get a weight, their order and ratios are those of counts over all texts; one task gets no more than these."""
    import numpy as np
    import pyarrow as pa

    from lattix.llm import toxicity

    rng = np.random.default_rng(4)
    held = [np.unique(np.append(rng.integers(0, 1 << toxicity.BITS, 50), rng.integers(0, 40, 12))).astype(np.uint32) for _ in range(300)]
    y = [int((x < 20).sum() > (x < 40).sum() / 2) for x in held]
    packed = [bytearray(pa.compress(np.diff(x, prepend=np.uint32(0)).tobytes(), codec="zstd", asbytes=True)) for x in held]
    df = spark.createDataFrame([(k, len(x), f) for k, x, f in zip(y, held, packed, strict=True)], "y int, n int, f binary").repartition(3)
    at, r = toxicity.clear(df, sum(y), 300 - sum(y), 25, 1.0)
    p, q = (np.bincount(np.concatenate([x for x, k in zip(held, y, strict=True) if k == c]), minlength=1 << toxicity.BITS) for c in (1, 0))
    want = toxicity.ratios(p, q, sum(y), 300 - sum(y))
    order = np.argsort(-np.abs(want) * np.sqrt(p + q), kind="stable")[:25]
    assert at.tolist() == order.tolist() and r.tolist() == want[order].tolist()


def passage_links(held):
    """Pairs of passages that have 50 words or more alike at the same place, by trying all."""
    tokens = np.array([[hash(tuple(w[i : i + 5])) for i in range(len(w) - 4)] for w in held])
    out = []
    for i, own in enumerate(tokens):
        same = np.concatenate((np.zeros((len(tokens), 1), int), np.cumsum(tokens == own, 1)), 1)
        alike = np.zeros(len(tokens), bool)
        for size in range(46, len(own) + 1):
            both = same[:, size:] - same[:, :-size]
            alike |= (both >= 0.8 * (2 * size - both)).any(1)
        out += [(i, j) for j in np.flatnonzero(alike).tolist() if j < i]
    return out


@pytest.mark.parametrize("block", [30, 1000])
def test_passages_of_long_lists_are_connected(spark, prose, monkeypatch, block):
    """Near copies with two or three edits, all in lists too long for their pairs: what is alike is connected by rows."""
    monkeypatch.setattr(windows, "BLOCK", block)
    rng = random.Random(5)
    base, texts, held = prose(rng, 70).split(), [], []
    for _ in range(150):
        w = list(base)
        for k in rng.sample(range(70), rng.choice((2, 3))):
            w[k] = f"new{rng.randrange(10**6)}"
        texts.append(f"{prose(rng, rng.randrange(20, 51))} {' '.join(w)} {prose(rng, rng.randrange(20, 51))}")
        held.append(w)
    rows = windows.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r["similarity"] >= 0.8 for r in rows)
    top = list(range(len(texts)))

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for r in rows:
        top[root(r["doc_id"])] = root(r["other_id"])
    links = passage_links(held)
    lost = [(i, j) for i, j in links if root(i) != root(j)]
    assert len(links) > 500 and not lost, (len(links), len(lost))


def test_surroundings_of_repeated_words_are_compared_as_sets(monkeypatch):
    """A run of one word is one shingle: texts that share it alone are not verified. Others are connected as trying all pairs has it."""
    rng, t = np.random.default_rng(3), 46
    verify, calls = windows.passages, []
    monkeypatch.setattr(windows, "passages", lambda *x: calls.append(1) or verify(*x))

    def links(words, at, ids):
        tokens = windows._shingled([np.array(w, np.uint32).tobytes() for w in words])
        ones, ids = np.ones(len(at), int), np.array(ids)
        return tokens, windows.block_links(ids, ids, np.array(at), ones, 0 * ones, tokens, True, t, 0.8)

    runs = [[k] * 25 + [1] * 45 + [k + 1] * 25 for k in range(10, 130, 2)]
    assert links(runs, [47] * 60, range(60))[1] == [] and not calls
    words, at = [], []
    for _ in range(70):  # runs and repeated lines, edited
        line = [rng.permutation(np.arange(2, 2 + n)) for n in (9, 23)][rng.integers(2)] if rng.random() < 0.2 else np.arange(2, 2 + 11 * rng.integers(1, 4))
        w = np.concatenate((rng.integers(100, 1 << 30, rng.integers(0, 30)), np.repeat(1, rng.integers(0, 30)), np.tile(line, 9)))[:99]
        w[rng.integers(0, len(w), rng.integers(0, 3))] = rng.integers(100, 1 << 30)
        words.append(w)
        at.append(int(rng.integers(20, min(60, len(w) - 5))))
    ids = rng.integers(0, 30, 70)
    tokens, got = links(words, at, ids)
    top = list(range(70))
    for i, j in got:
        assert ids[i] != ids[j]
        top = [top[j] if x == top[i] else x for x in top]
    want = [(i, j) for i in range(70) for j in range(70) if ids[i] != ids[j] and any(s <= at[i] < e and u <= at[j] < v for s, e, u, v, _ in verify(tokens[i], windows.Side(tokens[j]), t, 0.8))]
    assert len(want) > 100 and all(top[i] == top[j] for i, j in want)
    assert all(x in want for x in got)


def test_redaction_takes_one_python_worker_of_a_task(spark, documents):
    """Scanning and cutting in two functions held two workers, with the text in both."""
    plan = secrets.redact(documents)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_a_line_that_is_too_short_is_not_verified(monkeypatch):
    """Texts that share a line of 49 words alone: all pairs of a list were verified, though no stretch of 50 words lies between shared ones."""
    rng, t = np.random.default_rng(4), 46
    verify, calls = windows.passages, []
    monkeypatch.setattr(windows, "passages", lambda *x: calls.append(1) or verify(*x))
    line = rng.integers(0, 1 << 30, 49)
    words = [np.concatenate((rng.integers(0, 1 << 30, 25), line, rng.integers(0, 1 << 30, 25))) for _ in range(60)]
    words.append(np.append(words[7][:76], rng.integers(0, 1 << 30, 20)))
    tokens = windows._shingled([np.array(w, np.uint32).tobytes() for w in words])
    ids, ones, given = np.arange(61), np.ones(61, int), []
    got = windows.block_links(ids, ids, np.full(61, 47), ones, 0 * ones, tokens, True, t, 0.8, given)
    assert got == [(7, 60)] and len(calls) == 1
    (s, e, u, v, alike) = given[0]
    assert (s, e, u, v) == verify(tokens[7], windows.Side(tokens[60]), t, 0.8)[0][:4] and s <= 47 < e and alike >= 0.8


def test_stretches_between_true_places():
    rng = np.random.default_rng(9)
    seen = set()
    for _ in range(500):
        same = rng.random(rng.integers(1, 40)) < rng.choice((0.5, 0.8, 0.95))
        same[rng.integers(0, len(same))] = True
        at = np.flatnonzero(same)
        want = any(same[x:y].mean() >= 0.8 - 1e-9 for x in range(at[0], at[-1] + 1) for y in range(x + 10, at[-1] + 2))
        assert windows.stretched(same, 10, 0.8) == want
        seen.add(want)
    assert len(seen) == 2


def test_keys_of_one_row_are_dropped_across_batches(spark):
    rng = np.random.default_rng(2)
    keys = [*range(3000), *rng.integers(0, 600, 3000).tolist(), *[5000] * 70]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = windows.in_lists(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key long, doc_id long")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sorted(map(tuple, got)) == sorted((k, i) for i, k in enumerate(keys) if keys.count(k) > 1)


def test_links_of_long_lists_that_the_hull_hides(spark, monkeypatch):
    """Runs of words: the link shows around the place, while the hull of both texts has the runs of one too far off."""
    monkeypatch.setattr(windows, "FEW", 1)
    run = lambda *x: " ".join(" ".join([w] * n) for w, n in x)
    other = lambda p: [(f"{p}{k}", 24) for k in range(4)]
    docs = [run(*other("p"), ("b", 24), *other("q"), ("c", 24), *other("r")), run(*((w, 42) for w in ("x", "y", "b", "c", "z"))), run(*other("e"), ("b", 24), ("c", 24), *other("h"))]
    out = windows.repeated_passages(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["other_id"]) for r in out} == {(1, 2), (2, 1)}
    for r in out:
        a, b = (brute.shingles(" ".join(docs[r[k]].split()[r[s] : r[s] + r[n]]), 5) for k, s, n in (("doc_id", "start", "words"), ("other_id", "other_start", "other_words")))
        assert len(a & b) / len(a | b) == pytest.approx(r["similarity"]) and r["similarity"] >= 0.8
