"""The registered queries: SQL where there is some, plain re-statements elsewhere, and the pipeline."""

import brute
import corpus_pipeline
import duckdb
import pytest

from lattix.llm import mixing, quality, queries


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_mix_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = queries.op2_pareto_mix(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = c.execute(mixing.ORACLE_SQL).df().sort_values("doc_id").reset_index(drop=True)
    assert (got[sorted(got)] == want[sorted(want)]).all().all()


def test_against_plain_versions(spark, sf, docs):
    rows = queries.op3_repeated_bytes(spark, sf).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == brute.repeats(docs)
    rows = queries.op7_near_duplicates(spark, sf).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute.near_duplicates(docs)
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in queries.op6_cosine_links(spark, sf).collect()} == brute.cosine(vectors)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_runs(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_pipeline_stages(spark, sf, docs):
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    columns = rows.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, rows = rows, stage(spark, rows, sf)
        assert rows.columns == columns, name
        a, b = {r["doc_id"]: r["text"] for r in before.collect()}, {r["doc_id"]: r["text"] for r in rows.collect()}
        assert set(b) <= set(a)
        if stage is corpus_pipeline.without_near_duplicates:
            assert set(b) == {i for i, (_, c) in brute.near_duplicates(a, 5, 80).items() if i == c}
        elif stage is corpus_pipeline.without_secrets:
            assert set(a) == set(b) and not any(brute.secrets(t) for t in b.values())
    last = corpus_pipeline.mixed(spark, rows, sf)
    assert last.count() == rows.count() and {"doc_id", "taken", "target"} <= set(last.columns)
    assert corpus_pipeline.run(spark, sf).count() == last.count()


def test_stages_on_no_rows(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, rows, sf).count() == 0


def test_quality_keeps_what_it_scores_high(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    assert kept == {r["doc_id"] for r in quality.quality_scores(docs, labels).where("predicted = 1").collect()}
