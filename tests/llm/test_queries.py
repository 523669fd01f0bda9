import os

import duckdb
import pytest

import corpus_pipeline
from gridloom.llm import exact_dedup, quality, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"create view {t[:-8]} as select * from read_parquet('{SF}/{t}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, oracle, name):
    found = queries.QUERIES[name](spark, SF)
    want = oracle.sql(queries.ORACLES[name])
    names = sorted(found.columns)
    assert names == sorted(want.columns)
    rows = sorted(str([r[c] for c in names]) for r in found.collect())
    assert rows == sorted(str([dict(zip(want.columns, r))[c] for c in names]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_row_per_document(spark, name):
    found = queries.QUERIES[name](spark, SF)
    source = "pages" if name.startswith("op10") else "documents"
    key = "page_id" if source == "pages" else "doc_id"
    assert found.select(key).distinct().count() == spark.read.parquet(f"{SF}/{source}.parquet").count()


def test_pipeline_stages(spark):
    """Each stage against what its operator decides on the stage's own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "mixing", "best_fit_packing"]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = (docs, docs := stage(spark, docs, SF).cache())
    before, after = out["quality_classifier"]
    keep = {r.id for r in quality.classify(before, labels).where("keep").collect()}
    assert {r.doc_id for r in after.collect()} == keep
    before, after = out["exact_dedup"]
    assert after.count() == exact_dedup.exact_duplicates(before).select("sha256").distinct().count()
    before, after = out["simhash_near_dedup"]
    sets = {r.doc_id: set(zip(*[r.text.encode().lower().split()[k:] for k in range(5)])) for r in before.collect()}
    ids = sorted(sets)
    group = {i: i for i in ids}
    for i in ids:
        for j in ids[: ids.index(i)]:
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert {r.doc_id for r in after.collect()} == set(group.values())
    before, after = out["mixing"]
    assert set(after.columns) == set(before.columns) and after.subtract(before).count() == 0
    before, after = out["best_fit_packing"]
    assert after.where("piece = 0").count() == before.count()
