import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import corpus_pipeline  # noqa: E402
from compare import canonical, connect  # noqa: E402
from voxelloom.llm import catalog, simhash  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    res = connect(SF).execute(catalog.ORACLE[name])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical([c[0] for c in res.description], res.fetchall())


def test_there_is_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))


def test_stages_pass_documents_on(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        kept = {r.doc_id for r in docs.collect()}
        assert kept <= ids and docs.count() <= before
        ids, before = kept, docs.count()
    assert len({r.component_id for r in simhash.near_duplicates(docs).collect()}) == docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == ids


def test_stages_take_odd_and_empty_tables(spark, odd, none):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
        assert stage(spark, odd, SF).count() > 0
