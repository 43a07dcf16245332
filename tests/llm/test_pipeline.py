import os

import pytest

import corpus_pipeline
from emberlog.llm import registry
from emberlog.llm.decontaminate import contamination
from emberlog.llm.exact_dedup import exact_groups
from emberlog.llm.jaccard_join import jaccard_classes
from emberlog.llm.toxicity import fit_toxicity, score_toxicity

SF = "/root/testdata/sf0.001"


def test_registry():
    names = set(registry.queries())
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11)) and "pipeline" in names
    assert set(registry.oracle_sql()) <= names


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    left = {r.doc_id for r in score_toxicity(docs, fit_toxicity(docs, labels)).collect() if r.score < 0.7}
    now = docs.filter(docs.doc_id.isin(list(left)))
    left &= {r.doc_id for r in exact_groups(now).collect() if r.kept}
    now = docs.filter(docs.doc_id.isin(list(left)))
    left &= {r.component_id for r in jaccard_classes(now, shingle=5, percent=80).collect()}
    now = docs.filter(docs.doc_id.isin(list(left)))
    left -= {r.doc_id for r in contamination(now, bench).collect() if r.contaminated}
    got = {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == left and 0 < len(got) < docs.count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_on_odd_tables(spark, docs, rows, empty):
    """Nulls in any column, repeated rows, clashing columns and an empty table go through every stage."""
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, SF)
        assert stage(spark, empty, SF).count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
            kept = spark.createDataFrame(out.collect(), docs.schema)
    assert kept.count() < len(rows) and out.count() >= kept.count()
