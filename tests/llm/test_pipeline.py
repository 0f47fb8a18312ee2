"""The pipeline: every stage on its own input, and the whole."""

import corpus_pipeline
import pytest

from tidemark.llm import decontaminate, langid, pieces, simhash, toxicity
from tidemark.llm.queries import QUERIES


def test_stages_are_their_operators(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    by = dict(corpus_pipeline.STAGES)
    assert list(by) == ["toxicity", "language", "near_duplicates", "decontamination", "sentencepiece"]
    for name in list(by)[:-1]:
        assert by[name](spark, docs, sf).columns == docs.columns
    assert ids(by["toxicity"](spark, docs, sf)) == sorted(r.doc_id for r in toxicity.toxicity(docs, labels).collect() if not r.predicted)
    assert ids(by["language"](spark, docs, sf)) == sorted(r.doc_id for r in langid.identify(docs).collect() if r.lang_pred != "und" and r.score >= langid.LEAST_SCORE)
    assert ids(by["near_duplicates"](spark, docs, sf)) == sorted({r.component_id for r in simhash.near_duplicates(docs).collect()})
    assert ids(by["decontamination"](spark, docs, sf)) == sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect() if not r.contaminated)


def test_run_is_the_stages_in_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    want = {r.doc_id: r.text for r in docs.collect()}
    rows = corpus_pipeline.run(spark, sf).collect()
    model = pieces.Pieces(pieces.vocabulary_path())
    assert {r.doc_id: r.ids for r in rows} == {i: model.encode(t) for i, t in want.items()} and 0 < len(rows) < 200


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_and_empty_tables(spark, sf, odd_docs, no_docs, name, stage):
    out = stage(spark, odd_docs, sf)
    assert out.count() <= 11 and ("doc_id" in out.columns)
    assert stage(spark, no_docs, sf).count() == 0


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
