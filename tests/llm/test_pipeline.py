"""The pipeline's stages against what each is for."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sitewright.llm.surrogates import entities

from .conftest import ODD
from .test_texts import shingles

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are absent")
def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.staged(stage(spark, docs, SMALL), name)
        assert docs.columns == columns
        seen[name] = (before.collect(), docs.collect())
    before, after = seen["quality_network"]
    kept = {r.doc_id for r in after}
    good = [r for r in before if labels.get(r.doc_id) == 1]
    assert sum(r.doc_id in kept for r in good) >= 0.97 * len(good)
    before, after = seen["language_centroids"]
    assert len(after) >= 0.97 * len(before)
    before, after = seen["near_duplicates"]
    sets = [shingles(r.text) for r in after]
    for i in range(len(sets)):
        for j in range(i):
            assert not sets[i] or 5 * len(sets[i] & sets[j]) < 4 * len(sets[i] | sets[j])
    whole = [shingles(r.text) for r in before]
    for own in whole:  # nothing goes without a chain of near duplicates to what stays
        assert not own or any(5 * len(own & s) >= 4 * len(own | s) for s in sets) or sum(5 * len(own & s) >= 4 * len(own | s) for s in whole) > 1
    before, after = seen["personal_data"]
    new = {r.doc_id: r for r in after}
    assert len(after) == len(before)
    for r in before:
        found = entities(r.text)
        assert new[r.doc_id].n_chars == len(new[r.doc_id].text)
        assert (new[r.doc_id].text == r.text) == (not found)
        assert not {r.text[s:e] for s, e, _, _ in found} & {new[r.doc_id].text[s:e] for s, e, _, _ in entities(new[r.doc_id].text)}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    totals = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {r.doc_id for r in totals} == set(new) and all(r.n == r["all"] for r in totals)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are absent")
def test_odd_rows_and_no_rows(spark, make_docs):
    for docs in (make_docs(ODD * 2, langs=([None] + ["en"] * (len(ODD) - 1)) * 2), make_docs([])):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.staged(stage(spark, docs, SMALL), name)
        corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
