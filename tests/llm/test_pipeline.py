import numpy as np

import corpus_pipeline
from papersift.llm import decontaminate, near_dup, packing
from tests.conftest import SF_SMALL
from tests.llm.helpers import documents
from tests.llm.test_near_dup import brute
from tests.llm.test_rules_licenses_leaks import brute_measures


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        path = near_dup.stored(stage(spark, docs, SF_SMALL), "test-stage")
        docs = path
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and after.items() <= before.items()
        if name == "quality_rules":
            base = {i for i, t in before.items() if (m := brute_measures(t))[0] < 20 or 100 * m[4] > 30 * m[0]}
            assert not base & set(after)
        if name == "near_duplicates":
            assert set(after) == {i for i, c in brute(list(before.items()), corpus_pipeline.NEAR_PERCENT).items() if i == c}
        left = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).collect()
    assert {p.doc_id for p in pieces} == set(left)
    ran = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert {(p.doc_id, p.start, p.ids_crc32) for p in ran if p.length == p.doc_tokens} <= {(p.doc_id, 0, p.ids_crc32) for p in ran}
    assert sum(p.length for p in ran) == sum(p.length for p in pieces) and max(p.offset + p.length for p in ran) <= packing.CAPACITY


def test_decontamination_is_fitted_on_every_document(spark, tmp_dir, monkeypatch):
    """Each passage adds 1 to the trace of the products that the stage's latent space is made from."""
    words, traces, fit = "ant bee cat dog elk".split(), [], decontaminate.Model.fit

    def watched(model, products):
        traces.append(float(np.trace(products)))
        fit(model, products)

    monkeypatch.setattr(decontaminate.Model, "fit", watched)
    spark.createDataFrame([(1, " ".join(words), None)], "item_id long, text string, doc_id long").write.parquet(f"{tmp_dir}/benchmark.parquet")
    docs = documents(spark, [(k, f"{words[k % 5]} text {k}") for k in range(5000)])
    assert corpus_pipeline.decontamination(spark, docs, tmp_dir).count() == 5000
    assert traces == [5000]
