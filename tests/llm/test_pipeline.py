"""The pipeline's stages on the smallest tables."""

import re

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline
    from shelfmark.llm.common import table, written

    docs = table(spark, SF, "documents")
    columns = docs.columns
    seen = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF))
        assert docs.columns == columns, name
        rows = {r.doc_id: r for r in docs.collect()}
        assert len(rows) == docs.count() and rows.keys() <= seen.keys()
        assert all(r.n_chars == len(r.text) for r in rows.values() if r.text is not None)
        if name in ("toxicity", "ngram_jaccard_join"):
            assert all(rows[i].text == seen[i] for i in rows) and len(rows) < len(seen)
        else:
            assert len(rows) == len(seen)
        seen = {i: r.text for i, r in rows.items()}
    assert not any(re.search("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", t) for t in seen.values())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(pieces.doc_id) == set(seen) and (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()


def test_run(spark):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, SF).count() > 100 and 4 <= len(corpus_pipeline.STAGES) <= 5
