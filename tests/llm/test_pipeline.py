from collections import Counter

import corpus_pipeline as P
from filmloom.llm import common


def test_stages_keep_columns_and_take_effect(spark, data, odd_documents):
    assert [name for name, _ in P.STAGES] == ["quality rules", "simhash near-dedup", "suffix-array dedup", "mixing", "packing"]
    for docs in (common.table(spark, data, "documents"), odd_documents):
        columns, counts = docs.columns, [docs.count()]
        for _, stage in P.STAGES[:-1]:
            docs = common.cut(stage(spark, docs, data))
            assert docs.columns == columns
            counts.append(docs.count())
        assert counts[0] > counts[1] >= counts[2] == counts[3]
        packed = P.STAGES[-1][1](spark, docs, data).collect()
        assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in docs.collect())


def test_run_equals_its_stages(spark, data):
    docs = common.table(spark, data, "documents")
    for _, stage in P.STAGES:
        docs = common.cut(stage(spark, docs, data))
    # rows lie in files as shuffles leave them, so which batch and slot a sequence gets may differ
    what = lambda df: Counter((r.doc_id, r.piece, r.n_tokens, r.bucket, r.padding, tuple(r.ids)) for r in df.collect())
    where = lambda df: Counter((r.bucket, r.batch, r.slot) for r in df.collect())
    whole = common.cut(P.run(spark, data))
    assert what(whole) == what(docs) and where(whole) == where(docs)


def test_everything_works_on_an_empty_table(spark, data, no_documents):
    docs = no_documents
    for _, stage in P.STAGES:
        docs = common.cut(stage(spark, docs, data))
    assert docs.count() == 0
