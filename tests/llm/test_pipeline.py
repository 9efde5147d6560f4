import corpus_pipeline
from retentia.llm.common import materialise
from retentia.session import configure

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark, small):
    configure(spark)
    docs = small("documents")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SMALL), "test")
        assert docs.columns == names
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[-1] > 0.5 * counts[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    run = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(tuple, run.drop("sequence_id", "offset").collect())) == sorted(map(tuple, packed.drop("sequence_id", "offset").collect()))


def test_empty_documents(spark, small):
    docs = small("documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0, name
