import corpus_pipeline
from prismatic.llm.queries import QUERIES

from .plain import empty_documents, hard_documents


def test_stages_chain_and_keep_columns(spark, data, tmp_path):
    _, docs = hard_documents(spark)
    for (name, stage), k in zip(corpus_pipeline.STAGES, range(9), strict=False):
        out = stage(spark, docs, data)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.schema.names == docs.schema.names, name
            assert 0 < out.count() <= docs.count()
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert set(docs.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


def test_no_documents(spark, data):
    docs = empty_documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() == 0


def test_every_operator_has_one_query():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}
