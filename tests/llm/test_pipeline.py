import os

import pytest

import corpus_pipeline
from tests.llm.fixtures import CLASHING, SCHEMA, clashing, odd_documents

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rows, schema", [(clashing(odd_documents()), CLASHING), ([], SCHEMA)])
def test_every_stage_on_odd_and_empty_tables(spark, tmp_path, rows, schema):
    docs = spark.createDataFrame(rows, schema).repartition(3)
    ids, left = set(), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(n)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(n)))
        if n < 4:
            assert docs.dtypes == before.dtypes
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        left.append(docs.count())
    if rows:
        assert left[0] == sum(any(c.isalpha() for c in r[1] or "") for r in rows)
        twice = spark.read.parquet(str(tmp_path / "1")).where(r"text rlike '\\S'").groupBy("doc_id", "text").count().where("count > 1")
        assert twice.count() == 0
        assert left[1] < left[0] and left[2] == left[1]


def test_the_whole_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "sample", "round_trip"} <= set(out.columns)
    assert out.where("not round_trip").count() == 0
    assert os.path.exists(SF)


def test_the_pipelines_end_product_can_be_read(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.default_model())
    docs = spark.createDataFrame([(1, "A text to be read again.", "en", "s", 24), (2, "", "en", "s", 0)], SCHEMA)
    assert {(r.doc_id, sp.decode(r.ids)) for r in corpus_pipeline.encode(spark, docs, SF).collect()} == {(1, "A text to be read again."), (2, "")}
