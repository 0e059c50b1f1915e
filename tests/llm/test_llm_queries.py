import pytest
from compare import duck, duck_rows, spark_rows

import __spark_entry__ as entry
import corpus_pipeline
from curbwait.llm import oracle, queries
from curbwait.session import written

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", oracle.ALL)
def test_query_agrees_with_sql(spark, name):
    columns, found = spark_rows(entry.queries()[name](spark, FOLDER))
    wanted_columns, wanted = duck_rows(duck(FOLDER), oracle.ALL[name])
    assert columns == wanted_columns
    assert len(found) == len(wanted) > 0
    assert found == wanted


def test_every_operator_is_registered():
    names = [q.__name__ for q in queries.ALL]
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)]
    assert {*names, "pipeline"} <= set(entry.queries())


def test_stages_keep_the_columns_of_documents(spark):
    source = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs, before = source, source.count()
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = written(stage(spark, docs, FOLDER), "stage")
        if name != "packing":
            assert docs.columns == source.columns
            assert 0 < docs.count() <= before
            before = docs.count()
    assert docs.agg({"doc_tokens": "count"}).first()[0] >= before
    run = corpus_pipeline.run(spark, FOLDER)
    assert sorted(run.columns) == sorted(docs.columns)
    assert run.exceptAll(docs).count() == 0
