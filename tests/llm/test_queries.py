import pytest

import corpus_pipeline
from snapforge.llm.queries import QUERIES, SQL
from tests.compare import same

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    same(QUERIES[name](spark, DATA), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_small_tables(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        sizes.append(docs.count())
        assert i == 4 or docs.columns == columns
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] < sizes[4] <= sizes[5]
