"""The pipeline on the smallest tables, and the queries that SQL can express."""

import pytest

import corpus_pipeline
from costlens.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    from tools.check import compare, connect
    assert compare(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLE[name]) == ""


def test_stages(spark, sf_dir):
    from costlens.llm.tables import stage, table
    docs = table(spark, sf_dir, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for name, run in corpus_pipeline.STAGES:
        docs = stage(run(spark, docs, sf_dir), name)
        if name != "packing":
            assert docs.columns == columns
            sizes.append(docs.count())
    assert sizes[1] == sizes[2] and sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    total, last = docs.selectExpr("sum(length)", "max(sequence_id)").first()
    assert last == -(-total // 2048) - 1
