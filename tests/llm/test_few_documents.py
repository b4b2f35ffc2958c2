import pytest

from veraframe.llm import sharding


@pytest.mark.parametrize("sizes", [[], [5], [0, 10], [1, 1, 5000]])
def test_fewer_documents_than_shards_all_come_out(spark, sizes):
    docs = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(sizes)], "doc_id long, text string")
    assert sorted(r.doc_id for r in sharding.ring_shards(docs, 4).collect()) == list(range(len(sizes)))
