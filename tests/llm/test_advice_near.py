"""Near duplicates where ids are null or repeated."""

from veraframe.llm import jaccard_join


def test_ids_are_no_components(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcde")
    rows = [(None, a), (None, a + " end"), (None, b), (7, c), (7, d), (7, d + " end"), (8, e), (None, e + " end"), (None, ""), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted((r.doc_id or 0, (r.text or "")[:2]) for r in jaccard_join.drop_near_copies(docs).collect())
    assert kept == [(0, ""), (0, "a0"), (0, "b0"), (7, ""), (7, "c0"), (7, "d0"), (8, "e0")]
