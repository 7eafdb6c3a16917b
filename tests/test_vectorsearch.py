"""Many-query search against brute force."""

import random

from mnemolake.operators import vectorsearch


def test_more_queries_than_a_block(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-0.5, 0.5) for _ in range(4)]) for i in range(1030)]
    vectors = spark.createDataFrame(rows, "id long, vector array<float>")
    few = spark.createDataFrame(rows[:40], "id long, vector array<float>")
    got = vectorsearch.top_k_many(few, vectors.selectExpr("id AS query_id", "vector AS query"), 3).collect()
    want = {(q, i, n + 1) for q, v in rows for n, (_, i) in enumerate(sorted((-round(max(-1.0, min(1.0, sum(a * b for a, b in zip(v, w)))), 6), i) for i, w in rows[:40])[:3])}
    assert len(got) == 3 * len(rows) and len({(r.query_id, r.id, r.rank) for r in got} & want) > 0.999 * len(want)


def test_odd_vectors_ties_and_long_ones(spark, monkeypatch):
    """Against every pair one by one: equal vectors, products out of range, nulls, other lengths and numbers that are not finite."""
    rng = random.Random(3)
    some = [[rng.uniform(-0.6, 0.6) for _ in range(4)] for _ in range(60)]
    rows = [(i, some[rng.randrange(60)]) for i in range(300)] + [(400 + i, [3.0 * x for x in some[i]]) for i in range(8)]
    odd = [(500, None), (501, [1.0]), (502, [0.1, None, 0.2, 0.3]), (503, [float("nan")] * 4), (504, [float("inf"), 0.0, 0.0, 0.0]), (505, [])]
    monkeypatch.setattr(vectorsearch, "CHUNK", 16)
    monkeypatch.setattr(vectorsearch, "QUERY_BLOCK", 40)
    frame = lambda rows: spark.createDataFrame(rows, "id long, vector array<float>")
    both = lambda rows, more: (frame(rows), frame(more).selectExpr("id AS query_id", "vector AS query"))
    listed = lambda df: sorted((r.query_id, r.rank, r.id, None if r.score is None else str(r.score)) for r in df.collect())
    for left, right in ((rows + odd, rows[:50] + rows[-3:] + odd), (rows[:3], rows[:9]), (rows, odd[:1]), (rows, rows[:0]), (rows[:0], rows[:2])):
        a, b = both(left, right)
        assert listed(vectorsearch.top_k_many(a, b, 5)) == listed(vectorsearch._ranked(vectorsearch._one_by_one(a, b), 5))

    def fails(*_):
        raise AssertionError("a pair by itself")

    monkeypatch.setattr(vectorsearch.V, "dot", fails)
    assert vectorsearch.top_k_many(*both(rows, rows[:50]), 5).count() == 250
