"""Values far beyond the usual: large vector components, counts beyond 24 and 32 bits."""

import math

import numpy as np
import pytest

from stagefork.llm import ann, lm_score as M


def far(a, b):
    return math.hypot(*(x - y for x, y in zip(a, b, strict=True)))


def test_nearest_beside_large_vectors(spark):
    """3,000 vectors of which some are beyond single, some near the end of double precision; a large one asks, too."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 16)).tolist()
    for i, size in ((7, 1e20), (200, 1e20), (8, 1e300), (300, -1e300), (9, 1e-300)):
        x[i] = (np.array(x[i]) * 0 + size).tolist()
    made = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    got = ann.nearest(made).collect()
    assert len(got) == 300 and {r["rank"] for r in got} == set(range(1, 11))
    hits = []
    for q in range(0, 3000, 100):
        want = sorted((far(x[q], y), i) for i, y in enumerate(x) if i != q)[:10]
        found = {r["vec_id"]: r["score"] for r in got if r["query_id"] == q}
        assert all(s == pytest.approx(far(x[q], x[i]), rel=1e-12) for i, s in found.items())
        hits.append(len(found.keys() & {i for _, i in want}))
    assert np.mean(hits) >= 9
    assert {r["vec_id"] for r in got if r["query_id"] == 300} == {i for _, i in sorted((far(x[300], y), i) for i, y in enumerate(x) if i != 300)[:10]}


def test_distances_that_overflow():
    x, q = np.array([[1e200, 0.0], [3.0, 4.0], [1.7e308, 0.0]]), np.zeros(2)
    assert ann.distances(x, q).tolist() == [pytest.approx(1e200), 5.0, pytest.approx(1.7e308)]
    assert ann.distances(np.array([[1.7e308]]), np.array([-1.7e308])).tolist() == [math.inf]


def test_counts_beyond_24_and_32_bits():
    for top in (0, 1 << 24, (1 << 24) + 1, (1 << 32) - 1, 1 << 32, 1 << 52):
        assert M.from_bytes(M.to_bytes(np.array([1, top]))).tolist() == [1, top]
    assert M.from_bytes(M.to_bytes(np.zeros(0, np.int64))).tolist() == []


def test_restaurants_with_millions_of_customers(spark):
    """Twenty million customers and a thousand more, from several tasks."""
    rows = [("most", [1], [20_000_000]), ("more", [1, 2], [5 << 30, 3])] + [(f"w{i}", [1], [1]) for i in range(1000)]
    corpus = M.totals(spark.createDataFrame(rows, "word string, ctx array<int>, c array<long>").repartition(3), {})
    assert corpus.customers[1] == 20_001_000 + (5 << 30) and corpus.customers[2] == 3 and corpus.customers.sum() == corpus.n
    assert all(1002 <= s.tables[1] <= corpus.customers[1] and s.tables[1] == int(s.tables[1]) for s in corpus.sweeps)
