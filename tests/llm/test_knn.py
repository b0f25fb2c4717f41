"""Exact search against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import differences, oracle
from pilotlab.llm import knn, queries

SF = "/root/testdata/sf0.001"


def brute(rows, k):
    good = [
        (i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for i, q in good:
        if i % 5:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in good if j != i)
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def check(spark, rows, k=4):
    table = spark.createDataFrame(
        [(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, id int, score double"
    )
    found = knn.search(table.repartition(3), F.col("vec_id") % 5 == 0, k)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, k)


@pytest.fixture
def small(monkeypatch):
    for name, value in (("PIVOTS", 5), ("BLOCK_ROWS", 16), ("QUERY_ROWS", 7), ("FIRST_CELLS", 1)):
        monkeypatch.setattr(knn, name, value)


def test_clusters(spark, small):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8)) * 3
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * rng.choice([0.01, 0.5])).tolist()) for i in range(260)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]  # a large group of one vector, with ties
    check(spark, rows)


def test_odd_rows(spark, small):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (5, None), (10, [1.0, None]), (15, [nan, 0.0]), (20, [inf, 1.0]), (25, [-inf, 1.0]),
            (None, [1.0, 1.0]), (30, []), (35, [3.0]), (36, [1e6, -1e6]), (37, [0.0, 0.0]), (40, [1e6, 1e6, 1e6])]
    check(spark, rows)
    check(spark, [(0, [1.0])])
    check(spark, [(0, None)])
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert knn.search(empty, F.col("vec_id") % 5 == 0).collect() == []


def test_repeated_rows(spark, small):
    table = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    found = knn.search(table, F.col("vec_id") == 0, 2)
    assert sorted(tuple(r) for r in found.collect()) == sorted([(0, 1, 1, 2**21), (0, 2, 1, 2**21)] * 2)


def test_query(spark):
    query, sql = queries.QUERIES["op7_voronoi_topk"]
    assert differences(query(spark, SF).toPandas(), oracle(sql, SF)) is None
