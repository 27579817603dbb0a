import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import varloom.llm.knn_join as knn


def slow(rows, k=5):
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in sorted({i: min((v for j, v in ok if j == i), key=lambda v: np.array(v, float).tobytes()) for i, _ in ok if i % 50 == 0}.items()):
        best = sorted((-sum(x * y for x, y in zip(a, c, strict=False)), i) for i, c in ok if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("block", [16_384, 7])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(knn, "BLOCK", block)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(i % 3, 0.3) for _ in range(6)]) for i in range(260)]
    rows += [(i, [0.5] * 6) for i in range(300, 340)]  # ties, and a hot point
    rows += [(400, None), (450, [None] * 6), (500, [float("nan")] + [1.0] * 5), (550, [float("inf")] * 6), (None, [1.0] * 6), (600, [1.0, 2.0]), (0, rows[0][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = sorted(map(tuple, knn.knn_join(df, F.col("vec_id") % 50 == 0).collect()))
    assert got == slow(rows)


def test_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<double>"
    assert knn.knn_join(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0
    assert knn.knn_join(spark.createDataFrame([(0, [1.0])], schema), F.col("vec_id") % 50 == 0).count() == 0
    assert [tuple(r) for r in knn.knn_join(spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema), F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 512)]


def test_large_components_stay_exact():
    q, c = np.array([[2.0**40 + 1, 3.0]]), np.array([[2.0**20 + 1, 5.0]])
    assert knn.exact_scores(q, c)[0, 0] == (2**40 + 1) * (2**20 + 1) + 15
    assert knn.exact_scores(np.array([[1e30]]), np.array([[1e30]]))[0, 0] == knn.MAX_LONG
