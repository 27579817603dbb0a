from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.functions import shape
from varloom.operators import cohort, null_models

#: Smoothness of paper by four laboratories (Scholz and Stephens 1987), a published example. Fixed values.
LABS = {
    "1": (38.7, 41.5, 43.8, 44.5, 45.5, 46.0, 47.7, 58.0),
    "2": (39.2, 39.3, 39.7, 41.4, 41.8, 42.9, 43.3, 45.8),
    "3": (34.0, 35.0, 39.0, 40.0, 43.0, 43.0, 44.0, 45.0),
    "4": (34.0, 34.8, 34.8, 35.4, 37.2, 37.8, 41.2, 42.8),
}


def test_anderson_darling_published_example(spark):
    rows = [(g, v) for g, vs in LABS.items() for v in vs] + [("1", None), ("2", float("nan")), ("3", float("inf")), ("other", 1.0)]
    r = shape.anderson_darling(spark.createDataFrame(rows, "g string, v double"), "v", "g", list(LABS)).first()
    assert r.n == 32
    assert r.statistic == pytest.approx(4.480, abs=1e-3)
    assert r.p_value == pytest.approx(0.0020, rel=0.15)  # a quadratic through seven levels, given to two digits


def test_anderson_darling_two_groups_and_edges(spark):
    def brute(a, b):
        both = sorted(set(a + b))
        n, total = len(a) + len(b), 0.0
        for x in (a, b):
            for z in both:
                l = sum(v == z for v in a + b)
                below = sum(v < z for v in a + b) + l / 2
                m = sum(v < z for v in x) + sum(v == z for v in x) / 2
                total += l / n * (n * m - len(x) * below) ** 2 / (below * (n - below) - n * l / 4) / len(x)
        total *= (n - 1) / n
        h = sum(1 / i for i in range(1, n))
        g = sum(1 / ((n - i) * j) for i in range(1, n - 1) for j in range(i + 1, n))
        s = 1 / len(a) + 1 / len(b)
        ca, cb = 4 * g - 6 + (10 - 6 * g) * s, 4 * (2 * g - 4) + 16 * h + (2 * g - 14 * h - 4) * s - 8 * h + 4 * g - 6
        cc, cd = 4 * (6 * h + 2 * g - 2) + 2 * (4 * h - 4 * g + 6) + (2 * h - 6) * s + 4 * h, 4 * (2 * h + 6) - 8 * h
        return (total - 1) / math.sqrt((ca * n**3 + cb * n * n + cc * n + cd) / ((n - 1) * (n - 2) * (n - 3)))

    rng = random.Random(4)
    for size in (3, 9, 60):
        a, b = [rng.randrange(12) / 2 for _ in range(size)], [rng.randrange(14) / 2 for _ in range(size + 2)]
        df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "g string, v double")
        assert shape.anderson_darling(df, "v", "g", ["a", "b"]).first().statistic == pytest.approx(brute(a, b), abs=1e-8)
    same = spark.createDataFrame([("a", 1.0)] * 5 + [("b", 1.0)] * 5, "g string, v double")
    assert shape.anderson_darling(same, "v", "g", ["a", "b"]).first().statistic is None
    assert shape.anderson_darling(same.limit(0), "v", "g", ["a", "b"]).first().statistic is None


def test_density_is_near_the_direct_sum(spark):
    rng = random.Random(1)
    v = [rng.gauss(0, 1) for _ in range(300)]
    rows = [("a", x) for x in v] + [("flat", 1.0)] * 5 + [("few", 0.0), ("few", 2.0)]
    made = shape.density(spark.createDataFrame(rows, "g string, v double"), "v", "g").collect()
    assert len(made) == 1500
    assert all(r.density == 0 for r in made if r.g != "a")
    h = np.std(v, ddof=1) * len(v) ** -0.2
    for r in made:
        if r.g == "a":
            direct = sum(math.exp(-(((r.x - x) / h) ** 2) / 2) for x in v) / (len(v) * h * math.sqrt(2 * math.pi))
            assert r.density == pytest.approx(direct, abs=1e-4)
    assert shape.density(spark.createDataFrame([], "g string, v double"), "v", "g").count() == 0


def test_permutations_keep_classes_and_notice_changes(spark, tmp_path):
    s = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "sample_id long, label int")
    path = str(tmp_path / "perms")
    facts = null_models.write_permutations(s, path, 4, 7, "cohort").orderBy("perm").collect()
    assert [(r.perm, r.seed, r.n_samples, r.n_cases, r.n_controls, r.is_null_baseline, r.source) for r in facts] == [(i, 7 + i, 60, 20, 40, True, "cohort") for i in range(4)]
    assert len({r.digest for r in facts}) == 4
    rows = null_models.read_permutations(spark, path)
    other = null_models.permutation_facts(rows.repartition(7, "label").orderBy(F.desc("sample_id")))
    assert {r.perm: r.digest for r in other.collect()} == {r.perm: r.digest for r in facts}
    for r in facts:
        own = rows.where(F.col("perm") == r.perm).collect()
        assert sum(x.label == x.original for x in own) == r.same_position
    spark.createDataFrame([(9, 61, 1, 1)], "seed long, sample_id long, label int, original int").write.mode("append").parquet(f"{path}/cohorts/perm=2")
    with pytest.raises(ValueError, match=r"\[2\]"):
        null_models.read_permutations(spark, path)


def auc_by_hand(x, y, held):
    """Dense, one row a sample, plain gradient steps on the same objective."""
    t = ~held
    m, s = x[t].mean(0), x[t].std(0)
    z = np.column_stack([np.ones(len(x)), (x - m) / np.where(s > 1e-12, s, 1)])
    n = np.array([(y[t] == c).sum() for c in (0, 1)])
    w = (t.sum() / (2 * n))[y[t]]
    b = np.zeros(z.shape[1])
    rate = 1 / (np.linalg.norm(z[t] * np.sqrt(w)[:, None], 2) ** 2 / 4 + 1)
    for _ in range(20000):
        p = 1 / (1 + np.exp(-z[t] @ b))
        b = b - rate * (z[t].T @ (w * (p - y[t])) + np.r_[0.0, b[1:]])
    d = np.round(z[held] @ b, 6)
    return np.mean([(p > q) + (p == q) / 2 for p in d[y[held] == 1] for q in d[y[held] == 0]])


def test_set_aucs_equal_a_dense_fit(spark):
    rng = np.random.default_rng(3)
    genes, n = ["a", "b", "c", "d"], 60
    y = rng.integers(0, 2, n)
    x = rng.poisson(0.4 + 0.5 * y[:, None] * np.array([1, 0, 0.5, 0]), (n, 4))
    who = cohort.stratified_folds(spark.createDataFrame([(i, int(y[i])) for i in range(n)], "sample_id long, label int"), 3, 1).cache()
    fold = {r.sample_id: r.fold for r in who.collect()}
    f = np.array([fold[i] for i in range(n)])
    matrix = spark.createDataFrame([(i, g, int(x[i, j])) for i in range(n) for j, g in enumerate(genes) if x[i, j]], "sample_id long, gene string, burden long")
    sets = {"s1": ["a", "b"], "s2": ["c"], "s3": genes, "s4": ["a", "lost"]}
    df = spark.createDataFrame([(k, g) for k, v in sets.items() for g in v], "set_id string, gene string")
    made = {(r.set_id, r.fold): r.auc for r in null_models.set_aucs(df, matrix, who).collect()}
    assert len(made) == 12
    full = {g: x[:, j] for j, g in enumerate(genes)} | {"lost": np.zeros(n)}
    for (k, i), auc in made.items():
        assert auc == pytest.approx(auc_by_hand(np.column_stack([full[g] for g in sorted(sets[k])]).astype(float), y, f == i), abs=1e-9)


def test_shared_null_counts_and_invariants(spark):
    rng = np.random.default_rng(5)
    genes, n = [f"g{i}" for i in range(12)], 80
    y = np.arange(n) % 2
    x = rng.poisson(0.5, (n, 12)) + y[:, None] * (np.arange(12) < 2)
    who = cohort.stratified_folds(spark.createDataFrame([(i, int(y[i])) for i in range(n)], "sample_id long, label int"), 3, 1)
    matrix = spark.createDataFrame([(i, g, int(x[i, j])) for i in range(n) for j, g in enumerate(genes) if x[i, j]], "sample_id long, gene string, burden long")
    levels = spark.createDataFrame([("hit", "g0"), ("hit", "g1"), ("hit", "unknown"), ("rest", "g7"), ("rest", "g8"), ("none", "unknown")], "level string, gene string")
    made = {r.level: r for r in null_models.shared_null(levels, matrix, who, 15).collect()}
    assert set(made) == {"hit", "rest"}  # a level without a known gene has no row
    assert (made["hit"].k_effective, made["hit"].missing_genes, made["hit"].n_permutations) == (2, 1, 15)
    assert made["hit"].null_mean_auc == made["rest"].null_mean_auc  # one null for both
    assert made["hit"].observed_auc > 0.8 and made["hit"].z_score > 1
    assert made["hit"].empirical_p >= 1 / 16
    one_class = who.withColumn("label", F.lit(1))
    with pytest.raises(Exception, match="is not whole"):
        null_models.shared_null(levels, matrix, one_class, 3).collect()


def test_burdens_meet_once_for_all_folds(spark):
    who = spark.createDataFrame([(i, i % 2, i % 3) for i in range(12)], "sample_id long, label int, fold int")
    matrix = spark.createDataFrame([(i, "a", i % 4) for i in range(12)], "sample_id long, gene string, burden long")
    made = null_models.set_aucs(spark.createDataFrame([("s", "a")], "set_id string, gene string"), matrix, who)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas [set_id" in plan and "fold" not in plan.split("FlatMapGroupsInPandas ")[1].split("]")[0]
    assert sorted((r.fold, r.auc is None) for r in made.collect()) == [(0, False), (1, False), (2, False)]
