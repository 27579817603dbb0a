from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.functions import ordered, stats
from varloom.operators import cohort, pairs


def rows(n=400, seed=2):
    rng = random.Random(seed)
    return [(i, rng.choice("ab"), rng.choice([None, float("nan"), float("inf"), -0.0, 0.0, 1.5]) if i % 5 == 0 else rng.randrange(60) / 4, rng.randrange(2)) for i in range(n)]


def test_ranks_equal_windows(spark):
    from pyspark.sql import Window

    df = spark.createDataFrame(rows(), "i int, k string, v double, g int")
    for by in ((), ("k",)):
        w = Window.partitionBy(*by)
        want = df.withColumn("d", F.rank().over(w.orderBy(F.desc_nulls_last("v")))).withColumn("a", F.rank().over(w.orderBy(F.asc_nulls_last("v"))))
        got = stats.min_rank(stats.min_rank(df, "v", "d", by), "v", "a", by, descending=False)
        assert sorted((r.i, r.d, r.a) for r in got.collect()) == sorted((r.i, r.d, r.a) for r in want.collect())
        mean = want.withColumn("m", F.col("d") + (F.count(F.lit(1)).over(Window.partitionBy(*by, "v")) - 1) / 2)
        assert {r.i: r.m for r in stats.average_rank(df, "v", "m", by).collect()} == {r.i: r.m for r in mean.collect()}
        placed = ordered.place(df, "p", "v", F.asc("i"), by=by)
        want = df.withColumn("p", F.row_number().over(w.orderBy(F.desc_nulls_last("v"), "i")))
        assert {r.i: r.p for r in placed.collect()} == {r.i: r.p for r in want.collect()}


def test_no_plan_has_a_window_without_keys(spark):
    df = spark.createDataFrame(rows(), "i int, k string, v double, g int")
    made = [stats.average_rank(df, "v", "r"), stats.min_rank(df, "v", "r"), stats.rank_quantile(df, "v", "q", "i"), stats.empirical_p(df, df, "v"), stats.bh_fdr(df, "v"), stats.correct(df, "v", "bonferroni"), stats.ks_statistic(df, "v", "g"), ordered.place(df, "r", "v", F.asc("i"))]
    for x in made:
        plan = x._jdf.queryExecution().optimizedPlan().toString()
        lines = [line for line in plan.split("\n") if "Window [" in line]
        assert all("_part" in line or "v#" in line.split("], [")[1] for line in lines), plan


def test_fdr_by_group_and_nulls(spark):
    rng = random.Random(4)
    data = [(i, "ab"[i % 2], None if i % 17 == 0 else rng.choice([rng.random(), 0.01, 0.5])) for i in range(300)]
    got = {r.i: r.fdr for r in stats.bh_fdr(spark.createDataFrame(data, "i int, k string, p double"), "p", by=("k",)).collect()}
    for k in "ab":
        own = sorted((p, i) for i, g, p in data if g == k and p is not None)
        low = 1.0
        for rank in range(len(own), 0, -1):
            p, i = own[rank - 1]
            low = min(low, p * len(own) / rank)
            assert math.isclose(got[i], low)
    assert all(got[i] is None for i, _, p in data if p is None)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "i int, k string, v double, g int")
    for x in (stats.average_rank(df, "v", "r", ("k",)), stats.bh_fdr(df, "v"), stats.empirical_p(df, df, "v"), ordered.place(df, "r", "v", F.asc("i"))):
        assert x.collect() == []


@pytest.mark.parametrize("sizes", [(1, 1), (3, 4), (5, 3), (7, 7)])
def test_ks_p_counts_paths(sizes):
    n, m = sizes
    far = lambda s: max(abs(sum(s[:t]) / n - (t - sum(s[:t])) / m) for t in range(n + m + 1))
    paths = [[i in c for i in range(n + m)] for c in itertools.combinations(range(n + m), n)]
    for d in {round(far(p), 12) for p in paths}:
        want = sum(far(p) >= d - 1e-9 for p in paths) / len(paths)
        assert math.isclose(stats.ks_p(d, n, m), want, abs_tol=1e-12)
    assert abs(stats.ks_p(0.1, 400, 500) - stats.ks_p(0.1, 400, 500, exact=0)) < 0.01
    assert stats.ks_p(0.5, 0, 3) == 1


def test_middle_difference_is_the_median_of_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (rng.choice([rng.normal(size=k), rng.integers(0, 5, k).astype(float)][rng.integers(0, 2)], k) for k in rng.integers(1, 25, 2))
        assert math.isclose(stats.middle_difference(a, b), np.median(np.subtract.outer(a, b)), abs_tol=1e-12)


def test_weights_sum_to_draws_and_means_are_weighted(spark):
    s = spark.createDataFrame([(i * 3,) for i in range(50)], "sample_id long")
    w = cohort.weight_arrays(s, 4)
    held = {r.sample_id: r.weights for r in w.collect()}
    assert [sum(x[k] for x in held.values()) for k in range(4)] == [50] * 4
    calls = [(i * 3, "1", j, float(i * j)) for i in range(50) for j in range(3) if (i + j) % 4]
    got = {r.pos: r.means for r in cohort.weighted_means(spark.createDataFrame(calls, "sample_id long, chrom string, pos int, s double"), w, 4, "s", ("chrom", "pos")).collect()}
    for j in range(3):
        for k in range(4):
            mine = [(x, held[i][k]) for i, _, p, x in calls if p == j and i in held]
            assert math.isclose(got[j][k], sum(x * y for x, y in mine) / sum(y for _, y in mine))


def test_pair_numbers_are_places(spark):
    for n in (2, 3, 9, 1000):
        total = n * (n - 1) // 2
        numbers = spark.range(total if n < 1000 else 200).select(((F.col("id") * (total // 200)) if n == 1000 else F.col("id")).alias("number"), F.col("id").alias("at"), F.lit(n).alias("n"))
        want = list(itertools.combinations(range(1, n + 1), 2))
        assert {r.at: (r.i, r.j) for r in pairs.unranked(numbers).collect()} == {at: want[at * (total // 200) if n == 1000 else at] for at in range(total if n < 1000 else 200)}


def test_pair_budget(spark):
    index = spark.createDataFrame([("1", p, 100 - p) for p in range(60)], "chrom string, pos int, n_carriers int")
    got = pairs.select_pairs(index, 10, 60, 80, 1).collect()
    count = lambda part: len({(r.pos_a, r.pos_b) for r in got if r.part == part})
    assert (count("top"), count("rare"), len(got)) == (45, 15, 60)
    assert all(r.pos_a < r.pos_b < 10 for r in got if r.part == "top")
    assert all(min(r.pos_a, r.pos_b) > 20 for r in got if r.part == "rare")
    assert pairs.select_pairs(index, 10, 0, 80, 1).collect() == []
    assert {r.part for r in pairs.select_pairs(index, 10, 9, 80, 1).collect()} == {"top"}
