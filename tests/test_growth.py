"""What keeps a query's figures from growing faster than its tables."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.functions import shape
from varloom.operators import cohort, pairs
from varloom.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "passes"), [("null_contrast", 1), ("correction_none", 1), ("correction_bonferroni", 1), ("correction_fdr_bh", 1), ("significance_counts", 1), ("topk_overlap", 1), ("gene_bootstrap", 2)])
def test_calls_are_joined_no_more_often_than_needed(spark, monkeypatch, name, passes):
    seen, one = [], queries.calls
    monkeypatch.setattr(queries, "calls", lambda *a: seen.append(1) or one(*a))
    queries.QUERIES[name](spark, SF)
    assert len(seen) == passes


def test_a_rank_of_the_mean_computes_no_medians(spark, monkeypatch):
    written = []
    write = queries.ordered.written
    monkeypatch.setattr(queries.ordered, "written", lambda df: written.append(df.columns) or write(df))
    queries.topk_overlap(spark, SF)
    queries.gene_bootstrap(spark, SF)
    assert written and not any({"median_score", "std_score"} & set(c) for c in written)


def test_standardised_groups_dont_meet_in_one_task(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 2.0)], "g string, v double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # tables that Spark would not broadcast by itself
    try:
        z = shape.standardised(df, "v", "g")
        assert "SortMergeJoin" not in z._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.g, r.z) for r in z.collect()) == [("a", -1.0), ("a", 1.0), ("b", 0.0), ("b", 0.0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_logistic_z_takes_counted_rows(spark):
    rows = [("k", float(x), y) for x, y, n in ((0, 0, 40), (0, 1, 25), (1, 0, 12), (1, 1, 19), (2, 1, 3), (2, 0, 2)) for _ in range(n)]
    full = spark.createDataFrame(rows, "k string, x double, label int")
    a = cohort.logistic_z(full, "k", ["x"]).first()
    b = cohort.logistic_z(full.groupBy("k", "x", "label").agg(F.count(F.lit(1)).alias("n")), "k", ["x"], count="n").first()
    assert (a.z, a.p_value) == pytest.approx((b.z, b.p_value)) and a.z > 1


def test_delta_rank_quartiles_of_kept_and_missing_replicates(spark):
    real = spark.createDataFrame([("1", 1, 2), ("1", 2, 1)], "chrom string, pos long, rank long")
    ranks = [1.0, 4.5, 2.0, 3.0, 9.0]
    null = spark.createDataFrame([(i, "1", 1, r) for i, r in enumerate(ranks)], "rep long, chrom string, pos long, rank double")
    made = cohort.delta_rank(real, null, 7, 9)
    assert "percentile" not in made._jdf.queryExecution().executedPlan().toString()  # no row a replicate is made again
    got = {r.pos: r for r in made.collect()}
    q = np.quantile([*ranks, 10.0, 10.0], (0.25, 0.5, 0.75))
    assert (got[1].median_null_rank, got[1].iqr, got[1].p_value, got[1].at_floor) == pytest.approx((q[1], q[2] - q[0], 3 / 8, False))
    assert (got[2].median_null_rank, got[2].iqr, got[2].p_value, got[2].at_floor) == pytest.approx((10.0, 0.0, 1 / 8, True))


def test_replicate_pools_reads_null_ranks_from_a_table(spark, monkeypatch):
    wrote, write = [], cohort.ordered.written
    monkeypatch.setattr(cohort.ordered, "written", lambda df: wrote.append(1) or write(df))
    real = spark.createDataFrame([("1", i, float(i)) for i in range(1, 7)], "chrom string, pos long, rank double")
    null = spark.createDataFrame([(0, "1", i, float(7 - i)) for i in range(1, 7)] + [(1, "1", 9, 1.0), (1, "1", 1, 2.0)], "rep long, chrom string, pos long, rank double")
    got = {r.rep: (r.overlap, r.pool, r.ks) for r in cohort.replicate_pools(real, null, (2,), 6, 6).collect()}
    assert got == {0: (0, 4, 0.0), 1: (1, 3, 0.0)}
    assert wrote


def test_embedding_means_keep_the_sign_of_a_zero(spark, tmp_path):
    spark.createDataFrame([(0, [-4e-6, 4e-6, 0.0, -2e-5], 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    v = queries.gene_embedding_mean(spark, str(tmp_path)).first().vector
    assert v == [0.0, 0.0, 0.0, -2e-5] and [math.copysign(1, x) for x in v] == [-1, 1, 1, -1]


def test_interactions_hold_no_table_of_samples_and_pairs(spark):
    rows = [(1, 5, 1, 3, 2, 0.5), (1, 3, 2, 5, 1, 0.7), (2, 5, 1, 3, 2, 0.1), (None, 3, 2, 5, 1, 0.9), (3, 4, 1, 4, 1, 0.2), (3, 4, 1, 4, 1, 0.2)]
    df = spark.createDataFrame([(s, "1", p, g, "1", q, h, x) for s, p, g, q, h, x in rows], "sample_id long, chrom_a string, pos_a long, gene_a long, chrom_b string, pos_b long, gene_b long, score double")
    made = pairs.interactions_across_samples(df, 1)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "HashAggregate" in x and "sample_id" in x]
    got = {r.pos_a: (r.pos_b, r.n_samples, r.n_occurrences, round(r.mean_score, 9), r.max_score) for r in made.collect()}
    assert got == {3: (5, 2, 4, 0.55, 0.9), 4: (4, 1, 2, 0.2, 0.2)}  # a null sample is none
