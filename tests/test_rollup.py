import pytest
from pyspark.errors import PySparkException

from varloom.functions import annotation as an
from varloom.operators import rollup
from varloom.plans.round_trips import _vcf  # noqa: F401  the module registers its queries
from varloom.sources.scratch import scratch


def test_delta_rank_rollup_and_its_errors(spark):
    v = spark.createDataFrame([("A", 1.0), ("A", 4.0), ("B", -2.0), ("C", None)], "gene string, delta_rank double")
    g = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "gene string, x int")
    got = {r.gene: (r.gene_delta_rank, r.gene_delta_rank_aggregation, r.x) for r in rollup.with_delta_rank(g, v, "mean").collect()}
    assert got == {"A": (2.5, "mean", 1), "B": (-2.0, "mean", 2), "C": (None, "mean", 3)}
    assert {r.gene: r.gene_delta_rank for r in rollup.with_delta_rank(g, v).collect()}["A"] == 4.0
    with pytest.raises(ValueError):
        rollup.with_delta_rank(g.union(spark.createDataFrame([("Z", 4)], "gene string, x int")), v)
    with pytest.raises(ValueError):
        rollup.with_delta_rank(rollup.with_delta_rank(g, v), v)
    many = spark.range(100).selectExpr("concat('g', id) as gene")
    held = spark.range(99).selectExpr("concat('g', id) as gene", "1.0 as delta_rank")
    assert rollup.with_delta_rank(many, held).where("gene_delta_rank is null").count() == 1  # a hundredth may be missing


def test_covariates_put_sex_first_and_need_every_sample(spark):
    s = spark.createDataFrame([("a", "M"), ("b", "F"), ("c", None)], "sample_id string, sex string")
    p = spark.createDataFrame([(x, [0.5, 2.0]) for x in "abcd"], "sample_id string, pcs array<float>")
    got = {r.sample_id: r.covariates for r in rollup.covariate_vectors(s, p).collect()}
    assert got == {"a": [1.0, 0.5, 2.0], "b": [0.0, 0.5, 2.0], "c": [-1.0, 0.5, 2.0]}
    assert rollup.covariate_vectors(s, p, with_sex=False).first().covariates == [0.5, 2.0]
    with pytest.raises(PySparkException):
        rollup.covariate_vectors(s, p.where("sample_id <> 'b'")).collect()


def test_statistics_of_an_empty_cohort_and_scores(spark):
    s = spark.createDataFrame([(1,), (2,)], "sample_id long")
    c = spark.createDataFrame([(1, "A"), (1, "B"), (1, "A")], "sample_id long, gene string")
    r = rollup.sample_statistics(s, c).first()
    assert (r.n_samples, r.mean_variants, r.max_variants, r.min_variants, r.n_genes) == (2, 1.5, 3, 0, 2)
    r = rollup.sample_statistics(s.limit(0), c.limit(0)).first()
    assert (r.n_samples, r.max_variants, r.min_variants, r.n_genes) == (0, 0, 0, 0)
    v = spark.createDataFrame([("A", 1.0), ("A", None), ("B", None)], "gene string, mean_score double")
    assert {x.gene: (x.gene_score, x.num_variants) for x in rollup.gene_maxima(v).collect()} == {"A": (1.0, 1), "B": (None, 0)}


def test_impute_columns_equals_the_window_form(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 5.0, 2.0), ("a", None, 4.0), (None, None, 1.0), ("c", None, None)], "g string, x double, y double")
    got = an.impute_columns(df, {"x": "median", "y": "mean"}, ("g",))
    want = df.select("g", an.impute(df.x, "median", ("g",)).alias("x"), an.impute(df.y, "mean", ("g",)).alias("y"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert [r.x for r in an.impute_columns(df.select("x"), {"x": "neutral"}).where("x = 0.5").collect()] == [0.5] * 3
    with pytest.raises(ValueError):
        an.impute_columns(df, {"x": "mode"})


class Session:
    """A session with the given settings alone."""

    def __init__(self, master, **settings):
        self.sparkContext = type("C", (), {"master": master})
        self.conf = type("S", (), {"get": staticmethod(lambda k, default=None: settings.get(k.replace(".", "_"), default))})


def test_scratch_is_in_a_folder_that_all_executors_share():
    assert scratch(Session("spark://x", spark_checkpoint_dir="hdfs://n/shared/"), "x").startswith("hdfs://n/shared/x-")
    assert scratch(Session("local[4]"), "x").startswith("file:///")
    for master in ("spark://x", "local-cluster[3,2,1000]"):
        assert scratch(Session(master, spark_sql_warehouse_dir="hdfs://n/w"), "x").startswith("hdfs://n/w/_varloom_scratch/x-")


def test_pair_carriers_skip_ambiguous_samples(spark):
    calls = spark.createDataFrame([(1, 10, "A"), (1, 20, "B"), (1, 20, "B"), (2, 10, "A"), (2, 20, "B"), (2, 30, "C"), (3, 10, "A"), (3, 20, "B"), (3, 30, "C"), (4, 30, "C")], "sample_id long, pos long, gene string")
    pairs = spark.createDataFrame([(0, 10, "A", 20, "B"), (1, 10, "A", 30, "C"), (2, 10, "A", 99, "Z")], "pair int, pos1 long, gene1 string, pos2 long, gene2 string")
    got = {r.pair: r.sample_id for r in rollup.pair_carriers(pairs, calls).collect()}
    assert got == {0: 2, 1: 2, 2: None}


def test_scores_are_standardised_or_refused(spark):
    df = spark.createDataFrame([("1", 5, None, "g", "2.5", "x"), ("1", 6, None, None, "bad", "7")], "chromosome string, position long, gene_symbol string, gene_id string, mean_attribution string, rank string")
    got = [(r.gene_symbol, r.variant_score, r.variant_rank) for r in rollup.standardise_scores(df).orderBy("position").collect()]
    assert got == [("g", 2.5, None), (None, None, 7.0)]
    for bad, score in ((df.drop("position"), None), (df.drop("gene_id", "gene_symbol"), None), (df.drop("mean_attribution"), None), (df, "other")):
        with pytest.raises(ValueError):
            rollup.standardise_scores(bad, score)


def test_contigs_and_histories():
    assert rollup.x_contig(["chr1", "chrX", "X"]) == "chrX" and rollup.x_contig(["1", "23"]) == "23"
    assert rollup.check_history({"loss": [1, 2], "auc": [3, 4], "best": 1}) == {"loss": [1, 2], "auc": [3, 4]}
    with pytest.raises(ValueError):
        rollup.x_contig(["chr1", "Y"])
    for bad in ({"a": [1], "b": [1, 2]}, {"a": []}, {"best": 1}):
        with pytest.raises(ValueError):
            rollup.check_history(bad)
