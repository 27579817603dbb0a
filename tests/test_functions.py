"""Hand-computed values of the scalar expressions and statistics."""

import math
import random

import pytest
from pyspark.sql import functions as F

from varloom.functions import annotation as an
from varloom.functions import genome, stats


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_genome(spark):
    rows = spark.createDataFrame([("chr1",), ("chr23",), ("24",), ("MT",), ("CHR1",)], "c string").select(genome.normalise_chrom(F.col("c")).alias("c"))
    assert [r.c for r in rows.collect()] == ["1", "X", "Y", "MT", "CHR1"]
    assert genome.build_name("HG19") == "GRCh37" and genome.build_name("b38") == "GRCh38"
    with pytest.raises(ValueError):
        genome.build_name("hg17")
    par = lambda p, c: genome.in_par(F.lit(p), F.lit(c))
    assert list(one(spark, par(60001, "X"), par(2699520, "X"), par(2699521, "X"), par(59363566, "Y"), par(60001, "1"))) == [True, True, False, True, False]
    dose = lambda n, c, s, p=5_000_000: genome.ploidy_dosage(F.lit(n), F.lit(c), F.lit(p), F.lit(s))
    assert list(one(spark, dose(1, "X", "M"), dose(2, "X", "M"), dose(1, "X", "M", 60001), dose(1, "X", "F"), dose(1, "Y", "F"), dose(1, "1", None))) == [2, 4, 1, 1, None, 1]
    chroms = spark.createDataFrame([(c,) for c in ("MT", "X", "10", "2", "Y", "GL1")], "c string")
    assert [r.c for r in chroms.orderBy(genome.chrom_order(F.col("c"))).collect()] == ["2", "10", "X", "Y", "MT", "GL1"]
    assert sorted((r.c, r["index"]) for r in genome.dense_index(chroms, "c", genome.chrom_order(F.col("c"))).collect())[0] == ("10", 1)


def test_consequences(spark):
    sev = lambda c: an.severity(F.lit(c))
    assert list(one(spark, sev("missense_variant&stop_gained"), sev("5_prime_UTR_variant"), sev("nonsense"), an.severity(F.lit(None).cast("string")))) == [4, 2, 0, 0]
    assert list(one(spark, *[an.consequence_class(F.lit(c)) for c in ("stop_gained", "missense_variant", "synonymous_variant", "intron_variant")])) == ["lof", "missense", "synonymous", "other"]
    assert list(one(spark, an.numeric_suffix(F.lit("deleterious0.05")), an.numeric_suffix(F.lit("tolerated1")), an.numeric_suffix(F.lit("none")))) == [0.05, 1.0, None]
    fields = lambda c, canon: "|".join(["T", c, "", "G"] + [""] * 20 + [canon])
    csq = ",".join([fields("intron_variant", ""), fields("stop_gained", ""), fields("missense_variant", "YES"), "A" + fields("stop_lost", "YES")])
    pick = lambda s: an.pick_transcript(an.parse_csq(F.lit(s), F.lit("T")))[1]
    assert list(one(spark, pick(csq), pick(csq.replace("YES", "")), pick("A|x"))) == ["missense_variant", "stop_gained", None]


def test_encoders(spark):
    assert list(one(spark, an.one_hot_severity(F.lit(3)), an.one_hot_severity(F.lit(0)))) == [[0, 0, 1, 0], [0, 0, 0, 0]]
    row = one(spark, an.sinusoid(F.lit(7)), *[an.level_features(k, F.lit(1), F.lit(2), F.lit(0.05), F.lit(0.9), F.lit(7)) for k in ("L0", "L1", "L2", "L3", "L4")])
    assert [len(x) for x in row] == [64, 1, 65, 69, 71, 71] and row[4] == row[5] and row[4][-2:] == [0.95, 0.9]
    assert math.isclose(row[0][3], math.cos(7 * math.exp(-math.log(10000) / 32)))
    b = lambda q, k: an.relative_bucket(F.lit(q), F.lit(k))
    assert list(one(spark, b(100, 100), b(103, 100), b(100, 103), b(10_000_000, 0), an.relative_bucket(F.lit(1), F.lit(2), F.lit("1"), F.lit("2")))) == [0, 19, 3, 31, 32]
    with pytest.raises(ValueError):
        an.relative_bucket(F.lit(1), F.lit(2), F.lit("1"))
    v = F.array(F.lit(3.0), F.lit(-4.0))
    assert list(one(spark, *[an.reduce_vector(v, k) for k in ("l2", "l1", "sum", "mean")])) == [5.0, 7.0, -1.0, -0.5]
    bins = [an.maf_bin(F.lit(f), [0.2, 0.4, 0.6]) for f in (0.1, 0.2, 0.4, 0.7)]
    assert list(one(spark, *bins)) == ["<20.0%", "20.0-40.0%", "40.0-60.0%", ">60.0%"]
    df = spark.createDataFrame([(1.0, "a"), (None, "a"), (5.0, "a"), (None, "b")], "x double, g string")
    assert [r.x for r in df.select("g", an.impute(F.col("x"), "median", ("g",)).alias("x")).orderBy("g", "x").collect()] == [1.0, 3.0, 5.0, 0.5]


def test_effective_n_and_power(spark):
    e = lambda *c: stats.effective_n(*[F.lit(x) for x in c])
    assert list(one(spark, e(10, 10, 10, 10), e(10, 0, 10, 10))) == [2.5, 0.0]
    assert stats.alpha_threshold(0.05, 1000, "bonferroni") == 5e-5 and stats.alpha_threshold(0.05, 1000) == 0.05
    assert one(spark, stats.minimum_effect(F.lit(0.0), 1.0, 0.05))[0] == math.inf
    assert math.isclose(one(spark, stats.minimum_effect(F.lit(4.0), 1.0, 0.05))[0], (1.959963984540054 + 0.8416212335729143) / 2)
    assert stats.n_for_effect(0, 1, 0.05) == 2**63 - 1 and stats.n_for_effect(0.5, 1.0, 0.05) == 32


def test_ranks_and_corrections(spark):
    rng = random.Random(1)
    ps = [rng.choice([0.001, 0.01, 0.2, 0.2, 0.5, 0.9]) for _ in range(40)]
    got = {r.i: r.fdr for r in stats.bh_fdr(spark.createDataFrame(list(enumerate(ps)), "i int, p double"), "p").collect()}
    order, low, want = sorted(range(40), key=lambda i: ps[i]), 1.0, {}
    for k in range(39, -1, -1):
        low = min(low, ps[order[k]] * 40 / (k + 1))
        want[order[k]] = low
    assert all(math.isclose(got[i], min(want[j] for j in range(40) if ps[j] == ps[i])) for i in range(40))
    real, null = [3.0, 1.0, 2.0, 2.0], [0.5, 2.0, 2.5]
    t = stats.empirical_p(spark.createDataFrame([(x,) for x in real], "s double"), spark.createDataFrame([(x,) for x in null], "s double"), "s")
    assert sorted((r.s, r.p_value) for r in t.collect()) == [(1.0, 0.75), (2.0, 0.75), (2.0, 0.75), (3.0, 0.25)]
    q = stats.rank_quantile(spark.createDataFrame([("A", 4.0), ("B", 9.0), ("C", 9.0), ("D", -1.0), ("E", None)], "g string, s double"), "s", "q", "g")
    assert {r.g: r.q for r in q.collect()} == {"A": 1 / 3, "B": 1.0, "C": 1.0, "D": 0.0, "E": 0.0}
    with pytest.raises(ValueError):
        stats.correct(t, "p_value", "holm")


@pytest.mark.parametrize("side", ["greater", "less", "two-sided"])
def test_fisher(spark, side):
    tables = [(3, 5, 6, 20), (0, 4, 4, 10), (8, 10, 12, 25), (5, 5, 5, 5), (1, 1, 9, 10)]
    df = spark.createDataFrame([(*t, t[3]) for t in tables], "a long, r long, c long, n long, m int").withColumn("lf", stats.log_factorial("m"))
    got = [r.p for r in df.select(stats.fisher(F.col("lf"), F.col("a"), F.col("r"), F.col("c"), F.col("n"), side).alias("p")).collect()]
    for (a, r, c, n), p in zip(tables, got, strict=True):
        pmf = {k: math.comb(r, k) * math.comb(n - r, c - k) / math.comb(n, c) for k in range(max(0, r + c - n), min(r, c) + 1)}
        want = sum(v for k, v in pmf.items() if (k >= a if side == "greater" else k <= a if side == "less" else v <= pmf[a] * (1 + 1e-7)))
        assert math.isclose(p, min(1.0, want), rel_tol=1e-9)


def test_two_samples(spark):
    rows = [(x, 1, "k") for x in (1.0, 2.0, 2.0, 5.0)] + [(x, 0, "k") for x in (2.0, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "x double, g int, k string")
    u = stats.mann_whitney_p(stats.mann_whitney_u(df, "x", "g", ("k",))).first()
    assert (u.n1, u.n0, u.u) == (4, 3, 4.0) and 0 < u.p_value <= 1
    assert math.isclose(stats.ks_statistic(df, "x", "g").first().ks, 0.75 - 1 / 3)
    hl = spark.createDataFrame([("g", 5.0, 1.0), ("g", 9.0, 2.0)], "k string, a double, b double")
    assert stats.hodges_lehmann(hl, "a", "b", "k").first().shift == 5.5 and stats.hodges_lehmann(hl, "a", "b", "k", 1).first().shift == 5.5


def test_fisher_of_large_margins_takes_few_steps(spark):
    import time

    n, row, col = 4_000_000, 900_000, 800_000
    rows = [(k + i, row, col, n) for k in (179_000, 180_000, 181_000) for i in range(20)]
    df = spark.createDataFrame(rows, "a long, r long, c long, n long")
    start = time.time()
    got = {r.a: (r.g, r.l) for r in df.select("a", *[stats.fisher(None, F.col("a"), F.col("r"), F.col("c"), F.col("n"), s).alias(x) for s, x in (("greater", "g"), ("less", "l"))]).collect()}
    assert time.time() - start < 60  # 620,000 terms a row before
    assert got[180_000][0] == pytest.approx(0.5, abs=0.01)
    for a in (180_000, 181_000):
        assert got[a][0] + got[a][1] - 1 == pytest.approx(stats.fisher_p(a, row, col, n, "greater") - stats.fisher_p(a + 1, row, col, n, "greater"), rel=1e-4, abs=1e-9)


@pytest.mark.parametrize("side", ["greater", "less", "two-sided"])
def test_fisher_equals_the_plain_sum(side):
    from fractions import Fraction

    for n, row, col in ((12, 5, 7), (30, 15, 15), (30, 29, 4), (9, 9, 3), (40, 0, 3), (41, 20, 21)):
        pmf = {k: Fraction(math.comb(row, k) * math.comb(n - row, col - k), math.comb(n, col)) for k in range(max(0, row + col - n), min(row, col) + 1)}
        for a in pmf:
            ok = {"greater": lambda k: k >= a, "less": lambda k: k <= a, "two-sided": lambda k: pmf[k] <= pmf[a] * (1 + Fraction(1, 10**7))}[side]
            assert stats.fisher_p(a, row, col, n, side) == pytest.approx(float(sum(v for k, v in pmf.items() if ok(k))), rel=1e-11)
