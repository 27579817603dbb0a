"""Small cohorts with hand-computed results."""

import math

import pytest
from pyspark.sql import functions as F

from varloom.operators import annotate, cohort, pairs, ranking
from varloom.sources import sinks, tables, vcf
from varloom.streaming.incremental import running_statistics


@pytest.fixture(scope="module")
def calls(spark):
    rows = [("S1", 1, "1", 100, "A"), ("S1", 1, "1", 100, "A"), ("S1", 1, "1", 200, "B"), ("S2", 1, "1", 100, "A"), ("S2", 1, "1", 200, "B"), ("S3", 0, "1", 100, "A"), ("S4", 0, "1", 200, "B"), ("S4", 0, "2", 50, "C"), ("S5", 0, "1", 200, "B")]
    return spark.createDataFrame([(*r, float(i + 1), 1, "missense_variant") for i, r in enumerate(rows)], "sample_id string, label int, chrom string, pos long, gene string, score double, dosage int, consequence string").cache()


def test_carriers_and_cells(calls):
    index = {(r.chrom, r.pos): r for r in pairs.carriers(calls).collect()}
    assert (index["1", 100].n_carriers, index["1", 100].n_cases, index["1", 100].n_controls, index["1", 100].gene) == (3, 2, 1, "A")
    p = {(r.pos_a, r.pos_b): r for r in pairs.cooccurrence(calls, 3, [0.2, 0.4]).collect()}
    r = p[200, 100]
    assert (r.n11, r.n10, r.n01, r.n00, r.min_cell) == (2, 2, 1, 0, 0) and math.isclose(r.expected, 2.4) and round(r.obs_exp_ratio, 4) == 0.8333
    assert p[100, 50].n11 == 0 and len(p) == 3


def test_gene_pairs_keep_those_that_never_meet(spark, calls):
    genes = spark.createDataFrame([("A", 4.0), ("B", 9.0), ("C", 1.0)], "gene string, score double")
    got = {(r.gene_a, r.gene_b): r for r in pairs.gene_interactions(calls, genes).collect()}
    assert got["A", "B"].n_cooccur == 2 and got["A", "C"].n_cooccur == 0 and got["B", "C"].n_cooccur == 1
    assert math.isclose(got["A", "B"].interaction_score, math.sqrt(2 / 3) * math.log(3)) and math.isclose(got["A", "C"].p_value, 1.0)
    assert {r.gene: r.degree for r in pairs.network_nodes(spark.createDataFrame([("A", "B", 1.0), ("A", "C", 2.0)], "gene_a string, gene_b string, weight double")).collect()} == {"A": 2, "B": 1, "C": 1}


def test_variant_and_gene_ranking(calls):
    v = ranking.rank_variants(calls)
    top = v.where("pos = 100").first()
    assert (top.mean_score, top.max_score, top.median_score, top.num_samples, top.case_n, top.control_mean) == (3.25, 6.0, 3.0, 4, 3, 6.0)
    g = {r.gene: r for r in ranking.rank_genes(v, "size_normalised").collect()}
    assert g["C"].gene_score == 8.0 and g["C"].gene_rank == 1 and g["A"].top_pos == 100
    for how in ("median", ""):
        with pytest.raises(ValueError):
            ranking.rank_variants(calls, how)
        with pytest.raises(ValueError):
            ranking.rank_genes(v, how)


def test_chromosome_z_of_single_variants_is_zero(calls):
    z = {r.pos: r.z_score for r in ranking.chromosome_z(ranking.rank_variants(calls)).collect()}
    assert z[50] == 0.0 and math.isclose(z[100], -z[200])


def test_chunks_keep_empty_samples(spark):
    n = spark.createDataFrame([("a", 0), ("b", 10), ("c", 11)], "sample_id string, n int")
    got = {(r.sample_id, r.chunk): (r.start, r.stop, r.n_chunks) for r in cohort.chunk_plan(n, 5, 1).collect()}
    assert got["a", 0] == (0, 0, 1) and got["b", 2] == (8, 10, 3) and got["c", 2] == (8, 11, 3) and len(got) == 7
    with pytest.raises(ValueError):
        cohort.chunk_plan(n, 5, 5)


def test_permutations_and_folds_keep_classes(spark):
    s = spark.createDataFrame([(i, int(i < 8)) for i in range(20)], "sample_id int, label int")
    p = cohort.permute_labels(s, [1, 2]).collect()
    assert [sum(r.label for r in p if r.perm == k) for k in (0, 1)] == [8, 8] and [r.label for r in sorted(p) if r.perm == 0] != [r.label for r in sorted(p) if r.perm == 1]
    f = cohort.stratified_folds(s, 4, 1).groupBy("fold").agg(F.sum("label").alias("c"), F.count("*").alias("n")).collect()
    assert {(r.c, r.n) for r in f} == {(2, 5)}
    w = cohort.bootstrap_weights(s, 3).groupBy("rep").agg(F.sum("weight").alias("w")).collect()
    assert {r.w for r in w} == {20}


def test_burden_keeps_samples_without_calls(spark, calls):
    s = spark.createDataFrame([("S1", 1), ("S9", 0)], "sample_id string, label int")
    sets = spark.createDataFrame([("x", "A"), ("x", "Q")], "set_name string, gene string")
    got = {r.sample_id: (r.burden, r.burden_missense, r.genes_hit) for r in cohort.burden(calls, s, sets).collect()}
    assert got == {"S1": (2, 2, 1), "S9": (0, 0, 0)}


def test_logistic_z_and_its_failures(spark):
    rows = [("g", float(x), y) for x, y in zip((0, 1, 2, 3, 4, 5, 6, 7), (0, 0, 1, 0, 1, 0, 1, 1), strict=True)] + [("bad", 1.0, 0), ("bad", 1.0, 1)]
    got = {r.k: r for r in cohort.logistic_z(spark.createDataFrame(rows, "k string, x double, label int"), "k", ["x"]).collect()}
    assert 1.0 < got["g"].z < 2.0 and got["bad"].z == 0.0 and got["bad"].p_value == 1.0


def test_classifier_folds(spark):
    rows = [(i, float(i % 2) + (i % 7) / 10, float(i % 3), i % 2, i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "sample_id int, a double, b double, label int, fold int")
    out = cohort.cross_validated_auc(df, ["a", "b"], cohort.logistic_classifier).collect()
    assert len(out) == 3 and min(r.auc for r in out) > 0.9


def test_annotation_matches(spark):
    v = spark.createDataFrame([("1", 5, 1), ("X", 9, 2)], "chrom string, pos int, rank int")
    known = spark.createDataFrame([("chr1", 5, "Pathogenic"), ("1", 5, "Likely_pathogenic"), ("2", 9, "Pathogenic")], "chrom string, pos int, clinical_significance string")
    got = {r.pos: (r.significance, r.in_clinical) for r in annotate.match_clinical(v, known).collect()}
    assert got == {5: ("Likely_pathogenic; Pathogenic", True), 9: (None, False)}
    e = annotate.enrichment(spark.createDataFrame([("a",), ("b",)], "gene string"), spark.createDataFrame([("a",), ("b",)], "gene string"), 10).first()
    assert (e.overlap, e.fold) == (2, 5.0) and math.isclose(e.p_value, 1 / 45)


HEADER = '##fileformat=VCFv4.2\n##INFO=<ID=CSQ,Number=.,Type=String,Description="x">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\tS3\n'


def test_vcf_scan(spark, tmp_path):
    t = lambda alt, cons, gene: "|".join([alt, cons, "", gene] + [""] * 20 + ["YES"] + [""] * 11 + ["deleterious(0.05)", "benign(0.1)"])
    lines = [
        f"chr1\t100\t.\tA\tT,G\t.\tPASS\tAC=1;CSQ={t('T', 'missense_variant', 'GA')},{t('G', 'stop_gained', 'GA')}\tGT:GQ\t0/1:50\t1|2:40\t./.:50",
        f"23\t5000000\t.\tC\tT\t.\tPASS\tCSQ={t('T', 'intron_variant', 'GX')}\tGT:GQ\t1/1:50\t0/1:10\t0/1:99",
        "2\t7\t.\tC\tT\t.\tPASS\tAC=1\tGT\t0/1\t0/1\t0/1",
    ]
    path = tmp_path / "a.vcf"
    path.write_text(HEADER + "\n".join(lines) + "\n")
    names = vcf.header_samples(spark, str(path))
    pheno, sex = spark.createDataFrame([("S1", 1), ("S2", 0)], "sample_id string, label int"), spark.createDataFrame([("S1", "M")], "sample_id string, sex string")
    got = sorted((r.sample_id, r.chrom, r.alt, r.dosage, r.gene, r.sift, r.polyphen) for r in vcf.parse_calls(vcf.read_lines(spark, str(path)), names, pheno, sex).collect())
    assert names == ["S1", "S2", "S3"] and got == [("S1", "1", "T", 1, "GA", 0.05, 0.1), ("S1", "X", "T", 4, "GX", 0.05, 0.1), ("S2", "1", "G", 1, "GA", 0.05, 0.1), ("S2", "1", "T", 1, "GA", 0.05, 0.1)]
    assert sorted((r.sample_id, r.n_alt) for r in vcf.x_genotypes(vcf.read_lines(spark, str(path)), names).collect()) == [("S1", 2), ("S2", 1), ("S3", 1)]
    clin = tmp_path / "c.vcf"
    clin.write_text("##x\n#CHROM\n1\t5\t.\tA\tT,C\t.\t.\tGENEINFO=BR1:12|Z:1;CLNSIG=Likely_pathogenic\n1\t6\t.\tA\tT\t.\t.\tCLNSIG=Benign\n")
    assert sorted((r.alt, r.gene) for r in vcf.parse_clinical(vcf.read_lines(spark, str(clin))).collect()) == [("C", "BR1"), ("T", "BR1")]
    path.write_text(HEADER.replace("CSQ", "ANN"))
    with pytest.raises(ValueError):
        vcf.header_samples(spark, str(path))


def test_text_tables(spark, tmp_path):
    p = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    ph = tables.phenotypes(spark, p("p.tsv", "# c\nS1\t1\n\nS2\t2\nS1\t2\n"))
    assert {r.sample_id: r.label for r in ph.collect()} == {"S1": 1, "S2": 1}
    with pytest.raises(Exception, match="neither 1 nor 2"):
        tables.phenotypes(spark, p("bad.tsv", "S1\t3\n")).collect()
    assert tables.sex_map(spark, p("s.tsv", "sample_id\tinferred_sex\nS1\tM\nS2\tAMBIGUOUS\n")).count() == 1
    assert tables.covariates(spark, p("c.tsv", "sample_id\tpc1\tPC2\nS1\t0.5\t1\n"), 2).first().pcs == [0.5, 1.0]
    with pytest.raises(ValueError):
        tables.covariates(spark, p("c2.tsv", "sample_id\tPC1\nS1\t1\nS1\t2\n"), 1)
    r = tables.rankings(spark, p("r.csv", "chromosome,position,mean_attribution\n1,5,0.5\n2,6,x\n3,7,0.9\n")).collect()
    assert [(x.variant, x.rank) for x in r] == [("3:7", 1), ("1:5", 2), ("2:6", 3)]
    assert tables.ascending("fdr_gene") and tables.ascending("gene_rank") and not tables.ascending("delta_rank") and not tables.ascending("z")
    g = tables.studies(spark, p("g.tsv", "DISEASE/TRAIT\tMAPPED_GENE\tP-VALUE\nT\tA, B\t1e-9\nT\tC - D\t1e-9\nT\tE\t0.1\nT\tNR\t1e-9\n"))
    assert sorted(x.gene for x in g.collect()) == ["A", "B", "C", "D"]
    go = tables.gene_terms(spark, p("b.tsv", "Gene name\tGO term accession\tGO domain\nA\tGO:1\tP\nA\tGO:2\tF\nB\tx\tP\n"), "P")
    assert [(x.gene, x.terms) for x in tables.term_map(go).collect()] == [("A", ["GO:1"])]
    assert tables.flatten({"A": {"b": 1}, "c": 2}) == {"a.b": 1, "c": 2} and tables.level_of("x/L2_run/y") == "L2" and tables.positive_ints("3, 1,3") == [3, 1]
    gr = tables.gene_rankings(spark, p("gr.csv", "gene_name,gene_score,fdr\nA,1,0.1\nB,x,0.2\nA,3,0.3\n")).collect()
    assert [(x.gene, x.score, x.rank) for x in gr] == [("A", 3.0, 1)]


def test_sinks(spark, tmp_path, calls):
    sinks.write_attributions(calls.select("sample_id", "score"), f"{tmp_path}/a", 4)
    assert sinks.read_sample(spark, f"{tmp_path}/a", "S4", 4).count() == 2
    sinks.write_csv(calls, f"{tmp_path}/c", ["pos", "gene"])
    assert spark.read.csv(f"{tmp_path}/c", header=True).columns == ["pos", "gene"]
    assert sinks.top_k_name("x.csv", 5, True) == "x_topK5.csv" and sinks.top_k_name("x.csv", 5, False) == "x.csv"
    assert "| 1 |" in sinks.markdown(spark.createDataFrame([(1,)], "a int"), "T")


def test_incremental_statistics_of_a_stream(spark, tmp_path, calls):
    calls.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(calls.schema).parquet(f"{tmp_path}/in")
    q = running_statistics(stream).writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = {(r.pos, r.mean_score, r.num_samples) for r in ranking.rank_variants(calls).collect()}
    assert {(r.pos, r.mean_score, r.num_samples) for r in spark.table("running").collect()} == want


def test_entry_works_without_the_training_data_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parent.parent
    for x in ("varloom", "__spark_entry__.py"):
        (shutil.copytree if (repo / x).is_dir() else shutil.copy)(repo / x, tmp_path / x)
    shutil.rmtree(tmp_path / "varloom" / "llm", ignore_errors=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith(('op', 'pipe')) for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert said.stdout.split()[2] == "False" and int(said.stdout.split()[0]) > 70, said.stderr
