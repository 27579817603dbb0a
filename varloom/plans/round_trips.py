"""Queries over text tables: the driver's tables are written as text and read back by the scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.functions import annotation as an
from varloom.functions import genome
from varloom.operators import rollup
from varloom.plans.cohort import calls, read, samples, variants
from varloom.plans.queries import query, ranked, rounded
from varloom.sources import sinks, tables, vcf
from varloom.sources.blocks import write_block_lines
from varloom.sources.scratch import scratch


def write_lines(df: DataFrame, name: str, *columns: Column) -> str:
    path = scratch(df.sparkSession, name)
    df.select(F.concat_ws("\t", *columns).alias("value")).write.text(path)
    return path


def write_table(df: DataFrame, name: str, sep: str = ",") -> str:
    path = scratch(df.sparkSession, name)
    sinks.write_csv(df, path, sep=sep)
    return path


@query("SELECT 'S' || sample_id AS sample_id, label FROM samples")
def phenotype_scan(spark, d):  # noqa: ANN001, ANN201
    path = write_lines(samples(spark, d), "phenotypes", F.concat(F.lit("S"), "sample_id"), (F.col("label") + 1).cast("string"))
    return tables.phenotypes(spark, path)


@query("SELECT 'S' || sample_id AS sample_id, sex FROM samples WHERE sample_id % 7 <> 0")
def sex_map_scan(spark, d):  # noqa: ANN001, ANN201
    s = samples(spark, d).select(F.concat(F.lit("S"), "sample_id").alias("sample_id"), F.when(F.col("sample_id") % 7 == 0, "AMBIGUOUS").otherwise(F.col("sex")).alias("inferred_sex"))
    return tables.sex_map(spark, write_table(s, "sex", "\t"))


@query("SELECT 'S' || sample_id AS sample_id, CASE WHEN sample_id % 5 = 4 THEN NULL ELSE sex END AS sex FROM samples")
def known_sex_scan(spark, d):  # noqa: ANN001, ANN201
    given = F.when(F.col("sample_id") % 5 == 4, "?").when(F.col("sex") == "F", F.element_at(F.array(F.lit("f"), F.lit("Female"), F.lit("2"), F.lit(" FEMALE ")), (F.col("sample_id") % 4 + 1).cast("int")))
    s = samples(spark, d).select(F.concat(F.lit("S"), "sample_id").alias("IID"), F.coalesce(given, F.when(F.col("sample_id") % 3 == 0, "male").when(F.col("sample_id") % 3 == 1, "1").otherwise("M")).alias("SEX"))
    return tables.known_sex(spark, write_table(s, "known", "\t"))


def _pcs(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).select("sample_id", (F.col("sample_id") % 64 / 8).alias("pc2"), (F.col("sample_id") % 32 / 4).alias("PC1"), F.lit(0).alias("PC3"))
    return tables.covariates(spark, write_table(s, "pcs", "\t"), 2).withColumn("sample_id", F.col("sample_id").cast("long"))


@query("SELECT sample_id, CASE sex WHEN 'M' THEN 1.0 ELSE 0.0 END::DOUBLE AS c0, (sample_id % 32 / 4.0)::DOUBLE AS c1, (sample_id % 64 / 8.0)::DOUBLE AS c2 FROM samples")
def covariate_vectors(spark, d):  # noqa: ANN001, ANN201
    rows = rollup.covariate_vectors(samples(spark, d), _pcs(spark, d))
    return rows.select("sample_id", *[F.col("covariates")[i].cast("double").alias(f"c{i}") for i in range(3)])


@query("""SELECT variant, CASE WHEN isinf(score) THEN NULL ELSE round(score, 6) END AS score, row_number() OVER (ORDER BY score DESC, variant)::INTEGER AS rank FROM
(SELECT chrom || ':' || pos AS variant, CASE WHEN pos % 13 = 0 THEN '-inf'::DOUBLE ELSE mean_score END AS score FROM v)""")
def csv_ranking_scan(spark, d):  # noqa: ANN001, ANN201
    v = ranked(spark, d).select(F.col("chrom").alias("chromosome"), F.col("pos").alias("position"), F.when(F.col("pos") % 13 == 0, "n/a").otherwise(F.col("mean_score").cast("string")).alias("mean_attribution"))
    return tables.rankings(spark, write_table(v, "ranking")).select("variant", F.round(F.nullif("score", F.lit(float("-inf"))), 6).alias("score"), "rank")


@query("""SELECT level, variant, round(score, 6) AS score, row_number() OVER (PARTITION BY level ORDER BY score DESC, variant)::INTEGER AS rank FROM
(SELECT 'L1' AS level, chrom || ':' || pos AS variant, mean_score AS score FROM v UNION ALL SELECT 'L2', chrom || ':' || pos, max_score FROM v)""")
def level_ranking_scan(spark, d):  # noqa: ANN001, ANN201
    v = ranked(spark, d).withColumn("variant_id", F.concat_ws(":", "chrom", "pos"))
    args = [f"{k}:{write_table(v.select('variant_id', F.col(c).alias('score')), k)}" for k, c in (("L1", "mean_score"), ("L2", "max_score"))]
    return rounded(tables.ranking_levels(spark, tables.parse_level_args(args)).select("level", "variant", "score", "rank"))


_GENE_SCORES = "SELECT gene, max(score) AS score, count(*) AS n FROM calls GROUP BY gene"


def _gene_scores(spark: SparkSession, d: str) -> DataFrame:
    return calls(spark, d).groupBy("gene").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT gene, score, fdr, row_number() OVER (ORDER BY score DESC, gene)::INTEGER AS rank FROM (SELECT gene, score, CASE WHEN n % 2 = 0 THEN (n % 64 / 64.0)::DOUBLE END AS fdr FROM ({_GENE_SCORES}) WHERE n % 11 <> 0)")
def gene_ranking_scan(spark, d):  # noqa: ANN001, ANN201
    g = _gene_scores(spark, d)
    low = g.select(F.col("gene").alias("gene_name"), (F.col("score") - 1).cast("string").alias("gene_score"), F.lit("0.9").alias("fdr_gene"))
    top = g.select("gene", F.when(F.col("n") % 11 == 0, "bad").otherwise(F.col("score").cast("string")), F.when(F.col("n") % 2 == 0, F.col("n") % 64 / 64).cast("string"))
    return tables.gene_rankings(spark, write_table(low.join(g.where("n % 11 <> 0").select("gene"), F.col("gene") == F.col("gene_name"), "left_semi").union(top), "genes")).select("gene", "score", "fdr", "rank")


@query(f"SELECT gene AS gene_name, rank() OVER (ORDER BY score DESC, gene)::INTEGER AS gene_rank, n::INTEGER AS n_variants FROM ({_GENE_SCORES})")
def gene_list_scan(spark, d):  # noqa: ANN001, ANN201
    g = _gene_scores(spark, d).selectExpr("gene as gene_name", "rank() over (order by score desc, gene) as gene_rank", "n as n_variants")
    return tables.gene_list(spark, write_table(g, "list", "\t"))


@query("SELECT 'S' || sample_id AS sample_id, segment AS gene, coalesce(n, 0)::BIGINT AS burden FROM samples CROSS JOIN (SELECT unnest(['g0', 'g1', 'g2', 'g3']) AS segment) LEFT JOIN (SELECT sample_id, 'g' || (variant_id % 4) AS segment, sum(dosage) AS n FROM calls GROUP BY 1, 2) USING (sample_id, segment)")
def burden_matrix_scan(spark, d):  # noqa: ANN001, ANN201
    c = calls(spark, d).withColumn("g", F.concat(F.lit("g"), F.col("variant_id") % 4)).groupBy("sample_id").pivot("g", ["g0", "g1", "g2", "g3"]).agg(F.sum("dosage"))
    wide = samples(spark, d).select("sample_id").join(c, "sample_id", "left").fillna(0).withColumn("sample_id", F.concat(F.lit("S"), "sample_id"))
    wide.write.parquet(path := scratch(spark, "matrix"))
    return tables.burden_matrix(spark, path)


def _vcf(spark: SparkSession, d: str) -> tuple[str, list[str]]:
    """Parts are records, the nations of customers are samples: a copy a line item, two at most."""
    li = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cell = F.concat(F.when(F.count(F.lit(1)) > 1, "1|1").otherwise("0/1"), F.lit(":"), F.min(F.round(F.col("l_discount") * 1000).cast("int")))
    nations = list(range(25))
    wide = li.groupBy("l_partkey").pivot("c_nationkey", nations).agg(cell).withColumnRenamed("l_partkey", "variant_id").join(variants(spark, d), "variant_id")
    score = lambda word: F.concat(F.lit(f"{word}("), (F.col("variant_id") % 100 / 100).cast("string"), F.lit(")"))
    transcript = lambda at: F.concat_ws("|", *[at.get(i, F.lit("")) for i in range(38)])
    other = transcript({0: F.lit("T"), 1: F.lit("stop_gained"), 3: F.lit("OTHER")})
    mine = transcript({0: F.lit("T"), 1: F.col("consequence"), 3: F.col("gene"), 24: F.lit("YES"), 36: score("tolerated"), 37: score("benign")})
    info = F.concat(F.lit("AC=1;CSQ="), other, F.lit(","), mine, F.lit(";END=1"))
    fields = [F.concat(F.lit("chr"), "chrom"), F.col("pos").cast("string"), F.lit("."), F.lit("C"), F.lit("T"), F.lit("."), F.lit("PASS"), info, F.lit("GT:GQ")]
    cells = F.concat_ws("\t", *fields, *[F.coalesce(F.col(f"`{i}`"), F.lit("./.:.")) for i in nations])
    path = scratch(spark, "calls")
    names = [f"N{i}" for i in nations]
    head = ['##fileformat=VCFv4.2', '##INFO=<ID=CSQ,Number=.,Type=String,Description="annotation">', "\t".join("#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT".split() + names)]
    write_block_lines(wide.select(cells.alias("value")), path, "\n".join(head) + "\n")
    return path, names


@query("""SELECT 'N' || c_nationkey AS sample_id, c_nationkey % 2 AS label, CASE WHEN c_nationkey % 3 = 0 THEN 'F' ELSE 'M' END AS sex, chrom, pos, gene, consequence,
CASE WHEN chrom = 'X' AND c_nationkey % 3 <> 0 AND NOT (pos BETWEEN 60001 AND 2699520) THEN 2 * copies ELSE copies END::INTEGER AS dosage, round(variant_id % 100 / 100.0, 6)::DOUBLE AS sift FROM
(SELECT l_partkey AS variant_id, c_nationkey, least(count(*), 2) AS copies, min(round(l_discount * 1000)) AS gq FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) JOIN variants USING (variant_id)
WHERE gq >= 20 AND c_nationkey < 24 AND NOT (chrom = 'Y' AND c_nationkey % 3 = 0)""")
def vcf_call_scan(spark, d):  # noqa: ANN001, ANN201
    path, _ = _vcf(spark, d)
    names = vcf.header_samples(spark, path)
    n = spark.range(24).select(F.concat(F.lit("N"), "id").alias("sample_id"), (F.col("id") % 2).cast("int").alias("label"), F.when(F.col("id") % 3 == 0, "F").otherwise("M").alias("sex"))
    out = vcf.parse_calls(vcf.read_lines(spark, path), names, n, n)
    return out.select("sample_id", "label", "sex", "chrom", "pos", "gene", "consequence", F.col("dosage").cast("int").alias("dosage"), F.round("sift", 6).alias("sift"))


@query("""SELECT 'N' || c_nationkey AS sample_id, pos, copies::INTEGER AS n_alt FROM (SELECT l_partkey AS variant_id, c_nationkey, least(count(*), 2) AS copies FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
RIGHT JOIN (SELECT variant_id, pos, c_nationkey FROM variants JOIN (SELECT DISTINCT l_partkey AS variant_id FROM lineitem) USING (variant_id) CROSS JOIN (SELECT unnest(range(25))::INTEGER AS c_nationkey) WHERE chrom = 'X' AND NOT (pos BETWEEN 60001 AND 2699520)) USING (variant_id, c_nationkey)""")
def vcf_x_scan(spark, d):  # noqa: ANN001, ANN201
    path, names = _vcf(spark, d)
    return vcf.x_genotypes(vcf.read_lines(spark, path), names).select("sample_id", "pos", F.col("n_alt").cast("int").alias("n_alt"))


_SIG = {0: "Pathogenic", 1: "Benign", 2: "Likely_pathogenic", 3: "Uncertain_significance", 4: "Pathogenic/Likely_pathogenic"}
_SIG_SQL = "CASE variant_id % 5 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _SIG.items()) + " END"


@query(f"SELECT chrom, pos, 'C' AS ref, alt, gene, s AS clinical_significance FROM (SELECT *, {_SIG_SQL} AS s FROM variants) CROSS JOIN (SELECT unnest(['A', 'G']) AS alt) WHERE variant_id % 5 IN (0, 2, 4) AND (alt = 'A' OR variant_id % 2 = 0)")
def clinical_scan(spark, d):  # noqa: ANN001, ANN201
    v = variants(spark, d)
    sig = F.coalesce(*[F.when(F.col("variant_id") % 5 == k, s) for k, s in _SIG.items()])
    info = F.concat(F.lit("AF=0;CLNSIG="), sig, F.lit(";GENEINFO="), F.col("gene"), F.lit(":12|X:1"))
    path = write_lines(v, "clinical", F.concat(F.lit("chr"), "chrom"), F.col("pos").cast("string"), F.lit("."), F.lit("C"), F.when(F.col("variant_id") % 2 == 0, "A,G").otherwise("A"), F.lit("."), F.lit("."), info)
    return vcf.parse_clinical(vcf.read_lines(spark, path))


@query("SELECT gene, 'trait ' || (variant_id % 10) AS disease_trait, min(p)::DOUBLE AS p_value FROM (SELECT *, 1e-9 * (variant_id % 97 + 1) AS p FROM variants) WHERE p < 5e-8 GROUP BY 1, 2 UNION ALL SELECT 'SECOND', 'trait ' || (variant_id % 10), min(p)::DOUBLE FROM (SELECT *, 1e-9 * (variant_id % 97 + 1) AS p FROM variants) WHERE p < 5e-8 AND variant_id % 3 = 0 GROUP BY 2")
def study_scan(spark, d):  # noqa: ANN001, ANN201
    v = variants(spark, d)
    gene = F.when(F.col("variant_id") % 3 == 0, F.concat("gene", F.lit(", SECOND"))).when(F.col("variant_id") % 3 == 1, F.concat("gene", F.lit(" - NR"))).otherwise(F.col("gene"))
    t = v.select(F.concat(F.lit("trait "), F.col("variant_id") % 10).alias("DISEASE/TRAIT"), gene.alias("MAPPED_GENE"), (F.lit(1e-9) * (F.col("variant_id") % 97 + 1)).cast("string").alias("P-VALUE"))
    return tables.studies(spark, write_table(t, "studies", "\t"))


_TERM = "'GO:' || (variant_id % 40)"


@query(f"SELECT gene, array_to_string(list_sort(list(DISTINCT {_TERM})), ' ') AS terms FROM variants WHERE variant_id % 3 < 2 AND variant_id % 7 <> 0 GROUP BY gene HAVING count(DISTINCT {_TERM}) >= 3")
def gene_term_scan(spark, d):  # noqa: ANN001, ANN201
    v = variants(spark, d)
    term = F.concat(F.when(F.col("variant_id") % 7 == 0, "XX:").otherwise("GO:"), F.col("variant_id") % 40)
    code = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("variant_id") % 3 + 1).cast("int"))
    mart = v.select(F.col("gene").alias("Gene name"), term.alias("GO term accession"), F.lit("n").alias("GO term name"), code(["biological_process", "molecular_function", "cellular_component"]).alias("GO domain"))
    blank = F.lit("-")
    gaf = write_lines(v, "gaf", blank, blank, F.col("gene"), blank, term, blank, blank, blank, code("PFC"))
    spark.createDataFrame([("!comment",)], "value string").write.mode("append").text(gaf)
    both = tables.gene_terms(spark, write_table(mart, "mart", "\t"), "PF").intersect(tables.gene_terms(spark, gaf, "PF", "gaf"))
    return tables.term_map(both, 3).select("gene", F.array_join("terms", " ").alias("terms"))


@query("SELECT sample_id, chrom, pos, score FROM calls WHERE chrom NOT IN ('X', 'Y')")
def null_attribution_scan(spark, d):  # noqa: ANN001, ANN201
    c = calls(spark, d).groupBy("sample_id", "label").agg(F.collect_list(F.struct(F.concat(F.lit("chr"), "chrom").alias("c"), "pos", "gene", "score")).alias("x"))
    sinks.write_attributions(c.select("sample_id", "label", F.col("x.c").alias("chroms"), F.col("x.pos").alias("positions"), F.col("x.gene").alias("genes"), F.col("x.score").alias("scores")), path := scratch(spark, "attributions"))
    return tables.null_attributions(spark.read.parquet(path), drop_sex=True).select("sample_id", "chrom", "pos", "score")


@query("SELECT kind, n, round(total, 3) AS total FROM (SELECT 'variants' AS kind, count(*) AS n, sum(mean_score) AS total FROM v UNION ALL SELECT 'top_variants', 100, sum(mean_score) FROM (SELECT mean_score FROM v ORDER BY mean_score DESC, chrom, pos LIMIT 100))")
def ranking_export(spark, d):  # noqa: ANN001, ANN201
    """The exported files, read back: all rows, and the sum of the hundred largest scores."""
    v = ranked(spark, d)
    genes = v.groupBy("gene").agg(F.max("mean_score").alias("gene_score")).selectExpr("gene", "gene_score", "row_number() over (order by gene_score desc, gene) as gene_rank")
    sinks.export_rankings(v, genes, path := scratch(spark, "export"))
    rows = lambda kind: spark.read.csv(f"{path}/cohort_{'variant_rankings' if kind == 'variants' else kind}", header=True).agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("mean_score").cast("double")), 3).alias("total"))
    return rows("variants").union(rows("top_variants"))


@query("SELECT gene, round(max(mean_score), 6) AS gene_score, count(mean_score) AS num_variants FROM v GROUP BY gene")
def null_gene_maxima(spark, d):  # noqa: ANN001, ANN201
    return rounded(rollup.gene_maxima(ranked(spark, d)))


for _how, _sql in (("max", "max"), ("mean", "avg")):

    def _f(spark, d, how=_how):  # noqa: ANN001, ANN202
        v = ranked(spark, d).select("gene", (F.col("mean_score") - F.col("median_score")).alias("delta_rank"))
        return rounded(rollup.with_delta_rank(v.select("gene").distinct(), v, how))

    _f.__name__ = f"delta_rank_rollup_{_how}"
    query(f"SELECT gene, round({_sql}(mean_score - median_score), 6) AS gene_delta_rank, '{_how}' AS gene_delta_rank_aggregation FROM v GROUP BY gene")(_f)


@query("SELECT count(*) AS n_samples, avg(n)::DOUBLE AS mean_variants, max(n)::BIGINT AS max_variants, min(n)::BIGINT AS min_variants, any_value(g) AS n_genes FROM (SELECT sample_id, coalesce(n, 0) AS n FROM samples LEFT JOIN (SELECT sample_id, count(*) AS n FROM calls GROUP BY 1) USING (sample_id)), (SELECT count(DISTINCT gene) AS g FROM calls)")
def sample_statistics(spark, d):  # noqa: ANN001, ANN201
    return rounded(rollup.sample_statistics(samples(spark, d), calls(spark, d)), 9)


@query("SELECT label, count(*) AS n FROM samples GROUP BY label")
def label_distribution(spark, d):  # noqa: ANN001, ANN201
    return rollup.label_distribution(samples(spark, d))


@query("SELECT variant_id, CASE WHEN variant_id % 3 = 0 THEN 'F' WHEN variant_id % 3 = 1 THEN 'M' END AS sex, CASE variant_id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 ELSE -1.0 END::DOUBLE AS code, 'deleterious(' || (variant_id % 100 / 100.0)::DOUBLE || ')' AS text, (variant_id % 100 / 100.0)::DOUBLE AS number FROM variants")
def sex_codes_and_suffixes(spark, d):  # noqa: ANN001, ANN201
    v = variants(spark, d)
    sex = F.when(F.col("variant_id") % 3 == 0, "F").when(F.col("variant_id") % 3 == 1, "M")
    text = F.concat(F.lit("deleterious("), F.col("variant_id") % 100 / 100, F.lit(")"))
    return v.select("variant_id", sex.alias("sex"), an.sex_covariate(sex).alias("code"), text.alias("text"), an.numeric_suffix(F.translate(text, "()", "")).alias("number"))


@query("SELECT build, name, chrom, count(*) FILTER (WHERE pos BETWEEN lo AND hi) AS inside FROM variants, (VALUES ('hg19', 'GRCh37', 60001, 2699520), ('b38', 'GRCh38', 10001, 2781479), ('GRCH37', 'GRCh37', 60001, 2699520)) AS b(build, name, lo, hi) WHERE chrom = 'X' GROUP BY 1, 2, 3")
def build_lookup(spark, d):  # noqa: ANN001, ANN201
    v, out = variants(spark, d).where("chrom = 'X'"), None
    for build in ("hg19", "b38", "GRCH37"):
        one = v.groupBy(F.lit(build).alias("build"), F.lit(genome.build_name(build)).alias("name"), "chrom").agg(F.count_if(genome.in_par(F.col("pos"), F.col("chrom"), build)).alias("inside"))
        out = one if out is None else out.union(one)
    return out


@query("""SELECT chrom AS chromosome, pos AS position, gene AS gene_symbol, round(CASE WHEN pos % 13 = 0 THEN NULL ELSE mean_score END, 6) AS variant_score, (CASE WHEN pos % 17 = 0 THEN NULL ELSE num_samples END)::DOUBLE AS variant_rank FROM v""")
def standardised_scores(spark, d):  # noqa: ANN001, ANN201
    v = ranked(spark, d).select(F.col("chrom").alias("chromosome"), F.col("pos").alias("position"), F.lit(None).cast("string").alias("gene_symbol"), F.col("gene").alias("gene_name"), F.when(F.col("pos") % 13 == 0, "n/a").otherwise(F.col("mean_score").cast("string")).alias("mean_attribution"), F.when(F.col("pos") % 17 == 0, "?").otherwise(F.col("num_samples").cast("string")).alias("rank"))
    return rounded(rollup.standardise_scores(v).select("chromosome", "position", "gene_symbol", "variant_score", "variant_rank"))


@query("SELECT chrom AS chromosome, pos AS position, round((mean_score - avg(mean_score) OVER (PARTITION BY chrom)) / coalesce(nullif(stddev_samp(mean_score) OVER (PARTITION BY chrom), 0), 1), 6) AS variant_score FROM v")
def standardised_z_scores(spark, d):  # noqa: ANN001, ANN201
    v = ranked(spark, d).select(F.col("chrom").alias("chromosome"), F.col("pos").alias("position"), "gene", F.col("mean_score").alias("mean_attribution"))
    return rounded(rollup.standardise_scores(v, "z_attribution").select("chromosome", "position", "variant_score"))


@query("""SELECT pair, arg_min(sample_id, n * 1000000000000 + sample_id) AS sample_id FROM (SELECT variant_id AS pair, pos AS pos1, gene AS gene1, lead(pos) OVER (ORDER BY variant_id) AS pos2, lead(gene) OVER (ORDER BY variant_id) AS gene2 FROM variants)
LEFT JOIN (SELECT a.sample_id, a.pos AS pos1, a.gene AS gene1, b.pos AS pos2, b.gene AS gene2, n FROM (SELECT sample_id, pos, gene FROM calls GROUP BY ALL HAVING count(*) = 1) a JOIN (SELECT sample_id, pos, gene FROM calls GROUP BY ALL HAVING count(*) = 1) b ON a.sample_id = b.sample_id AND b.pos = a.pos + 1000 JOIN (SELECT sample_id, count(*) AS n FROM calls GROUP BY 1) c ON a.sample_id = c.sample_id) USING (pos1, gene1, pos2, gene2)
WHERE pos2 IS NOT NULL GROUP BY pair""")
def pair_carriers(spark, d):  # noqa: ANN001, ANN201
    """Each part and the next by id; ids are dense in the driver's tables."""
    v = variants(spark, d)
    one = v.select(F.col("variant_id").alias("pair"), F.col("pos").alias("pos1"), F.col("gene").alias("gene1"))
    two = v.select((F.col("variant_id") - 1).alias("pair"), F.col("pos").alias("pos2"), F.col("gene").alias("gene2"))
    return rollup.pair_carriers(one.join(two, "pair"), calls(spark, d)).select("pair", "sample_id")


_KIND = "CASE WHEN consequence IN ('stop_gained') THEN 'lof' WHEN contains(consequence, 'missense') THEN 'missense' WHEN contains(consequence, 'synonymous') THEN 'synonymous' ELSE 'other' END"


@query(f"SELECT sample_id, gene, sum(dosage)::BIGINT AS total, {', '.join(f'sum(CASE WHEN k = {k!r} THEN dosage ELSE 0 END)::BIGINT AS {k}' for k in ('lof', 'missense', 'synonymous', 'other'))} FROM (SELECT *, {_KIND} AS k FROM calls) GROUP BY sample_id, gene")
def consequence_matrices(spark, d):  # noqa: ANN001, ANN201
    return rollup.consequence_matrices(calls(spark, d))


@query("SELECT chrom, pos, num_samples, 'most' AS side FROM (SELECT * FROM v ORDER BY num_samples DESC, chrom, pos LIMIT 50) UNION ALL SELECT chrom, pos, num_samples, 'least' FROM (SELECT * FROM v ORDER BY num_samples, chrom, pos LIMIT 50)")
def extremes(spark, d):  # noqa: ANN001, ANN201
    v = ranked(spark, d).select("chrom", "pos", "num_samples")
    return rollup.extremes(v, "num_samples", 50, "chrom", "pos").withColumn("side", F.lit("most")).union(rollup.extremes(v, "num_samples", 50, "chrom", "pos", largest=False).withColumn("side", F.lit("least")))


@query("SELECT gene, n, dense_rank() OVER (ORDER BY n DESC)::INTEGER AS gene_rank FROM (SELECT gene, count(*) AS n FROM variants GROUP BY gene)")
def dense_gene_rank(spark, d):  # noqa: ANN001, ANN201
    return rollup.dense_gene_rank(variants(spark, d).groupBy("gene").agg(F.count(F.lit(1)).alias("n")), "n").select("gene", "n", "gene_rank")


@query("SELECT variant_id, CASE WHEN variant_id % 7 = 0 THEN NULL ELSE -(variant_id % 50)::DOUBLE END AS worth FROM variants")
def metric_order(spark, d):  # noqa: ANN001, ANN201
    v = variants(spark, d).select("variant_id", F.when(F.col("variant_id") % 7 == 0, float("nan")).otherwise(F.col("variant_id") % 50).alias("auc"))
    return v.select("variant_id", F.nullif(rollup.metric_order("auc", True), F.lit(float("inf"))).alias("worth"))


@query("SELECT sample_id, pos, score FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY md5('42:' || sample_id || ':' || variant_id || ':' || score::BIGINT), score) AS r FROM calls) WHERE r <= 12")
def bounded_subset(spark, d):  # noqa: ANN001, ANN201
    c = calls(spark, d).withColumn("key", F.concat_ws(":", "variant_id", F.col("score").cast("long")))
    return rollup.bounded_subset(c, 12, 42, "key").select("sample_id", "pos", "score")


@query("SELECT round(0.01 * avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS penalty FROM embeddings", cohort=False)
def sparsity_penalty(spark, d):  # noqa: ANN001, ANN201
    return rounded(rollup.sparsity_penalty(read(spark, d, "embeddings"), "embedding", 0.01))
