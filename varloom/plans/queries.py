"""The operators bound to the driver's tables: a query and its SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.functions import annotation as an
from varloom.functions import genome, ordered, stats
from varloom.operators import annotate, pairs, ranking
from varloom.operators import cohort as co
from varloom.plans.cohort import SQL as COHORT
from varloom.plans.cohort import calls, read, samples, variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
EDGES = [0.005, 0.01, 0.015, 0.02, 0.05]


def query(sql: str = "", cohort: bool = True):  # noqa: ANN201
    def put(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (COHORT + sql) if cohort else sql
        return f

    return put


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def ranked(spark: SparkSession, d: str, how: str = "mean") -> DataFrame:
    return ranking.rank_variants(calls(spark, d), how)


def mean_ranks(spark: SparkSession, d: str) -> DataFrame:
    """ranked() of the mean with no more columns than chrom, pos, gene, mean_score and rank."""
    return stats.min_rank(ranking.variant_scores(calls(spark, d)).select(*ranking.KEY, "mean_score"), "mean_score", "rank")


_V = "chrom, pos, gene, round(mean_score, 6) AS mean_score, round(max_score, 6) AS max_score, round(median_score, 6) AS median_score, round(std_score, 6) AS std_score, num_samples, round(case_mean, 6) AS case_mean, case_n, round(control_mean, 6) AS control_mean, control_n, round(case_mean - control_mean, 6) AS case_control_diff"
for _how in ("mean", "max"):

    def _f(spark, d, how=_how):  # noqa: ANN001, ANN202
        return rounded(ranked(spark, d, how))

    _f.__name__ = f"variant_ranking_{_how}"
    query(f"SELECT {_V}, round({_how}_score, 6) AS score, rank() OVER (ORDER BY {_how}_score DESC) AS rank FROM v")(_f)


@query(f"""SELECT {_V}, round(a, 6) AS score, rank() OVER (ORDER BY a) AS rank FROM (SELECT *, (
  {" + ".join(f"rank() OVER (ORDER BY {c} DESC) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0" for c in ("mean_score", "max_score", "num_samples"))}) / 3 AS a FROM v)""")
def variant_ranking_rank_average(spark, d):  # noqa: ANN001, ANN201
    return rounded(ranked(spark, d, "rank_average"))


for _how, _agg in (("max", "max(mean_score)"), ("mean", "avg(mean_score)"), ("sum", "sum(mean_score)"), ("size_normalised", "max(mean_score) / sqrt(count(*))")):

    def _g(spark, d, how=_how):  # noqa: ANN001, ANN202
        return rounded(ranking.rank_genes(ranked(spark, d), how))

    _g.__name__ = f"gene_ranking_{_how}"
    query(f"""SELECT gene, round(s, 6) AS gene_score, num_variants, num_samples, t.chrom AS top_chrom, t.pos AS top_pos, floor(rank() OVER (ORDER BY s DESC) + (count(*) OVER (PARTITION BY s) - 1) / 2.0)::BIGINT AS gene_rank
  FROM (SELECT gene, {_agg} AS s, count(*) AS num_variants, sum(num_samples)::BIGINT AS num_samples, first({{'chrom': chrom, 'pos': pos}} ORDER BY mean_score DESC, pos) AS t FROM v GROUP BY gene)""")(_g)


@query(f"""SELECT {_V}, round(mean_score, 6) AS score, rank, floor(rank() OVER (ORDER BY case_mean - control_mean DESC) + (count(*) OVER (PARTITION BY case_mean - control_mean) - 1) / 2.0)::BIGINT AS enrichment_rank
  FROM (SELECT *, rank() OVER (ORDER BY mean_score DESC) AS rank FROM v) WHERE case_n >= 5 AND case_mean - control_mean > 0.1 ORDER BY case_mean - control_mean DESC, chrom, pos, gene LIMIT 100""")
def case_enriched_variants(spark, d):  # noqa: ANN001, ANN201
    return rounded(ranking.case_enriched(ranked(spark, d)))


@query("SELECT sample_id, variant_id, rank, round(score, 6) AS score FROM (SELECT sample_id, variant_id, score, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, variant_id, dosage, null_score) AS rank FROM calls) WHERE rank <= 3")
def top_calls_per_sample(spark, d):  # noqa: ANN001, ANN201
    c = calls(spark, d).withColumn("chrom", F.lpad(F.col("variant_id").cast("string"), 12, "0")).withColumn("pos", F.struct("dosage", "null_score"))
    return rounded(ranking.top_per_sample(c, 3).select("sample_id", "variant_id", "rank", "score"))


_SEV = "CASE consequence WHEN 'stop_gained' THEN 4 WHEN 'missense_variant' THEN 3 WHEN 'missense_variant&splice_region_variant' THEN 3 WHEN 'synonymous_variant' THEN 2 ELSE 1 END"


@query(f"SELECT variant_id, consequence, {_SEV} AS severity, {_SEV} = 4 AS is_lof, CASE WHEN {_SEV} = 4 THEN 'lof' WHEN contains(consequence, 'missense') THEN 'missense' WHEN contains(consequence, 'synonymous') THEN 'synonymous' ELSE 'other' END AS class FROM variants")
def consequence_severity(spark, d):  # noqa: ANN001, ANN201
    s = an.severity(F.col("consequence"))
    return variants(spark, d).select("variant_id", "consequence", s.alias("severity"), (s == 4).alias("is_lof"), an.consequence_class(F.col("consequence")).alias("class"))


@query("SELECT variant_id, x AS chrom, pos BETWEEN 60001 AND 2699520 AND x = 'X' OR pos BETWEEN 10001 AND 2649520 AND x = 'Y' AS in_par, x IN ('X', 'Y') AS is_sex, x NOT IN ('X', 'Y') AS is_autosome FROM (SELECT variant_id, pos, chrom AS x FROM variants)")
def chromosome_predicates(spark, d):  # noqa: ANN001, ANN201
    raw = F.concat(F.lit("chr"), F.when(F.col("chrom") == "X", "23").when(F.col("chrom") == "Y", "24").otherwise(F.col("chrom")))
    v = variants(spark, d).withColumn("chrom", genome.normalise_chrom(raw))
    return v.select("variant_id", "chrom", genome.in_par(F.col("pos"), F.col("chrom")).alias("in_par"), genome.is_sex_chrom(F.col("chrom")).alias("is_sex"), genome.is_autosome(F.col("chrom")).alias("is_autosome"))


@query("SELECT chrom, sex, sum(CASE WHEN chrom = 'X' AND sex = 'M' AND NOT pos BETWEEN 60001 AND 2699520 THEN 2 * dosage ELSE dosage END)::BIGINT AS dosage, count(*) AS n FROM calls WHERE gq >= 20 AND NOT (chrom = 'Y' AND sex = 'F') GROUP BY chrom, sex")
def ploidy_dosage(spark, d):  # noqa: ANN001, ANN201
    c = calls(spark, d).where("gq >= 20").withColumn("dosage", genome.ploidy_dosage(F.col("dosage"), F.col("chrom"), F.col("pos"), F.col("sex"))).where("dosage is not null")
    return c.groupBy("chrom", "sex").agg(F.sum("dosage").alias("dosage"), F.count(F.lit(1)).alias("n"))


@query("SELECT chrom, count(*) AS n, round(avg(1 - coalesce(sift, m)), 6) AS sift, round(avg(coalesce(polyphen, a)), 6) AS polyphen FROM (SELECT *, median(sift) OVER (PARTITION BY chrom) AS m, avg(polyphen) OVER (PARTITION BY chrom) AS a FROM calls) GROUP BY chrom")
def imputed_scores(spark, d):  # noqa: ANN001, ANN201
    c = an.impute_columns(calls(spark, d).select("chrom", "sift", "polyphen"), {"sift": "median", "polyphen": "mean"}, ("chrom",))
    c = c.select("chrom", (1 - F.col("sift")).alias("s"), F.col("polyphen").alias("p"))
    return rounded(c.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("sift"), F.avg("p").alias("polyphen")))


@query(f"SELECT count(*) AS n, count(*) FILTER (WHERE {_SEV} = 4) AS n_lof, count(*) FILTER (WHERE contains(consequence, 'missense')) AS n_missense, count(*) FILTER (WHERE contains(consequence, 'synonymous')) AS n_synonymous, round(count(sift)::DOUBLE / count(*), 6) AS sift_available, round(count(polyphen)::DOUBLE / count(*), 6) AS polyphen_available, round(median(sift), 6) AS median_sift, round(median(polyphen), 6) AS median_polyphen FROM calls")
def annotation_stats(spark, d):  # noqa: ANN001, ANN201
    return rounded(co.annotation_statistics(calls(spark, d).withColumn("severity", an.severity(F.col("consequence")))))


_DIST = "SELECT chrom, count(*) AS n_calls, count(DISTINCT pos) AS n_positions, count(DISTINCT gene) AS n_genes, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS percent FROM calls GROUP BY chrom"


@query(f"SELECT * REPLACE (round(percent, 6) AS percent) FROM ({_DIST})")
def chromosome_distribution(spark, d):  # noqa: ANN001, ANN201
    return rounded(co.chromosome_distribution(calls(spark, d)))


@query(f"SELECT count(*) AS n_chroms, count(*) <= 2 AS too_few, count(*) < 22 AS incomplete, sum(CASE WHEN chrom IN ('1', '2') THEN percent ELSE 0 END) > 50 AS first_two_dominate FROM ({_DIST})")
def chromosome_flags(spark, d):  # noqa: ANN001, ANN201
    return co.distribution_flags(co.chromosome_distribution(calls(spark, d)))


_CARRY = "SELECT chrom, pos, count(*) AS n_carriers, count(*) FILTER (WHERE label = 1) AS n_cases, count(*) FILTER (WHERE label = 0) AS n_controls, min(gene) AS gene FROM (SELECT DISTINCT sample_id, label, chrom, pos, gene FROM calls) GROUP BY chrom, pos"


def _bins(x: str) -> str:
    names = an.maf_labels(EDGES)
    return "CASE " + " ".join(f"WHEN {x} < {e} THEN '{n}'" for e, n in zip(EDGES, names, strict=False)) + f" ELSE '{names[-1]}' END"


@query(f"SELECT *, {_bins('n_carriers::DOUBLE / (SELECT count(*) FROM samples)')} AS bin FROM ({_CARRY})")
def carrier_index(spark, d):  # noqa: ANN001, ANN201
    n = samples(spark, d).agg(F.count(F.lit(1)).alias("n"))
    return pairs.carriers(calls(spark, d)).crossJoin(F.broadcast(n)).withColumn("bin", an.maf_bin(F.col("n_carriers") / F.col("n"), EDGES)).drop("n")


_COOC = f"""top AS (SELECT *, row_number() OVER (ORDER BY n_carriers DESC, chrom, pos) AS i FROM ({_CARRY}) QUALIFY i <= 60),
held AS (SELECT DISTINCT sample_id, i FROM calls JOIN top USING (chrom, pos)),
met AS (SELECT a.i, b.i AS j, count(*) AS n11 FROM held a JOIN held b ON a.sample_id = b.sample_id AND a.i < b.i GROUP BY a.i, b.i),
p AS (SELECT a.chrom AS chrom_a, a.pos AS pos_a, a.gene AS gene_a, b.chrom AS chrom_b, b.pos AS pos_b, b.gene AS gene_b, a.n_carriers AS n_a, b.n_carriers AS n_b, coalesce(n11, 0) AS n11, n AS n_samples, a.n_carriers::DOUBLE / n AS freq_a, b.n_carriers::DOUBLE / n AS freq_b FROM top a JOIN top b ON a.i < b.i LEFT JOIN met ON met.i = a.i AND met.j = b.i, (SELECT count(DISTINCT sample_id) AS n FROM calls)),
c AS (SELECT *, n_a - n11 AS n10, n_b - n11 AS n01, n_samples - n_a - n_b + n11 AS n00, freq_a * freq_b * n_samples AS expected, {_bins("freq_a")} AS bin_a, {_bins("freq_b")} AS bin_b FROM p),
f AS (SELECT *, least(n11, n10, n01, n00) AS min_cell, n11 / expected AS obs_exp_ratio, CASE WHEN least(n11, n10, n01, n00) > 0 THEN 1 / (1.0::DOUBLE / n11 + 1.0::DOUBLE / n10 + 1.0::DOUBLE / n01 + 1.0::DOUBLE / n00) ELSE 0 END AS effective_n FROM c)
"""


def _cooc(spark: SparkSession, d: str) -> DataFrame:
    return pairs.cooccurrence(calls(spark, d), 60, EDGES)


@query(f", {_COOC} SELECT chrom_a, pos_a, chrom_b, pos_b, n11, n10, n01, n00, min_cell, round(expected, 6) AS expected, round(obs_exp_ratio, 6) AS obs_exp_ratio, bin_a, bin_b, round(effective_n, 6) AS effective_n FROM f")
def variant_pair_cooccurrence(spark, d):  # noqa: ANN001, ANN201
    return rounded(_cooc(spark, d).select("chrom_a", "pos_a", "chrom_b", "pos_b", "n11", "n10", "n01", "n00", "min_cell", "expected", "obs_exp_ratio", "bin_a", "bin_b", "effective_n"))


_ORDER = "CASE {} " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(an.maf_labels(EDGES))) + " END"


@query(f""", {_COOC}, o AS (SELECT *, {_ORDER.format("bin_a")} > {_ORDER.format("bin_b")} AS swap FROM f)
SELECT CASE WHEN swap THEN bin_b ELSE bin_a END AS lo, CASE WHEN swap THEN bin_a ELSE bin_b END AS hi, count(*) AS n_pairs, round(avg(n11), 6) AS mean_n11, round(median(n11), 6) AS median_n11, count(*) FILTER (WHERE n11 = 0) AS n_zero, count(*) FILTER (WHERE n11 >= 5) AS n_5, count(*) FILTER (WHERE n11 >= 10) AS n_10, count(*) FILTER (WHERE min_cell >= 5) AS n_cells_5, round(100.0::DOUBLE * avg((n11 >= 5)::INT), 1) AS pct_5, round(100.0::DOUBLE * avg((min_cell >= 5)::INT), 1) AS pct_cells_5 FROM o GROUP BY 1, 2""")
def cooccurrence_by_maf_bin(spark, d):  # noqa: ANN001, ANN201
    return rounded(pairs.by_bin_pair(_cooc(spark, d), EDGES))


@query(f""", {_COOC} SELECT min(n11)::DOUBLE AS min, quantile_cont(n11, 0.25) AS p25, median(n11) AS median, quantile_cont(n11, 0.75) AS p75, max(n11)::DOUBLE AS max, round(avg(n11), 6) AS mean, round(stddev_pop(n11), 6) AS std, round(avg((min_cell >= 5)::INT), 6) AS testable, CASE WHEN median(n11) >= 30 THEN 'sufficient' WHEN median(n11) >= 10 THEN 'limited' ELSE 'insufficient' END AS conclusion FROM f""")
def cooccurrence_summary(spark, d):  # noqa: ANN001, ANN201
    return rounded(pairs.cooccurrence_summary(_cooc(spark, d)))


_TRY = "list_transform(range(1, 65), lambda t: ('0x' || md5('42:' || t)[1:7])::BIGINT)"


def _drawn(chosen: str, most: str) -> str:
    """SQL of the pairs whose numbers a seeded walk draws, by listing all pairs in order."""
    return f"""(SELECT a.chrom AS chrom_a, a.pos AS pos_a, b.chrom AS chrom_b, b.pos AS pos_b, place FROM
  (SELECT x.i, y.i AS j, row_number() OVER (ORDER BY x.i, y.i) - 1 AS number FROM {chosen} x JOIN {chosen} y ON x.i < y.i) p
  JOIN (SELECT nth AS place, (start + nth * step) % every AS number FROM (SELECT every, unnest(range(least({most}, every))) AS nth, {_TRY}[1] % every AS start, coalesce(list_filter({_TRY}, lambda x: x > 1 AND gcd(x, every) = 1)[1], 1) AS step FROM (SELECT count(*) * (count(*) - 1) // 2 AS every FROM {chosen}) WHERE every > 0)) USING (number)
  JOIN {chosen} a ON a.i = p.i JOIN {chosen} b ON b.i = p.j)"""


@query(f""", pl AS (SELECT chrom, pos, n_carriers, row_number() OVER (ORDER BY n_carriers DESC, chrom, pos) AS i FROM ({_CARRY})), hd AS (SELECT * FROM pl WHERE i <= 80),
fw AS (SELECT chrom, pos, k AS i FROM (SELECT chrom, pos, row_number() OVER (ORDER BY ('0x' || md5('42:' || chrom || ':' || pos)[1:13])::BIGINT, chrom, pos) AS k FROM pl WHERE i > 80 AND n_carriers < (SELECT 0.05 * count(*) FROM samples)) WHERE k <= 80)
SELECT 'top' AS part, * FROM {_drawn("hd", "1800")} UNION ALL SELECT 'rare', * FROM {_drawn("fw", "(SELECT 2000 - least(1800, count(*) * (count(*) - 1) // 2) FROM hd)")}""")
def selected_pairs(spark, d):  # noqa: ANN001, ANN201
    n = samples(spark, d).count()
    return pairs.select_pairs(pairs.carriers(calls(spark, d)), 80, 2000, 0.05 * n, 42)


_Z = {q: stats.z_of(q) for q in (0.975, 0.8)}


@query(f""", {_COOC}, m AS (SELECT *, CASE WHEN effective_n > 0 THEN {(_Z[0.975] + _Z[0.8]) * 0.1!r}::DOUBLE / sqrt(effective_n) END AS mde FROM f)
SELECT bin_a, bin_b, count(*) AS n, round(median(n11), 6) AS median_n, round(median(effective_n), 6) AS median_n_eff, round(median(mde), 6) AS median_mde, count(mde) AS n_finite, count(*) FILTER (WHERE mde <= 0.2) AS n_testable FROM m GROUP BY bin_a, bin_b""")
def power_by_maf_bin(spark, d):  # noqa: ANN001, ANN201
    return rounded(pairs.power_by_bin(_cooc(spark, d), 0.1, stats.alpha_threshold(0.05, 100), 0.2))


@query(f""", {_COOC}, m AS (SELECT CASE WHEN effective_n > 0 THEN {(_Z[0.975] + _Z[0.8]) * 0.1!r}::DOUBLE / sqrt(effective_n) END AS mde FROM f)
SELECT count(mde) AS n_finite, round(count(*) FILTER (WHERE mde <= 0.2)::DOUBLE / nullif(count(mde), 0), 6) AS rate_finite, round(count(*) FILTER (WHERE mde <= 0.2)::DOUBLE / count(*), 6) AS rate_all, round(median(mde), 6) AS median_mde FROM m""")
def mde_detection_rates(spark, d):  # noqa: ANN001, ANN201
    p = _cooc(spark, d).withColumn("mde", stats.minimum_effect(F.col("effective_n"), 0.1, 0.05))
    return rounded(pairs.detection_rates(p, 0.2))


@query(f", {_COOC} SELECT round(median(CASE WHEN effective_n > 0 THEN effective_n / n_samples END) FILTER (WHERE least(freq_a, freq_b) >= 0.01), 6) AS effective_fraction, round(median(CASE WHEN n11 > 0 THEN n11::DOUBLE / n_samples END) FILTER (WHERE least(freq_a, freq_b) >= 0.01), 6) AS cooccurrence_rate FROM f")
def common_pair_rates(spark, d):  # noqa: ANN001, ANN201
    return rounded(pairs.common_pair_rates(_cooc(spark, d), 0.01), 6)


@query(f", {_COOC} SELECT round(median(expected / (freq_a * freq_b)))::BIGINT AS n_samples FROM f")
def inferred_cohort_size(spark, d):  # noqa: ANN001, ANN201
    return pairs.infer_cohort_size(_cooc(spark, d))


@query("SELECT round(sqrt(3) * (SELECT stddev_pop(null_score) FROM calls), 6) AS sigma_null, round(sqrt(3) * sqrt((SELECT avg(x) FROM (SELECT var_samp(null_score) AS x FROM calls GROUP BY chrom, pos HAVING count(null_score) >= 2))), 6) AS sigma_within")
def noise_sigma(spark, d):  # noqa: ANN001, ANN201
    return rounded(pairs.noise_sigma(calls(spark, d)))


_GENES = """g AS (SELECT gene, max(mean_score) AS s FROM v GROUP BY gene ORDER BY s DESC, gene LIMIT 40),
q AS (SELECT gene, s, cume_dist() OVER (ORDER BY s) AS q FROM g),
held AS (SELECT DISTINCT sample_id, label, gene FROM calls SEMI JOIN g USING (gene)), n AS (SELECT gene, count(*) AS n FROM held GROUP BY gene),
met AS (SELECT a.gene AS ga, b.gene AS gb, count(*) AS n11, count(*) FILTER (WHERE a.label = 1) AS n_case FROM held a JOIN held b ON a.sample_id = b.sample_id AND a.gene < b.gene GROUP BY a.gene, b.gene),
t AS (SELECT a.gene AS gene_a, b.gene AS gene_b, coalesce(n11, 0) AS n_cooccur, coalesce(n_case, 0) AS n_case, na.n AS n_a, nb.n AS n_b, sqrt(a.q * b.q) * ln(1 + coalesce(n11, 0)) AS interaction_score, (SELECT count(DISTINCT sample_id) FROM calls) AS n FROM q a JOIN q b ON a.gene < b.gene JOIN n na ON na.gene = a.gene JOIN n nb ON nb.gene = b.gene LEFT JOIN met ON ga = a.gene AND gb = b.gene),
x AS (SELECT *, (SELECT sum(exp(lgamma(n_a + 1) - lgamma(k + 1) - lgamma(n_a - k + 1) + lgamma(n - n_a + 1) - lgamma(n_b - k + 1) - lgamma(n - n_a - n_b + k + 1) - lgamma(n + 1) + lgamma(n_b + 1) + lgamma(n - n_b + 1))) FROM (SELECT unnest(range(n_cooccur, least(n_a, n_b) + 1)) AS k)) AS p FROM t),
y AS (SELECT *, least(p, 1) AS pv, row_number() OVER (ORDER BY least(p, 1)) AS r, count(*) OVER () AS m FROM x),
z AS (SELECT *, least(1, min(pv * m / r) OVER (ORDER BY pv DESC RANGE UNBOUNDED PRECEDING)) AS adj FROM y)
"""


def _top_genes(spark: SparkSession, d: str) -> DataFrame:
    g = ranking.variant_scores(calls(spark, d)).groupBy("gene").agg(F.max("mean_score").alias("score"))
    return g.orderBy(F.desc("score"), "gene").limit(40)


def _gene_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.gene_interactions(calls(spark, d), _top_genes(spark, d))


@query(f", {_GENES} SELECT gene_a, gene_b, n_cooccur, n_case, n_a, n_b, round(pv, 6) AS p_value, round(interaction_score, 6) AS interaction_score, round(adj, 6) AS p_adjusted, adj < 0.05 AS reject FROM z")
def gene_pair_interactions(spark, d):  # noqa: ANN001, ANN201
    p = _gene_pairs(spark, d)
    return p.select("gene_a", "gene_b", "n_cooccur", "n_case", "n_a", "n_b", F.round("p_value", 6).alias("p_value"), F.round("interaction_score", 6).alias("interaction_score"), F.round("p_adjusted", 6).alias("p_adjusted"), "reject")


@query(f", {_GENES} SELECT gene, count(*) AS degree, round(sum(interaction_score), 3) AS strength FROM (SELECT unnest([gene_a, gene_b]) AS gene, interaction_score FROM z WHERE n_cooccur >= 20) GROUP BY gene")
def gene_network_nodes(spark, d):  # noqa: ANN001, ANN201
    return rounded(pairs.network_nodes(_gene_pairs(spark, d).where("n_cooccur >= 20").withColumn("weight", F.col("interaction_score"))), 3)


@query(f", {_COOC} SELECT least(gene_a, gene_b) AS gene_a, greatest(gene_a, gene_b) AS gene_b, count(*) AS n_variant_pairs, round(avg(n11), 6) AS mean_n11 FROM f GROUP BY 1, 2")
def variant_to_gene_pairs(spark, d):  # noqa: ANN001, ANN201
    return rounded(pairs.rollup_pairs(_cooc(spark, d)))


@query("SELECT gene, round(s, 6) AS score, round(CASE WHEN s > 0 THEN cume_dist() OVER (PARTITION BY s > 0 ORDER BY s) ELSE 0 END, 6) AS quantile FROM (SELECT gene, avg(mean_score) - 3700 AS s FROM v GROUP BY gene)")
def rank_quantile(spark, d):  # noqa: ANN001, ANN201
    g = ranked(spark, d).groupBy("gene").agg((F.avg("mean_score") - 3700).alias("score"))
    return stats.rank_quantile(g, "score", "quantile", "gene").select("gene", F.round("score", 6).alias("score"), F.round("quantile", 6).alias("quantile"))


_ZS = "zs AS (SELECT chrom, pos, gene, (mean_score - avg(mean_score) OVER w) / coalesce(nullif(stddev_samp(mean_score) OVER w, 0), 1) AS z_score FROM v WINDOW w AS (PARTITION BY chrom))"


@query(f", {_ZS} SELECT chrom, pos, gene, round(z_score, 6) AS z_score, rank() OVER (ORDER BY z_score DESC) AS corrected_rank FROM zs WHERE chrom NOT IN ('X', 'Y')")
def chromosome_zscore(spark, d):  # noqa: ANN001, ANN201
    return rounded(ranking.chromosome_z(ranked(spark, d), drop_sex=True).select("chrom", "pos", "gene", "z_score", "corrected_rank"))


@query(f", {_ZS} SELECT gene, round(g, 6) AS gene_z, round(m, 6) AS mean_z, num_variants, top_pos, row_number() OVER (ORDER BY g DESC, gene) AS gene_rank FROM (SELECT gene, max(z_score) AS g, avg(z_score) AS m, count(*) AS num_variants, first(pos ORDER BY z_score DESC, pos) AS top_pos FROM zs GROUP BY gene)")
def corrected_gene_rankings(spark, d):  # noqa: ANN001, ANN201
    return rounded(ranking.corrected_genes(ranking.chromosome_z(ranked(spark, d))))


def _means(spark: SparkSession, d: str, score: str) -> DataFrame:
    return calls(spark, d).groupBy("chrom", "pos").agg(F.avg(score).alias("score"))


_P = """r AS (SELECT chrom, pos, avg(score) AS score FROM calls GROUP BY chrom, pos), nl AS (SELECT avg(null_score) AS score FROM calls GROUP BY chrom, pos),
e AS (SELECT *, ((SELECT count(*) FROM nl WHERE nl.score >= r.score) + 1)::DOUBLE / ((SELECT count(*) FROM nl) + 1) AS p FROM r),
b AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS q FROM e), c AS (SELECT *, least(1, min(q) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS fdr FROM b)"""


def _both_means(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """_means() of score and of null_score by one pass over the calls."""
    t = ordered.written(calls(spark, d).groupBy("chrom", "pos").agg(F.avg("score").alias("score"), F.avg("null_score").alias("null_score")))
    return t.select("chrom", "pos", "score"), t.select("chrom", "pos", F.col("null_score").alias("score"))


def _contrast(spark: SparkSession, d: str) -> DataFrame:
    return ranking.null_contrast(*_both_means(spark, d))


@query(f", {_P} SELECT chrom, pos, round(score, 6) AS score, round(p, 6) AS p_value, round(fdr, 6) AS fdr FROM c")
def null_contrast(spark, d):  # noqa: ANN001, ANN201
    return rounded(_contrast(spark, d), 6)


@query(f", {_P} SELECT count(*) AS n, count(*) FILTER (WHERE fdr < 0.05) AS n_fdr_05, count(*) FILTER (WHERE fdr < 0.01) AS n_fdr_01, count(*) FILTER (WHERE fdr < 0.001) AS n_fdr_001, round(min(p), 6) AS min_p FROM c")
def significance_counts(spark, d):  # noqa: ANN001, ANN201
    return rounded(ranking.significance_counts(_contrast(spark, d)), 6)


@query(f", {_P}, t AS (SELECT quantile_cont(score, 0.95) AS a, quantile_cont(score, 0.99) AS b, quantile_cont(score, 0.999) AS c FROM nl) SELECT chrom, pos, round(r.score, 6) AS score, r.score > a AS exceeds_null_p05, r.score > b AS exceeds_null_p01, r.score > c AS exceeds_null_p001 FROM r, t")
def null_thresholds(spark, d):  # noqa: ANN001, ANN201
    return rounded(ranking.flag_against_null(*_both_means(spark, d)))


for _m, _a in (("none", "p"), ("bonferroni", "least(1, p * count(*) OVER ())"), ("fdr_bh", "fdr")):

    def _c(spark, d, m=_m):  # noqa: ANN001, ANN202
        t = stats.empirical_p(*_both_means(spark, d), "score")
        return rounded(stats.correct(t, "p_value", m).select("chrom", "pos", "p_adjusted", "reject"), 6)

    _c.__name__ = f"correction_{_m}"
    query(f", {_P} SELECT chrom, pos, round({_a}, 6) AS p_adjusted, {_a} < 0.05 AS reject FROM c")(_c)


@query("SELECT gene, round(s, 6) AS gene_score, n_variants, chromosome, row_number() OVER (ORDER BY s DESC, gene) AS gene_rank FROM (SELECT gene, max(mean_score) AS s, count(*) AS n_variants, first(chrom ORDER BY pos) AS chromosome FROM v WHERE chrom NOT IN ('X', 'Y') GROUP BY gene)")
def gene_list(spark, d):  # noqa: ANN001, ANN201
    return rounded(ranking.gene_list(ranked(spark, d), "mean_score"))


@query("""SELECT * REPLACE (round(selection_score, 6) AS selection_score, round(raw_score, 6) AS raw_score) FROM (SELECT gene, raw AS raw_score, n_significant, coalesce(ms, raw) AS selection_score, row_number() OVER (ORDER BY coalesce(ms, raw) DESC, n_significant DESC, raw DESC, gene) AS selected_rank FROM
  (SELECT gene, max(mean_score) AS raw, count(*) FILTER (WHERE mean_score > 4000) AS n_significant, max(median_score) FILTER (WHERE mean_score > 4000) AS ms FROM v GROUP BY gene)) WHERE selected_rank <= 50""")
def selected_genes(spark, d):  # noqa: ANN001, ANN201
    v = ranked(spark, d)
    support = ranking.gene_support(v.select("gene", F.col("median_score").alias("score"), "mean_score"), F.col("mean_score") > 4000)
    return rounded(ranking.select_genes(ranking.rank_genes(v), support, 50).select("gene", "raw_score", "n_significant", "selection_score", "selected_rank"))


_LEVELS = {"L0": "avg(score)", "L1": "max(score)", "L2": "avg(score) + max(score)", "L3": "avg(null_score)"}


def _levels(spark: SparkSession, d: str) -> DataFrame:
    c = calls(spark, d).groupBy("variant_id").agg(*[F.expr(e).alias(k) for k, e in _LEVELS.items()]).unpivot("variant_id", list(_LEVELS), "level", "score")
    return c.withColumn("rank", stats.position_rank(F.desc("score"), F.asc("variant_id"), by=("level",))).withColumnRenamed("variant_id", "variant")


_L = "lv AS (SELECT level, variant_id AS variant, row_number() OVER (PARTITION BY level ORDER BY score DESC, variant_id) AS rank FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS level, variant_id, {e} AS score FROM calls GROUP BY variant_id" for k, e in _LEVELS.items()) + "))"


@query(f""", {_L}, t AS (SELECT level, variant, k FROM lv, (SELECT unnest([50, 200]) AS k) WHERE rank <= k)
SELECT k::INTEGER AS k, a.level AS level_a, b.level AS level_b, count(*) FILTER (WHERE a.variant = b.variant) AS n_both, any_value(2 * (SELECT count(*) FROM lv WHERE level = 'L0' AND rank <= k)) - count(*) FILTER (WHERE a.variant = b.variant) AS n_either,
round(count(*) FILTER (WHERE a.variant = b.variant)::DOUBLE / (any_value(2 * (SELECT count(*) FROM lv WHERE level = 'L0' AND rank <= k)) - count(*) FILTER (WHERE a.variant = b.variant)), 4) AS jaccard FROM t a JOIN t b USING (k) WHERE a.level < b.level GROUP BY ALL""")
def jaccard_topk(spark, d):  # noqa: ANN001, ANN201
    return ranking.level_jaccard(_levels(spark, d), (50, 200))


@query(f", {_L} SELECT level, variant, rank::INTEGER AS rank FROM lv a WHERE rank <= 100 AND NOT EXISTS (SELECT 1 FROM lv b WHERE b.variant = a.variant AND b.level <> a.level AND b.rank <= 300)")
def level_specific_variants(spark, d):  # noqa: ANN001, ANN201
    return ranking.level_specific(_levels(spark, d), 100, 300)


_SETS = "sets AS (SELECT DISTINCT 'set_' || (length(gene) % 2) AS set_name, gene FROM variants WHERE contains(gene, 'Brand#1') OR length(gene) % 3 = 0)"


def _gene_sets(spark: SparkSession, d: str) -> DataFrame:
    g = variants(spark, d).where(F.col("gene").contains("Brand#1") | (F.length("gene") % 3 == 0))
    return g.select(F.concat(F.lit("set_"), (F.length("gene") % 2).cast("string")).alias("set_name"), "gene").distinct()


_CLASS = f"CASE WHEN {_SEV} = 4 THEN 'lof' WHEN contains(consequence, 'missense') THEN 'missense' WHEN contains(consequence, 'synonymous') THEN 'synonymous' ELSE 'other' END"


@query(f""", {_SETS}, h AS (SELECT sample_id, set_name, dosage, gene, {_CLASS} AS class FROM calls JOIN sets USING (gene)),
b AS (SELECT sample_id, set_name, sum(dosage) AS burden, {", ".join(f"sum(CASE WHEN class = '{c}' THEN dosage ELSE 0 END) AS burden_{c}" for c in ("lof", "missense", "synonymous", "other"))}, count(DISTINCT gene) AS genes_hit FROM h GROUP BY ALL)
SELECT sample_id, set_name, label, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("burden", "burden_lof", "burden_missense", "burden_synonymous", "burden_other", "genes_hit"))} FROM samples CROSS JOIN (SELECT DISTINCT set_name FROM sets) LEFT JOIN b USING (sample_id, set_name)""")
def burden_by_gene_set(spark, d):  # noqa: ANN001, ANN201
    return co.burden(calls(spark, d), samples(spark, d), _gene_sets(spark, d))


@query("SELECT sample_id, gene, sum(dosage)::BIGINT AS burden FROM calls GROUP BY sample_id, gene")
def gene_burden_matrix(spark, d):  # noqa: ANN001, ANN201
    return co.gene_matrix(calls(spark, d))


@query(f", {_SETS} SELECT sample_id, label, coalesce(b, 0)::BIGINT AS burden FROM samples LEFT JOIN (SELECT sample_id, sum(dosage) AS b FROM calls SEMI JOIN sets USING (gene) GROUP BY sample_id) USING (sample_id)")
def gene_set_burden(spark, d):  # noqa: ANN001, ANN201
    return co.set_burden(co.gene_matrix(calls(spark, d)), samples(spark, d), _gene_sets(spark, d))


@query("""SELECT chrom, n1, n0, (tie)::BIGINT AS tie_term, s - n1 * (n1 + 1) / 2.0 AS u, round((s - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) AS auc FROM (SELECT chrom, count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0, sum(r) FILTER (WHERE label = 1) AS s, sum(t * t - 1) AS tie FROM (SELECT chrom, label, rank() OVER (PARTITION BY chrom ORDER BY x) + (count(*) OVER (PARTITION BY chrom, x) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY chrom, x) AS t FROM (SELECT chrom, label, round(score) AS x FROM calls)) GROUP BY chrom)""")
def mann_whitney_u(spark, d):  # noqa: ANN001, ANN201
    return stats.mann_whitney_u(calls(spark, d).select("chrom", "label", F.round("score").alias("x")), "x", "label", ("chrom",)).withColumn("auc", F.round("auc", 6))


@query()
def mann_whitney_p(spark, d):  # noqa: ANN001, ANN201
    return stats.mann_whitney_p(mann_whitney_u(spark, d), "greater").withColumn("p_value", F.round("p_value", 6))


@query(""", s AS (SELECT score AS x, 1 AS g FROM calls UNION ALL SELECT null_score, 0 FROM calls),
c AS (SELECT x, sum(g) AS a, sum(1 - g) AS b FROM s GROUP BY x), r AS (SELECT sum(a) OVER (ORDER BY x)::DOUBLE / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY x)::DOUBLE / sum(b) OVER () AS fb FROM c) SELECT round(max(abs(fa - fb)), 6) AS ks FROM r""")
def ks_statistic(spark, d):  # noqa: ANN001, ANN201
    c = calls(spark, d)
    both = c.select(F.col("score").alias("x"), F.lit(1).alias("g")).union(c.select("null_score", F.lit(0)))
    return stats.ks_statistic(both, "x", "g").select(F.round("ks", 6).alias("ks"))


@query("""SELECT gene, round(CASE WHEN n * n > 1000000 THEN null_median - score_median ELSE shift END, 6) AS shift FROM (SELECT gene, count(*) AS n, median(null_score) AS null_median, median(score) AS score_median FROM calls GROUP BY gene)
LEFT JOIN (SELECT a.gene, median(a.null_score - b.score) AS shift FROM calls a JOIN calls b ON a.gene = b.gene WHERE a.gene IN (SELECT gene FROM calls GROUP BY gene HAVING count(*) <= 1000) GROUP BY a.gene) USING (gene)""")
def hodges_lehmann(spark, d):  # noqa: ANN001, ANN201
    """Every call of a gene; beyond 1,000,000 pairs the reference's difference of medians."""
    return rounded(stats.hodges_lehmann(calls(spark, d), "null_score", "score", "gene"))


@query("SELECT perm, sample_id, label FROM (SELECT perm, sample_id, row_number() OVER (PARTITION BY perm ORDER BY sample_id) AS r FROM samples, (SELECT unnest([0, 1]) AS perm)) JOIN (SELECT perm, label, row_number() OVER (PARTITION BY perm ORDER BY md5(seed || ':' || sample_id), sample_id) AS r FROM samples, (SELECT unnest([0, 1]) AS perm, unnest([42, 43]) AS seed)) USING (perm, r)")
def label_permutation(spark, d):  # noqa: ANN001, ANN201
    return co.permute_labels(samples(spark, d), [42, 43])


@query("SELECT sample_id, label, sex, ((row_number() OVER (PARTITION BY label ORDER BY md5('42:' || sample_id), sample_id) - 1) % 5)::INTEGER AS fold FROM samples")
def stratified_folds(spark, d):  # noqa: ANN001, ANN201
    return co.stratified_folds(samples(spark, d), 5, 42)


@query("""SELECT outer_fold::INTEGER AS outer_fold, sample_id, ((row_number() OVER (PARTITION BY outer_fold, label ORDER BY md5('43:' || sample_id), sample_id) - 1) % 3)::INTEGER AS inner_fold FROM (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5('42:' || sample_id), sample_id) - 1) % 5 AS own FROM samples) JOIN (SELECT unnest(range(5)) AS outer_fold) ON own <> outer_fold""")
def nested_folds(spark, d):  # noqa: ANN001, ANN201
    return co.nested_folds(samples(spark, d), 5, 3, 42)


@query("SELECT sample_id, label, sex, row_number() OVER (PARTITION BY label ORDER BY md5('7:' || sample_id), sample_id) <= floor(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE) AS is_val FROM samples")
def validation_split(spark, d):  # noqa: ANN001, ANN201
    return co.validation_split(samples(spark, d), 0.2, 7)


@query("SELECT perm::INTEGER AS perm, gene FROM (SELECT perm, gene, row_number() OVER (PARTITION BY perm ORDER BY md5('5:' || perm || ':' || gene), gene) AS r FROM (SELECT DISTINCT gene FROM variants), (SELECT unnest(range(50)) AS perm)) WHERE r <= 20")
def random_gene_sets(spark, d):  # noqa: ANN001, ANN201
    return co.random_gene_sets(variants(spark, d), 20, 50, 5)


_M = "((({} % 2147483647) * 1000003 + 7919) % 2147483647)"
_BOOT = f"""n AS (SELECT count(*) AS n FROM samples), ix AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS i FROM samples),
w AS (SELECT rep, i, count(*) AS weight FROM (SELECT rep, {_M.format(_M.format("(rep * n + i + 1)"))} % n AS i FROM ix, n, (SELECT unnest(range(20)) AS rep)) GROUP BY rep, i),
bw AS (SELECT rep, sample_id, weight FROM w JOIN ix USING (i)), bm AS (SELECT rep, chrom, pos, sum(null_score * weight) / sum(weight) AS m FROM calls JOIN bw USING (sample_id) GROUP BY rep, chrom, pos),
br AS (SELECT rep, chrom, pos, rank() OVER (PARTITION BY rep ORDER BY m DESC) + (count(*) OVER (PARTITION BY rep, m) - 1) / 2.0::DOUBLE AS rank FROM bm),
rr AS (SELECT chrom, pos, gene, rank() OVER (ORDER BY mean_score DESC) AS rank_real FROM v),
g AS (SELECT r.*, coalesce(rank, (SELECT count(*) FROM v) + 1.0) AS rank FROM (SELECT * FROM rr, (SELECT unnest(range(20)) AS rep)) r LEFT JOIN br USING (rep, chrom, pos)),
dr AS (SELECT chrom, pos, gene, rank_real, median(rank)::DOUBLE AS md, quantile_cont(rank::DOUBLE, 0.75) - quantile_cont(rank::DOUBLE, 0.25) AS iqr, count(*) FILTER (WHERE rank <= rank_real) AS k FROM g GROUP BY ALL)"""


@query(f", {_BOOT} SELECT rep, sample_id, weight FROM bw")
def bootstrap_weights(spark, d):  # noqa: ANN001, ANN201
    return co.bootstrap_weights(samples(spark, d), 20)


def _null_ranks(spark: SparkSession, d: str) -> DataFrame:
    return co.bootstrap_ranks(calls(spark, d), co.weight_arrays(samples(spark, d), 20), "null_score", 20)


def _delta(spark: SparkSession, d: str) -> DataFrame:
    real = ordered.written(mean_ranks(spark, d).select("chrom", "pos", "gene", F.col("rank").cast("long").alias("rank")))
    null = _null_ranks(spark, d)
    return co.delta_rank(real, null, 20, real.count()).join(real.select("chrom", "pos", "gene"), ["chrom", "pos"])


@query(f", {_BOOT} SELECT chrom, pos, gene, rank_real, round(md, 6) AS median_null_rank, round(md - rank_real, 6) AS delta_rank, round(iqr, 6) AS iqr, round((k + 1) / 21.0, 6) AS p_value, k = 0 AS at_floor FROM dr")
def bootstrap_delta_rank(spark, d):  # noqa: ANN001, ANN201
    return rounded(_delta(spark, d).withColumn("p_value", F.round("p_value", 6)), 6).withColumn("iqr", F.round("iqr", 6)).withColumn("median_null_rank", F.round("median_null_rank", 6)).withColumn("delta_rank", F.round("delta_rank", 6))


@query(f", {_BOOT} SELECT gene, round(max(md - rank_real), 6) AS gene_delta_rank, median(rank_real) AS median_rank_real, round(median(md), 6) AS median_rank_null, count(*) AS n_variants, count(*) < 2 AS underpowered FROM dr GROUP BY gene")
def gene_delta_rank(spark, d):  # noqa: ANN001, ANN201
    return rounded(co.gene_delta(_delta(spark, d)))


@query(f""", {_BOOT}, u AS (SELECT rep, k, coalesce(r.rank, (SELECT count(*) FROM v) + 1.0)::DOUBLE AS x, coalesce(y, (SELECT count(*) FROM v) + 1.0)::DOUBLE AS y FROM
  (SELECT rep, chrom, pos, rank AS y FROM br UNION ALL SELECT rep, chrom, pos, NULL FROM (SELECT * FROM rr, (SELECT unnest(range(20)) AS rep)) z WHERE NOT EXISTS (SELECT 1 FROM br WHERE br.rep = z.rep AND br.chrom = z.chrom AND br.pos = z.pos)) n LEFT JOIN (SELECT chrom, pos, rank_real AS rank FROM rr) r USING (chrom, pos), (SELECT unnest([50, 200]) AS k)),
pool AS (SELECT * FROM u WHERE least(x, y) <= k), cut AS (SELECT DISTINCT rep, k, unnest([x, y]) AS t FROM pool),
dist AS (SELECT rep, k, t, abs(count(*) FILTER (WHERE x <= t) - count(*) FILTER (WHERE y <= t)) AS d FROM cut JOIN pool USING (rep, k) GROUP BY rep, k, t)
SELECT rep, k, (SELECT count(*) FROM pool p WHERE p.rep = dist.rep AND p.k = dist.k AND x <= k AND y <= k) AS overlap, (SELECT count(*) FROM pool p WHERE p.rep = dist.rep AND p.k = dist.k) AS pool,
  round(max(d)::DOUBLE / (SELECT count(*) FROM pool p WHERE p.rep = dist.rep AND p.k = dist.k), 6) AS ks FROM dist GROUP BY rep, k""")
def replicate_pools(spark, d):  # noqa: ANN001, ANN201
    real = ordered.written(mean_ranks(spark, d).select("chrom", "pos", F.col("rank").cast("double").alias("rank")))
    n = real.count()
    return rounded(co.replicate_pools(real, _null_ranks(spark, d), (50, 200), n, n))


_ERFC = "(SELECT 1 - sign({x}) * list_sum(list_transform(range(0, 150), lambda k: exp((2 * k + 1) * ln(greatest(abs({x}), 1e-12)) - {x} * {x} - lgamma(k + 1.5)))))"
_TAIL = _ERFC.format(x="least(x, 6)")
_GENE_BOOT = """nm AS (SELECT chrom, pos, avg(null_score) AS m FROM calls GROUP BY chrom, pos), nr AS (SELECT chrom, pos, rank() OVER (ORDER BY m DESC) + (count(*) OVER (PARTITION BY m) - 1) / 2.0::DOUBLE AS rank_null FROM nm),
gv AS (SELECT gene, (rank() OVER (ORDER BY mean_score DESC))::DOUBLE AS rank_real, CASE WHEN pos % 11 <> 0 THEN rank_null END AS rank_null, rank_null - rank() OVER (ORDER BY mean_score DESC) AS delta FROM v JOIN nr USING (chrom, pos)),
gs AS (SELECT gene, count(rank_real) AS n1, count(rank_null) AS n0, median(rank_real) AS mr, median(rank_null) AS mn, max(delta) AS gd FROM gv GROUP BY gene),
st AS (SELECT gene, g, rank() OVER (PARTITION BY gene ORDER BY x) + (count(*) OVER (PARTITION BY gene, x) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY gene, x) AS t FROM (SELECT gene, rank_real AS x, 1 AS g FROM gv UNION ALL SELECT gene, rank_null, 0 FROM gv WHERE rank_null IS NOT NULL) SEMI JOIN (SELECT gene FROM gs WHERE least(n1, n0) >= 9) USING (gene)),
us AS (SELECT gene, count(*) FILTER (WHERE g = 1) AS a, count(*) FILTER (WHERE g = 0) AS b, sum(r) FILTER (WHERE g = 1) - a * (a + 1) / 2.0 AS u, sum(t * t - 1) AS tie FROM st GROUP BY gene),
xs AS (SELECT gene, u, (a * b / 2.0 - u - 0.5) / sqrt(a * b / 12.0 * ((a + b + 1) - tie / ((a + b) * (a + b - 1.0)))) / sqrt(2.0) AS x FROM us)"""


@query(f""", {_GENE_BOOT}, ps AS (SELECT gene, u, least(1, {_TAIL} / 2) AS p FROM xs), hs AS (SELECT a.gene, median(b.rank_null - a.rank_real) AS h FROM gv a JOIN gv b ON a.gene = b.gene GROUP BY a.gene),
bs AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS q FROM ps), fs AS (SELECT *, least(1, min(q) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS fdr FROM bs)
SELECT gene, n1 AS n_variants_real, n0 AS n_variants_null, mr AS median_rank_real, mn AS median_rank_null, gd AS gene_delta_rank, least(n1, n0) < 9 AS underpowered, u AS wilcoxon_statistic, round(p, 6) AS wilcoxon_p, CASE WHEN u IS NOT NULL THEN h END AS effect_size_hodges_lehmann, round(fdr, 6) AS fdr_gene_wilcoxon, 'max' AS gene_delta_rank_aggregation FROM gs LEFT JOIN fs USING (gene) LEFT JOIN hs USING (gene)""")
def gene_bootstrap(spark, d):  # noqa: ANN001, ANN201
    """Every eleventh position has no null rank; groups of nine and more take the normal tail on both sides."""
    null = stats.average_rank(_means(spark, d, "null_score"), "score", "rank_null").select("chrom", "pos", "rank_null")
    v = mean_ranks(spark, d).select("chrom", "pos", "gene", F.col("rank").cast("double").alias("rank_real")).join(null, ["chrom", "pos"])
    v = v.withColumn("delta_rank", F.col("rank_null") - F.col("rank_real")).withColumn("rank_null", F.when(F.col("pos") % 11 != 0, F.col("rank_null")))
    return rounded(co.gene_bootstrap(v, "max", 9))


@query("SELECT count(*) FILTER (WHERE a <= 100 AND b <= 100) AS n_both, count(*) FILTER (WHERE a <= 100 OR b <= 100) AS n_either FROM (SELECT rank() OVER (ORDER BY mean_score DESC) AS a, rank() OVER (ORDER BY max_score DESC) AS b FROM v)")
def topk_overlap(spark, d):  # noqa: ANN001, ANN201
    v = ranking.variant_scores(calls(spark, d)).select(*ranking.KEY, "mean_score", "max_score")
    v = stats.min_rank(stats.min_rank(v, "mean_score", "by_mean"), "max_score", "by_max")
    one = lambda c: v.select("chrom", "pos", F.col(c).alias("rank"))
    return co.topk_overlap(one("by_mean"), one("by_max"), 100, ("chrom", "pos"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS l2, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 5) AS l1, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS s, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding), 5) AS m FROM embeddings", False)
def attribution_reductions(spark, d):  # noqa: ANN001, ANN201
    e = F.col("embedding")
    return read(spark, d, "embeddings").select("vec_id", *[F.round(an.reduce_vector(e, k), 5).alias(n) for k, n in (("l2", "l2"), ("l1", "l1"), ("sum", "s"), ("mean", "m"))])


@query("SELECT label, list(round(x, 5) ORDER BY i) AS vector FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i) GROUP BY label", False)
def gene_embedding_mean(spark, d):  # noqa: ANN001, ANN201
    g = co.gene_embeddings(read(spark, d, "embeddings").select("label", F.col("embedding").alias("vector")), "mean", ("label",))
    near = lambda x: F.when((F.round(x, 5) == 0) & (x < 0), F.lit(-0.0)).otherwise(F.round(x, 5))  # noqa: E731  SQL's round keeps the sign of a zero
    return g.withColumn("vector", F.transform("vector", near))


@query("SELECT variant_id, round(sin(pos), 5) AS s0, round(cos(pos), 5) AS c0, round(sin(pos * exp(2.0::DOUBLE * -ln(10000.0::DOUBLE) / 64)), 5) AS s1, 64::INTEGER AS dim FROM variants")
def sinusoidal_encoding(spark, d):  # noqa: ANN001, ANN201
    v = variants(spark, d).withColumn("e", an.sinusoid(F.col("pos")))
    return v.select("variant_id", *[F.round(F.col("e")[i], 5).alias(n) for i, n in enumerate(("s0", "c0", "s1"))], F.size("e").alias("dim"))


@query("""SELECT a.variant_id AS a, b.variant_id AS b, CASE WHEN a.chrom <> b.chrom THEN 32 ELSE CASE WHEN a.pos > b.pos THEN 16 ELSE 0 END + CASE WHEN abs(a.pos - b.pos) < 8 THEN abs(a.pos - b.pos) ELSE least(15, 8 + floor(ln(greatest(abs(a.pos - b.pos), 1) / 8.0::DOUBLE) / ln(12500.0::DOUBLE) * 8)) END END::INTEGER AS bucket FROM variants a JOIN variants b ON b.variant_id BETWEEN a.variant_id - 3 AND a.variant_id + 3""")
def position_buckets(spark, d):  # noqa: ANN001, ANN201
    v = variants(spark, d)
    near = v.select(F.explode(F.sequence(F.col("variant_id") - 3, F.col("variant_id") + 3)).alias("b"), F.col("variant_id").alias("a"), F.col("pos").alias("pa"), F.col("chrom").alias("ca")).join(v.select(F.col("variant_id").alias("b"), F.col("pos").alias("pb"), F.col("chrom").alias("cb")), "b")
    return near.select("a", "b", an.relative_bucket(F.col("pa"), F.col("pb"), F.col("ca"), F.col("cb")).alias("bucket"))


@query("SELECT chrom, round(avg(g), 6) AS mean_gap, median(g) AS median_gap, min(g) AS min_gap, max(g) AS max_gap, round(quantile_cont(g, 0.95), 6) AS p95_gap FROM (SELECT chrom, pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) AS g FROM variants) GROUP BY chrom")
def distance_statistics(spark, d):  # noqa: ANN001, ANN201
    from pyspark.sql import Window

    g = variants(spark, d).select("chrom", (F.col("pos") - F.lag("pos").over(Window.partitionBy("chrom").orderBy("pos"))).alias("g"))
    return rounded(g.groupBy("chrom").agg(F.avg("g").alias("mean_gap"), F.median("g").alias("median_gap"), F.min("g").alias("min_gap"), F.max("g").alias("max_gap"), F.percentile("g", 0.95).alias("p95_gap")))


@query("SELECT sample_id, chunk::INTEGER AS chunk, (chunk * 8)::INTEGER AS start, least(chunk * 8 + 10, n)::INTEGER AS stop, k::INTEGER AS n_chunks FROM (SELECT sample_id, n, k, unnest(range(k)) AS chunk FROM (SELECT sample_id, n, greatest(1, ceil(n / 8.0))::BIGINT AS k FROM (SELECT s.sample_id, count(c.sample_id) AS n FROM samples s LEFT JOIN calls c USING (sample_id) GROUP BY s.sample_id)))")
def chunk_plan(spark, d):  # noqa: ANN001, ANN201
    n = samples(spark, d).select("sample_id").join(calls(spark, d).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")), "sample_id", "left").fillna(0, ["n"])
    return co.chunk_plan(n, 10, 2)


@query("""SELECT sample_id, n_sites, n_het, round(expected, 6) AS expected, round(f, 6) AS f, round(het_rate, 6) AS het_rate, CASE WHEN n_sites < 3 THEN 'INSUFFICIENT' WHEN f > 0.8 AND het_rate > 0.05 THEN 'DISCORDANT' WHEN f > 0.8 THEN 'M' WHEN f < 0.2 THEN 'F' ELSE 'AMBIGUOUS' END AS inferred_sex FROM (
SELECT sample_id, n_sites, n_het, expected, 1 - n_het / expected AS f, n_het::DOUBLE / n_sites AS het_rate FROM (SELECT sample_id, count(*) AS n_sites, count(*) FILTER (WHERE n_alt = 1) AS n_het, sum(e) AS expected FROM x JOIN (SELECT pos, 2 * p * (1 - p) AS e FROM (SELECT pos, sum(n_alt)::DOUBLE / (2 * count(n_alt)) AS p, count(n_alt)::DOUBLE / count(*) AS c FROM x GROUP BY pos) WHERE 1 - c <= 0.1 AND least(p, 1 - p) >= 0.05) USING (pos) WHERE n_alt IS NOT NULL GROUP BY sample_id))""")
def sex_inference(spark, d):  # noqa: ANN001, ANN201
    return rounded(co.infer_sex(_x_calls(spark, d), least=3))


def _x_calls(spark: SparkSession, d: str) -> DataFrame:
    c = calls(spark, d).where("chrom in ('X', 'Y', '1', '2')")
    return c.select("sample_id", "pos", F.when(F.col("gq") > 0, F.col("dosage") - F.when(F.col("gq") > 60, 1).otherwise(0)).alias("n_alt"))


SQL["sex_inference"] = COHORT.rstrip() + ", x AS (SELECT sample_id, pos, CASE WHEN gq > 0 THEN dosage - CASE WHEN gq > 60 THEN 1 ELSE 0 END END AS n_alt FROM calls WHERE chrom IN ('X', 'Y', '1', '2')) " + SQL["sex_inference"][len(COHORT) :]


@query("SELECT " + ", ".join(f"count(*) FILTER (WHERE sex = '{s}' AND label = {v}) AS {'case' if v else 'control'}_{s.lower()}" for s in "MF" for v in (1, 0)) + " FROM samples")
def sex_balance(spark, d):  # noqa: ANN001, ANN201
    return co.sex_balance(samples(spark, d))


@query("SELECT label, count(*) AS n, round(sum(count(*)) OVER () / (2.0::DOUBLE * count(*)), 6) AS weight FROM samples GROUP BY label")
def class_weights(spark, d):  # noqa: ANN001, ANN201
    return co.class_weight(samples(spark, d)).withColumn("weight", F.round("weight", 6))


_ATT = "att AS (SELECT l_orderkey AS sample_id, 0 AS chunk, a.l_linenumber AS i, b.l_linenumber AS j, round(a.l_extendedprice * b.l_discount) / 1000 AS score, a.l_partkey AS pa, b.l_partkey AS pb FROM lineitem a JOIN lineitem b USING (l_orderkey))"


def _attention(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    a = li.select(F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("i"), F.col("l_extendedprice").alias("x"), F.col("l_partkey").alias("pa"))
    b = li.select(F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("j"), F.col("l_discount").alias("y"), F.col("l_partkey").alias("pb"))
    return a.join(b, "sample_id").select("sample_id", F.lit(0).alias("chunk"), "i", "j", (F.round(F.col("x") * F.col("y")) / 1000).alias("score"), "pa", "pb")


@query(f"WITH {_ATT} SELECT sample_id, i, j, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, i, j) AS rank FROM att WHERE i < j AND score > 1) WHERE rank <= 3", False)
def attention_topk(spark, d):  # noqa: ANN001, ANN201
    return rounded(pairs.top_attention(_attention(spark, d), 3, 1.0).select("sample_id", "i", "j", "score", "rank"))


@query(f"WITH {_ATT} SELECT sample_id, i, round(-sum(score * ln(score + 1e-10)), 3) AS entropy FROM att GROUP BY sample_id, i", False)
def attention_entropy(spark, d):  # noqa: ANN001, ANN201
    return rounded(pairs.attention_entropy(_attention(spark, d)), 3)


@query()
def interactions_across_samples(spark, d):  # noqa: ANN001, ANN201
    a = _attention(spark, d).where("i < j").select("sample_id", F.lit("1").alias("chrom_a"), F.lit("1").alias("chrom_b"), (F.col("pa") % 50).alias("pos_a"), (F.col("pb") % 50).alias("pos_b"), (F.col("pa") % 5).alias("gene_a"), (F.col("pb") % 5).alias("gene_b"), "score")
    return rounded(pairs.interactions_across_samples(a), 8)


SQL["interactions_across_samples"] = f"""WITH {_ATT}, e AS (SELECT sample_id, score, least(pa % 50, pb % 50) AS lo, greatest(pa % 50, pb % 50) AS hi FROM att WHERE i < j)
SELECT '1' AS chrom_a, lo AS pos_a, lo % 5 AS gene_a, '1' AS chrom_b, hi AS pos_b, hi % 5 AS gene_b, count(DISTINCT sample_id) AS n_samples, count(*) AS n_occurrences, round(avg(score), 8) AS mean_score, round(max(score), 6) AS max_score, lo % 5 = hi % 5 AS same_gene, hi - lo AS distance FROM e GROUP BY lo, hi HAVING count(DISTINCT sample_id) >= 2"""


@query("SELECT sample_id, variant_id, round(y, 6) AS synergy, CASE WHEN abs(y) <= 0.01 THEN 'independent' WHEN y > 0 THEN 'synergistic' ELSE 'antagonistic' END AS kind, abs(y) > 0.05 AS significant FROM (SELECT sample_id, variant_id, coalesce(polyphen, 0) - coalesce(sift, 0) - dosage / 4.0::DOUBLE + gq / 100.0::DOUBLE AS y FROM calls)")
def counterfactual_synergy(spark, d):  # noqa: ANN001, ANN201
    s, kind, sig = pairs.synergy(F.col("gq") / F.lit(100.0), F.coalesce("sift", F.lit(0.0)), F.col("dosage") / F.lit(4.0), F.coalesce("polyphen", F.lit(0.0)))
    exact = F.round(s, 9)
    return calls(spark, d).select("sample_id", "variant_id", F.round(exact, 6).alias("synergy"), F.when(F.abs(exact) <= 0.01, "independent").otherwise(kind).alias("kind"), (F.abs(exact) > 0.05).alias("significant"))


SQL["counterfactual_synergy"] = SQL["counterfactual_synergy"].replace("SELECT sample_id, variant_id, coalesce(polyphen", "SELECT sample_id, variant_id, round(coalesce(polyphen").replace("gq / 100.0::DOUBLE AS y", "gq / 100.0::DOUBLE, 9) AS y")

_CLIN = "clin AS (SELECT 'chr' || chrom AS chrom, pos, CASE WHEN variant_id % 2 = 0 THEN 'Pathogenic' ELSE 'Likely_pathogenic' END AS clinical_significance FROM variants WHERE variant_id % 3 = 0)"


@query(f", {_CLIN} SELECT chrom, pos, gene, rank, significance, significance IS NOT NULL AS in_clinical FROM (SELECT a.*, c.clinical_significance AS significance FROM (SELECT chrom, pos, gene, rank() OVER (ORDER BY mean_score DESC) AS rank FROM v ORDER BY rank, chrom, pos LIMIT 100) a LEFT JOIN clin c ON c.chrom = 'chr' || a.chrom AND c.pos = a.pos)")
def clinvar_match(spark, d):  # noqa: ANN001, ANN201
    k = variants(spark, d).where("variant_id % 3 = 0").select(F.concat(F.lit("chr"), "chrom").alias("chrom"), "pos", F.when(F.col("variant_id") % 2 == 0, "Pathogenic").otherwise("Likely_pathogenic").alias("clinical_significance"))
    return annotate.match_clinical(ranked(spark, d).select("chrom", "pos", "gene", "rank"), k)


@query("""SELECT gene, gene_rank, coalesce(n, 0) AS n_studies, traits, coalesce(n, 0) > 0 AS in_studies FROM (SELECT gene, floor(rank() OVER (ORDER BY s DESC))::BIGINT AS gene_rank FROM (SELECT gene, max(mean_score) AS s FROM v GROUP BY gene) ORDER BY gene_rank, gene LIMIT 50)
LEFT JOIN (SELECT upper(gene) AS g, count(*) AS n, array_to_string(list_sort(list(DISTINCT trait))[1:5], '; ') AS traits FROM (SELECT gene, consequence || ' ' || (variant_id % 4) AS trait FROM variants WHERE variant_id % 7 = 0) WHERE regexp_matches(trait, '(?i)VARIANT|stop') GROUP BY g) ON g = upper(gene)""")
def gwas_match(spark, d):  # noqa: ANN001, ANN201
    s = variants(spark, d).where("variant_id % 7 = 0").select(F.lower("gene").alias("gene"), F.concat_ws(" ", "consequence", (F.col("variant_id") % 4).cast("string")).alias("disease_trait"))
    return annotate.match_studies(ranking.rank_genes(ranked(spark, d)).select("gene", "gene_rank"), s, ["VARIANT", "stop"])


_GO = """u AS (SELECT DISTINCT gene FROM variants), mine AS (SELECT gene FROM (SELECT gene, max(mean_score) AS s FROM v GROUP BY gene ORDER BY s DESC, gene LIMIT 40)),
tm AS (SELECT DISTINCT gene, 'GO:' || (variant_id % 60) AS term FROM variants), k AS (SELECT count(*) AS n FROM u),
o AS (SELECT term, count(*) AS n_term, count(*) FILTER (WHERE gene IN (SELECT gene FROM mine)) AS overlap FROM tm GROUP BY term HAVING count(*) BETWEEN 3 AND 500),
x AS (SELECT *, n AS total, (SELECT count(*) FROM mine) AS n_genes FROM o, k WHERE overlap > 0),
p AS (SELECT *, least(1, (SELECT sum(exp(lgamma(n_genes + 1) - lgamma(i + 1) - lgamma(n_genes - i + 1) + lgamma(total - n_genes + 1) - lgamma(n_term - i + 1) - lgamma(total - n_genes - n_term + i + 1) - lgamma(total + 1) + lgamma(n_term + 1) + lgamma(total - n_term + 1))) FROM (SELECT unnest(range(overlap, least(n_genes, n_term) + 1)) AS i))) AS pv FROM x),
b AS (SELECT *, least(1, min(q) OVER (ORDER BY pv DESC RANGE UNBOUNDED PRECEDING)) AS fdr FROM (SELECT *, pv * count(*) OVER () / row_number() OVER (ORDER BY pv) AS q FROM p))"""


@query(f", {_GO} SELECT term, n_term, overlap, total::INTEGER AS total, n_genes, round(pv, 6) AS p_value, round(fdr, 6) AS fdr FROM b")
def go_enrichment(spark, d):  # noqa: ANN001, ANN201
    t = variants(spark, d).select("gene", F.concat(F.lit("GO:"), (F.col("variant_id") % 60).cast("string")).alias("term"))
    return rounded(annotate.term_enrichment(_top_genes(spark, d), t, variants(spark, d)), 6)


@query(f", {_GO}, known AS (SELECT DISTINCT gene FROM tm WHERE term = 'GO:7') SELECT f AS n_found, k AS n_known, o AS overlap, 500::INTEGER AS total, round(o * 500.0::DOUBLE / (f * k), 6) AS fold, round((SELECT sum(exp(lgamma(f + 1) - lgamma(i + 1) - lgamma(f - i + 1) + lgamma(500 - f + 1) - lgamma(k - i + 1) - lgamma(500 - f - k + i + 1) - lgamma(501) + lgamma(k + 1) + lgamma(500 - k + 1))) FROM (SELECT unnest(range(o, least(f, k) + 1)) AS i)), 6) AS p_value FROM (SELECT (SELECT count(*) FROM mine) AS f, (SELECT count(*) FROM known) AS k, (SELECT count(*) FROM mine SEMI JOIN known USING (gene)) AS o)")
def database_enrichment(spark, d):  # noqa: ANN001, ANN201
    known = variants(spark, d).where("variant_id % 60 = 7").select("gene")
    return rounded(annotate.enrichment(_top_genes(spark, d), known, 500).drop("enriched"), 6)


@query()
def manhattan_offsets(spark, d):  # noqa: ANN001, ANN201
    return ranking.manhattan(variants(spark, d).select("chrom", "pos"), genome.chrom_order(F.col("chrom")))


SQL["manhattan_offsets"] = COHORT + "SELECT chrom, pos, pos + offs AS x FROM variants JOIN (SELECT chrom, coalesce(sum(m + 1000000) OVER (ORDER BY CASE chrom WHEN 'X' THEN 1000000 WHEN 'Y' THEN 1000001 ELSE chrom::INTEGER END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offs FROM (SELECT chrom, max(pos) AS m FROM variants GROUP BY chrom)) USING (chrom)"


@query()
def level_features(spark, d):  # noqa: ANN001, ANN201
    v = variants(spark, d)
    f = {k: an.level_features(k, F.lit(1), an.severity(F.col("consequence")), F.lit(None).cast("double"), F.lit(0.25), F.col("pos")) for k in ("L0", "L1", "L2", "L3", "L4")}
    return v.select("variant_id", *[F.size(x).alias(k) for k, x in f.items()], F.round(f["L3"][69], 6).alias("sift"), F.round(f["L3"][70], 6).alias("polyphen"))


SQL["level_features"] = COHORT + "SELECT variant_id, 1::INTEGER AS \"L0\", 65::INTEGER AS \"L1\", 69::INTEGER AS \"L2\", 71::INTEGER AS \"L3\", 71::INTEGER AS \"L4\", 0.5::DOUBLE AS sift, 0.25::DOUBLE AS polyphen FROM variants"


@query("SELECT count(*) AS n, round(avg(greatest(x, 0) - x * label + ln(1 + exp(-abs(x)))), 5) AS loss FROM (SELECT label, (coalesce(polyphen, 0) - 0.5) * 4 AS x FROM calls)")
def bce_loss(spark, d):  # noqa: ANN001, ANN201
    c = calls(spark, d).withColumn("x", (F.coalesce("polyphen", F.lit(0.0)) - 0.5) * 4)
    return c.agg(F.count(F.lit(1)).alias("n"), F.round(stats.bce_loss(F.col("x"), F.col("label")), 5).alias("loss"))


@query("SELECT round(quantile_cont(score, 0.025), 3) AS lo, round(quantile_cont(score, 0.975), 3) AS hi FROM calls")
def percentile_interval(spark, d):  # noqa: ANN001, ANN201
    return calls(spark, d).agg(stats.percentile_interval("score").alias("q")).select(F.round(F.col("q")[0], 3).alias("lo"), F.round(F.col("q")[1], 3).alias("hi"))


@query()
def logistic_burden(spark, d):  # noqa: ANN001, ANN201
    b = co.burden(calls(spark, d), samples(spark, d), _gene_sets(spark, d)).select("set_name", "label", "burden")
    return co.logistic_z(b, "set_name", ["burden"])


@query()
def permutation_enrichment(spark, d):  # noqa: ANN001, ANN201
    """Observed gene-set z against random sets of the same size, all fitted group by group."""
    m, s, genes = co.gene_matrix(calls(spark, d)), samples(spark, d), _gene_sets(spark, d).where("set_name = 'set_0'")
    obs = co.logistic_z(co.set_burden(m, s, genes).withColumn("perm", F.lit(-1)), "perm", ["burden"])
    sets = co.random_gene_sets(variants(spark, d), 20, 50, 5)
    sums = m.join(F.broadcast(sets), "gene").groupBy("perm", "sample_id").agg(F.sum("burden").alias("burden"))
    some = ordered.written(sums.join(s.select("sample_id", "label"), "sample_id").groupBy("perm", "label", "burden").agg(F.count(F.lit(1)).alias("n")))
    # samples without a call in a set are counted, not listed
    every = spark.range(50).select(F.col("id").cast("int").alias("perm")).crossJoin(F.broadcast(s.groupBy("label").agg(F.count(F.lit(1)).alias("all"))))
    rest = every.join(some.groupBy("perm", "label").agg(F.sum("n").alias("n")), ["perm", "label"], "left").select("perm", "label", F.lit(0).cast("long").alias("burden"), (F.col("all") - F.coalesce("n", F.lit(0))).alias("n"))
    return co.permutation_p(obs, co.logistic_z(some.union(rest.where("n > 0")), "perm", ["burden"], count="n"))


@query()
def windowed_events(spark, d):  # noqa: ANN001, ANN201
    from varloom.streaming.incremental import windowed_counts

    w = windowed_counts(read(spark, d, "events"), "ts", "1 hour", "1 hour", "event_type")
    return w.select(F.col("window.start").alias("start"), "event_type", "n")


SQL["windowed_events"] = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"


_X = "(u - n1 * n0 / 2.0 - 0.5) / sqrt(n1 * n0 / 12.0 * ((n1 + n0 + 1) - tie_term / ((n1 + n0) * (n1 + n0 - 1.0)))) / sqrt(2.0)"
SQL["mann_whitney_p"] = f"SELECT chrom, n1, n0, tie_term, u, auc, round(least(1, {_TAIL} / 2), 6) AS p_value FROM (SELECT *, {_X} AS x FROM ({SQL['mann_whitney_u']}))"
