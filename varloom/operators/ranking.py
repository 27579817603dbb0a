"""Variant and gene rankings, chromosome correction, null contrast and gene lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions import ordered, stats
from varloom.functions.genome import SEX_CHROMS

KEY = ("chrom", "pos", "gene")


def variant_scores(calls: DataFrame, score: str = "score", key: tuple[str, ...] = KEY) -> DataFrame:
    """Per variant: mean, max, median, population deviation and number of its scores, and the same by label. A
    caller that selects columns before they are ranked and written doesn't pay for the others."""
    by = lambda label: F.when(F.col("label") == label, F.col(score))
    return calls.where(F.col(score).isNotNull()).groupBy(*key).agg(
        F.avg(score).alias("mean_score"), F.max(score).alias("max_score"), F.median(score).alias("median_score"), F.stddev_pop(score).alias("std_score"), F.count(score).alias("num_samples"),
        F.avg(by(1)).alias("case_mean"), F.count(by(1)).alias("case_n"), F.avg(by(0)).alias("control_mean"), F.count(by(0)).alias("control_n"),
    ).withColumn("case_control_diff", F.col("case_mean") - F.col("control_mean"))


def rank_variants(calls: DataFrame, how: str = "mean", score: str = "score", key: tuple[str, ...] = KEY) -> DataFrame:
    """variant_scores() with a rank by the mean, the max, or the mean of three average ranks (1 is best)."""
    v = variant_scores(calls, score, key)
    if how == "rank_average":
        for c in ("mean_score", "max_score", "num_samples"):
            v = stats.average_rank(v, c, f"_{c}")
        v = v.withColumn("score", (F.col("_mean_score") + F.col("_max_score") + F.col("_num_samples")) / 3).drop("_mean_score", "_max_score", "_num_samples")
    elif how in ("mean", "max"):
        v = v.withColumn("score", F.col(f"{how}_score"))
    else:
        raise ValueError(f"unknown aggregation {how!r}")
    return stats.min_rank(v, "score", "rank", descending=how != "rank_average")


def rank_genes(variants: DataFrame, how: str = "max") -> DataFrame:
    """Per gene: max, mean or sum of its variants' mean scores, or the max over the root of their
    number; its top variant, sample and variant counts, and the average rank cut to an integer."""
    forms = {"max": F.max("mean_score"), "mean": F.avg("mean_score"), "sum": F.sum("mean_score"), "size_normalised": F.max("mean_score") / F.sqrt(F.count(F.lit(1)))}
    if how not in forms:
        raise ValueError(f"unknown aggregation {how!r}")
    g = variants.where("gene is not null").groupBy("gene").agg(forms[how].alias("gene_score"), F.count(F.lit(1)).alias("num_variants"), F.sum("num_samples").alias("num_samples"), F.max_by(F.struct("chrom", "pos"), F.struct("mean_score", -F.col("pos"))).alias("_top"))
    g = g.select("gene", "gene_score", "num_variants", "num_samples", F.col("_top.chrom").alias("top_chrom"), F.col("_top.pos").alias("top_pos"))
    return stats.average_rank(g, "gene_score", "_r").withColumn("gene_rank", F.floor("_r").cast("long")).drop("_r")


def case_enriched(variants: DataFrame, min_cases: int = 5, min_diff: float = 0.1, top: int = 100) -> DataFrame:
    found = variants.where((F.col("case_n") >= min_cases) & (F.col("case_control_diff") > min_diff))
    found = stats.average_rank(found, "case_control_diff", "_r").withColumn("enrichment_rank", F.floor("_r").cast("long")).drop("_r")
    return found.orderBy(F.desc("case_control_diff"), "chrom", "pos", "gene").limit(top)


def top_per_sample(calls: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Each sample's k calls of largest absolute score."""
    w = Window.partitionBy("sample_id").orderBy(F.desc(F.abs(score)), "chrom", "pos")
    return calls.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def chromosome_z(variants: DataFrame, score: str = "mean_score", drop_sex: bool = False) -> DataFrame:
    """z within chromosomes and its rank; ranks are made anew where the sex chromosomes are dropped."""
    v = stats.group_z(variants, score, "z_score", ("chrom",))
    v = v.where(~F.col("chrom").isin(*SEX_CHROMS)) if drop_sex else v
    return stats.min_rank(v, "z_score", "corrected_rank")


def corrected_genes(variants: DataFrame, significance: DataFrame | None = None) -> DataFrame:
    """Genes by the largest z of their variants; a significance table with gene is joined to them."""
    g = variants.where("gene is not null").groupBy("gene").agg(F.max("z_score").alias("gene_z"), F.avg("z_score").alias("mean_z"), F.count(F.lit(1)).alias("num_variants"), F.max_by("pos", F.struct("z_score", -F.col("pos"))).alias("top_pos"))
    g = g if significance is None else g.join(significance, "gene", "left")
    return ordered.place(g, "gene_rank", "gene_z", F.asc("gene"))


def null_contrast(real: DataFrame, null: DataFrame, score: str = "score") -> DataFrame:
    """Empirical p of each real score against the pooled null ones, and its FDR."""
    return stats.bh_fdr(stats.empirical_p(real, null, score), "p_value", "fdr")


def significance_counts(tested: DataFrame) -> DataFrame:
    return tested.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("fdr") < t).alias(f"n_fdr_{str(t).replace('0.', '')}") for t in (0.05, 0.01, 0.001)], F.min("p_value").alias("min_p"))


def null_thresholds(null: DataFrame, score: str = "score") -> DataFrame:
    return null.agg(*[F.percentile(score, q).alias(n) for q, n in ((0.95, "p05"), (0.99, "p01"), (0.999, "p001"))])


def flag_against_null(real: DataFrame, null: DataFrame, score: str = "score") -> DataFrame:
    """Strictly above the null's 95th, 99th and 99.9th percentile; the thresholds are one row."""
    t = null_thresholds(null, score)
    flags = [(F.col(score) > F.col(n)).alias(f"exceeds_null_{n}") for n in ("p05", "p01", "p001")]
    return real.crossJoin(F.broadcast(t)).select(*[real[c] for c in real.columns], *flags)


def gene_list(variants: DataFrame, score: str, how: str = "max", keep_sex: bool = False, flag: str | None = None, fdr: DataFrame | None = None, max_fdr: float | None = None) -> DataFrame:
    """Genes by the max or mean score of their variants, ranked; optional null flag and FDR filters re-rank."""
    if how not in ("max", "mean"):
        raise ValueError(f"unknown aggregation {how!r}")
    v = variants if keep_sex else variants.where(~F.col("chrom").isin(*SEX_CHROMS))
    v = v if flag is None else v.where(F.col(flag))
    g = v.where("gene is not null").groupBy("gene").agg({"max": F.max, "mean": F.avg}[how](score).alias("gene_score"), F.count(F.lit(1)).alias("n_variants"), F.min_by("chrom", F.col("pos")).alias("chromosome"))
    if fdr is not None and max_fdr is not None:
        g = g.join(fdr.select("gene", "fdr"), "gene", "left").where(F.col("fdr") < max_fdr)
    return ordered.place(g, "gene_rank", "gene_score", F.asc("gene"))


def gene_support(variants: DataFrame, significant: Column) -> DataFrame:
    return variants.where("gene is not null").groupBy("gene").agg(F.count(F.lit(1)).alias("n_variants"), F.max("score").alias("max_score"), F.avg("score").alias("mean_score"), F.count_if(significant).alias("n_significant"), F.max(F.when(significant, F.col("score"))).alias("max_significant"))


def select_genes(genes: DataFrame, support: DataFrame, top: int, min_score: float = 0.0, min_significant: int = 0, allow_others: bool = True) -> DataFrame:
    """Genes with their support: the score is the best significant variant's where there is one;
    four sort keys, positional rank, top genes."""
    g = genes.select("gene", F.col("gene_score").alias("raw_score")).join(support, "gene", "left")
    g = g.withColumn("selection_score", F.coalesce("max_significant", "raw_score")).withColumn("n_significant", F.coalesce("n_significant", F.lit(0)))
    g = g if allow_others else g.where(F.col("n_significant") >= min_significant)
    g = g.where("selection_score is not null")
    g = g.where(F.col("selection_score") >= min_score) if min_score > 0 else g
    g = ordered.place(g, "selected_rank", "selection_score", F.desc("n_significant"), F.desc("raw_score"), F.asc("gene"))
    return g.where(F.col("selected_rank") <= top)


def level_jaccard(levels: DataFrame, tops: tuple[int, ...]) -> DataFrame:
    """Jaccard of each two levels' top-k sets of (level, variant, rank); two empty sets give 0."""
    ks = F.explode(F.array(*map(F.lit, tops))).alias("k")
    top = levels.select("level", "variant", "rank", ks).where("rank <= k")
    sizes = top.groupBy("level", "k").agg(F.count(F.lit(1)).alias("n"))
    pairs = sizes.alias("a").join(sizes.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.level") < F.col("b.level"))).select(F.col("a.k").alias("k"), F.col("a.level").alias("level_a"), F.col("b.level").alias("level_b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb"))
    same = top.alias("a").join(top.alias("b"), (F.col("a.variant") == F.col("b.variant")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.level") < F.col("b.level"))).groupBy(F.col("a.k").alias("k"), F.col("a.level").alias("level_a"), F.col("b.level").alias("level_b")).agg(F.count(F.lit(1)).alias("n_both"))
    out = pairs.join(same, ["k", "level_a", "level_b"], "left").withColumn("n_both", F.coalesce("n_both", F.lit(0)).cast("long"))
    return out.select("k", "level_a", "level_b", "n_both", (F.col("na") + F.col("nb") - F.col("n_both")).alias("n_either"), F.round(F.try_divide("n_both", F.col("na") + F.col("nb") - F.col("n_both")), 4).alias("jaccard"))


def level_specific(levels: DataFrame, high: int, low: int) -> DataFrame:
    """Variants within high at one level and beyond low (or missing) at all others."""
    w = Window.partitionBy("variant")
    near = levels.withColumn("_in", F.sum(F.when(F.col("rank") <= low, 1).otherwise(0)).over(w)).withColumn("best_elsewhere", F.min("rank").over(w))
    return near.where((F.col("rank") <= high) & (F.col("_in") == F.when(F.col("rank") <= low, 1).otherwise(0))).select("level", "variant", "rank")


def manhattan(variants: DataFrame, order: Column, gap: int = 1_000_000) -> DataFrame:
    """Adds x: the position plus the spans of the chromosomes before, with a gap after each."""
    spans = variants.groupBy("chrom").agg(F.max("pos").alias("span")).withColumn("_o", order)
    w = Window.orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.withColumn("offset", F.coalesce(F.sum(F.col("span") + gap).over(w), F.lit(0))).select("chrom", "offset")
    return variants.join(F.broadcast(offsets), "chrom").withColumn("x", F.col("pos") + F.col("offset")).drop("offset")


def repair_labels(rankings: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Fills chrom and gene name by (pos, gene_id): unknown and GENE_<id> where the catalogue has none."""
    known = catalogue.groupBy("pos", "gene_id").agg(F.min_by(F.struct("chrom", "gene"), F.struct("chrom", "gene")).alias("_k"))
    out = rankings.drop("chrom", "gene").join(known, ["pos", "gene_id"], "left")
    return out.withColumn("chrom", F.coalesce("_k.chrom", F.lit("unknown"))).withColumn("gene", F.coalesce("_k.gene", F.concat(F.lit("GENE_"), F.col("gene_id").cast("string")))).drop("_k")
