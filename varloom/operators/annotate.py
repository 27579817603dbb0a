"""Matches of variants and genes with public annotation tables, and enrichment of gene sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions import stats


def _plain_chrom(c: Column) -> Column:
    return F.regexp_replace(F.lower(c.cast("string")), "^chr", "")


def match_clinical(variants: DataFrame, clinical: DataFrame, top: int = 100) -> DataFrame:
    """The top variants with the clinical significances at their place, distinct ones joined by '; '."""
    known = clinical.select(_plain_chrom(F.col("chrom")).alias("_c"), F.col("pos").alias("_p"), "clinical_significance").groupBy("_c", "_p").agg(F.concat_ws("; ", F.array_sort(F.collect_set("clinical_significance"))).alias("significance"))
    best = variants.orderBy("rank", "chrom", "pos").limit(top)
    return best.join(known, (_plain_chrom(F.col("chrom")) == F.col("_c")) & (F.col("pos") == F.col("_p")), "left").drop("_c", "_p").withColumn("in_clinical", F.col("significance").isNotNull())


def match_studies(genes: DataFrame, studies: DataFrame, terms: list[str] | None = None, top: int = 50) -> DataFrame:
    """The top genes with the number of their studies and up to five traits; terms filter traits, any case."""
    s = studies
    if terms:
        import re

        s = s.where(F.col("disease_trait").rlike("(?i)" + "|".join(map(re.escape, terms))))
    known = s.groupBy(F.upper("gene").alias("_g")).agg(F.count(F.lit(1)).alias("n_studies"), F.concat_ws("; ", F.slice(F.array_sort(F.collect_set("disease_trait")), 1, 5)).alias("traits"))
    best = genes.orderBy("gene_rank", "gene").limit(top)
    return best.join(known, F.upper("gene") == F.col("_g"), "left").drop("_g").withColumn("n_studies", F.coalesce("n_studies", F.lit(0)).cast("long")).withColumn("in_studies", F.col("n_studies") > 0)


def enrichment(found: DataFrame, known: DataFrame, total: int) -> DataFrame:
    """Overlap of two gene tables against a universe of total genes: fold, hypergeometric p."""
    a, b = found.select("gene").distinct(), known.select("gene").distinct()
    n = a.agg(F.count(F.lit(1)).alias("n_found")).crossJoin(b.agg(F.count(F.lit(1)).alias("n_known"))).crossJoin(a.join(b, "gene", "left_semi").agg(F.count(F.lit(1)).alias("overlap")))
    n = n.withColumn("total", F.lit(total))
    p = stats.hypergeom_sf(None, F.col("overlap"), F.col("n_found"), F.col("n_known"), F.col("total").cast("long"))
    fold = F.try_divide(F.col("overlap") * F.col("total").cast("double"), F.col("n_found") * F.col("n_known"))
    return n.withColumn("fold", fold).withColumn("p_value", p).withColumn("enriched", (F.col("p_value") < 0.05) & (F.col("fold") > 1))


def term_enrichment(genes: DataFrame, terms: DataFrame, universe: DataFrame, smallest: int = 3, largest: int = 500) -> DataFrame:
    """Per term (gene, term): overlap with the gene set, hypergeometric p against the universe, FDR.

    Terms outside the size bounds and without overlap are left out.
    """
    u = universe.select("gene").distinct()
    t = terms.select("gene", "term").distinct().join(u, "gene", "left_semi")
    mine = genes.select("gene").distinct().join(u, "gene", "left_semi")
    sizes = t.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).where(F.col("n_term").between(smallest, largest))
    hit = t.join(mine, "gene", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("overlap"))
    totals = u.agg(F.count(F.lit(1)).cast("int").alias("total")).crossJoin(mine.agg(F.count(F.lit(1)).alias("n_genes")))
    rows = sizes.join(hit, "term").crossJoin(F.broadcast(totals))
    p = stats.hypergeom_sf(None, F.col("overlap"), F.col("n_genes"), F.col("n_term"), F.col("total").cast("long"))
    return stats.bh_fdr(rows.withColumn("p_value", p), "p_value", "fdr")


def validation_summary(variants: DataFrame, genes: DataFrame) -> DataFrame:
    share = lambda c: F.lit(100.0) * F.avg(F.col(c).cast("double"))
    v = variants.agg(F.count(F.lit(1)).alias("n_variants"), F.count_if("in_clinical").alias("n_clinical"), share("in_clinical").alias("pct_clinical"))
    return v.crossJoin(genes.agg(F.count(F.lit(1)).alias("n_genes"), F.count_if("in_studies").alias("n_studied"), share("in_studies").alias("pct_studied")))
