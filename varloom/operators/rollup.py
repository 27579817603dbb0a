"""Gene rollups of variant tables, cohort statistics and covariate vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions import ordered
from varloom.functions.annotation import consequence_class, sex_covariate

#: The share of genes without variants from which two files can't be of one run.
MOST_MISSING = 0.01


def gene_maxima(variants: DataFrame, gene: str = "gene", score: str = "mean_score") -> DataFrame:
    """gene, gene_score (the largest of its variants) and num_variants (those with a score)."""
    return variants.groupBy(gene).agg(F.max(score).alias("gene_score"), F.count(score).alias("num_variants"))


def with_delta_rank(genes: DataFrame, variants: DataFrame, how: str = "max", gene: str = "gene", delta: str = "delta_rank") -> DataFrame:
    """The gene table with gene_delta_rank (max or mean over its variants) and gene_delta_rank_aggregation.

    A gene without variants has a null; over MOST_MISSING of such genes is an error, and so is a table
    that has these columns already.
    """
    if how not in ("max", "mean"):
        raise ValueError(f"unknown aggregation {how!r}")
    if taken := {"gene_delta_rank", "gene_delta_rank_aggregation"} & set(genes.columns):
        raise ValueError(f"{sorted(taken)} are there already")
    rolled = variants.groupBy(F.col(gene).cast("string").alias("_gene")).agg((F.max if how == "max" else F.avg)(delta).alias("gene_delta_rank"))
    names = genes.select(F.col(gene).cast("string").alias("_gene")).distinct()
    n, lost = names.join(rolled.withColumn("_met", F.lit(1)), "_gene", "left").agg(F.count(F.lit(1)), F.count_if(F.col("_met").isNull())).first()
    if lost and lost > MOST_MISSING * n:
        raise ValueError(f"{lost} of {n} genes have no variants: the tables are not of one run")
    out = genes.withColumn("_gene", F.col(gene).cast("string")).join(rolled, "_gene", "left").drop("_gene")
    return out.withColumn("gene_delta_rank_aggregation", F.lit(how))


def sample_statistics(samples: DataFrame, calls: DataFrame, key: str = "sample_id", gene: str = "gene") -> DataFrame:
    """One row: samples, genes, and the mean, largest and smallest number of calls a sample (0 without any)."""
    n = calls.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    each = samples.select(key).join(n, key, "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    counted = each.agg(F.count(F.lit(1)).alias("n_samples"), F.avg("n").alias("mean_variants"), F.coalesce(F.max("n"), F.lit(0)).alias("max_variants"), F.coalesce(F.min("n"), F.lit(0)).alias("min_variants"))
    return counted.crossJoin(calls.agg(F.count_distinct(gene).alias("n_genes")))


def label_distribution(samples: DataFrame, label: str = "label") -> DataFrame:
    return samples.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def covariate_vectors(samples: DataFrame, pcs: DataFrame, with_sex: bool = True, key: str = "sample_id") -> DataFrame:
    """The samples with covariates: sex first (1 male, 0 female, -1 unknown), then the components, as floats.
    A sample without components is an error."""
    rows = samples.join(pcs.select(key, "pcs"), key, "left")
    there = F.when(F.col("pcs").isNull(), F.raise_error(F.concat(F.lit("no components for sample "), F.col(key).cast("string"))).cast("array<float>")).otherwise(F.col("pcs"))
    first = F.array(sex_covariate(F.col("sex")).cast("float")) if with_sex else F.array().cast("array<float>")
    return rows.withColumn("covariates", F.concat(first, there)).drop("pcs")


#: Names of the gene column, the first that is there and holds a value wins.
SYMBOLS = ("gene_symbol", "gene_name", "gene", "gene_id")


def standardise_scores(rows: DataFrame, score: str | None = None) -> DataFrame:
    """The rows with gene_symbol, variant_score and variant_rank.

    The score is the one that is asked for, else z_attribution, else mean_attribution; a z_attribution that
    is asked for and not there is made by chromosome (a deviation of 0 or null counts as 1). What can't be read as a
    number is null. The rank is corrected_rank, else rank, else null.
    """
    if not {"chromosome", "position"} <= set(rows.columns):
        raise ValueError("rankings need chromosome and position")
    named = [c for c in SYMBOLS if c in rows.columns]
    held = rows.agg(*[F.count(c).alias(c) for c in named]).first().asDict() if named else {}
    symbol = next((c for c in named if held[c] or c == "gene_id"), None)
    if symbol is None:
        raise ValueError(f"rankings need one of {SYMBOLS}")
    if score == "z_attribution" and score not in rows.columns:
        stats = rows.groupBy(F.col("chromosome").alias("_c")).agg(F.avg("mean_attribution").alias("_m"), F.coalesce(F.nullif(F.stddev_samp("mean_attribution"), F.lit(0.0)), F.lit(1.0)).alias("_s"))
        rows = rows.join(stats, F.col("chromosome").eqNullSafe(F.col("_c")), "left").withColumn(score, (F.col("mean_attribution") - F.col("_m")) / F.col("_s")).drop("_c", "_m", "_s")
    chosen = score or next((c for c in ("z_attribution", "mean_attribution") if c in rows.columns), None)
    if chosen is None or chosen not in rows.columns:
        raise ValueError(f"rankings have no score {chosen or ''}")
    number = lambda c: F.col(c).cast("string").try_cast("double")
    rank = next((c for c in ("corrected_rank", "rank") if c in rows.columns), None)
    return rows.withColumns({"gene_symbol": F.col(symbol).cast("string"), "variant_score": number(chosen), "variant_rank": number(rank) if rank else F.lit(None).cast("double")})


def pair_carriers(pairs: DataFrame, calls: DataFrame) -> DataFrame:
    """The pairs (pair, pos1, gene1, pos2, gene2) with sample_id: of the samples that carry both variants
    once each, the one with the fewest calls (ties: the smaller id); null where there is none.

    A sample in which a (pos, gene) is met twice is ambiguous for it and doesn't count.
    """
    sizes = calls.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    once = calls.groupBy("sample_id", "pos", "gene").agg(F.count(F.lit(1)).alias("times")).where("times = 1")
    side = lambda i: once.select(F.col("sample_id").alias(f"s{i}"), F.col("pos").alias(f"pos{i}"), F.col("gene").alias(f"gene{i}"))
    both = pairs.join(side(1), ["pos1", "gene1"]).join(side(2), ["pos2", "gene2"]).where("s1 = s2").join(sizes, F.col("s1") == F.col("sample_id"))
    best = both.groupBy("pair").agg(F.min(F.struct("n", "s1")).alias("b")).select("pair", F.col("b.s1").alias("sample_id"))
    return pairs.join(best, "pair", "left")


def consequence_matrices(calls: DataFrame) -> DataFrame:
    """sample_id, gene, and the dosage in all and of each consequence class; pairs without a call have no row."""
    kind = consequence_class(F.col("consequence"))
    of = [F.sum(F.when(kind == k, F.col("dosage")).otherwise(0)).alias(k) for k in ("lof", "missense", "synonymous", "other")]
    return calls.groupBy("sample_id", "gene").agg(F.sum("dosage").alias("total"), *of)


def extremes(rows: DataFrame, column: str, k: int, *ties: str, largest: bool = True) -> DataFrame:
    """The k rows with the largest or smallest values; nulls come last, ties go by the other columns."""
    return rows.orderBy(F.desc_nulls_last(column) if largest else F.asc_nulls_last(column), *ties).limit(k)


def dense_gene_rank(genes: DataFrame, score: str) -> DataFrame:
    """gene_rank where a table has none: 1 for the best score, without gaps. Ranks are of distinct scores."""
    levels = genes.select(score).where(F.col(score).isNotNull()).distinct()
    return genes.join(ordered.ranked(levels, score, "gene_rank", (ordered.ahead(score, True) + 1).cast("int")), score, "left")


def metric_order(column: str, maximise: bool) -> Column:
    """Smaller is better: the metric, negated where it is maximised; NaN and null come last."""
    x = F.col(column).cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(float("inf"))).otherwise(-x if maximise else x)


def bounded_subset(calls: DataFrame, most: int, seed: int = 42, key: str = "variant_id") -> DataFrame:
    """At most so many calls of each sample, drawn by a seeded digest: the same on every run."""
    order = Window.partitionBy("sample_id").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "sample_id", key)), key)
    return calls.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def sparsity_penalty(vectors: DataFrame, column: str, weight: float) -> DataFrame:
    """One row: weight times the mean length of the vectors (0 without any)."""
    norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return vectors.agg((F.coalesce(F.avg(norm), F.lit(0.0)) * weight).alias("penalty"))


def x_contig(contigs: list[str]) -> str:
    """The first contig that is X by any of its names; an error where none is."""
    for c in contigs:
        if (c.removeprefix("chr")) in ("X", "23"):
            return c
    raise ValueError(f"no X contig among {contigs[:20]}")


def check_history(history: dict) -> dict:
    """A training history whose series are lists of one length that is not 0; anything else is an error."""
    series = {k: v for k, v in history.items() if isinstance(v, list)}
    sizes = {len(v) for v in series.values()}
    if not series or sizes == {0} or len(sizes) != 1:
        raise ValueError(f"series of lengths {sorted(sizes)}")
    return series
