"""The cohort view of the driver's tables: customers are samples, parts are variants, line items are calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONSEQUENCES = {"STANDARD": "synonymous_variant", "MEDIUM": "missense_variant", "PROMO": "stop_gained", "LARGE": "intron_variant", "SMALL": "missense_variant&splice_region_variant", "ECONOMY": "upstream_gene_variant"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("sample_id"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), 1).otherwise(0).alias("label"), F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("sex"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = (F.col("p_size") - 1) % 24 + 1
    chrom = F.when(m == 23, "X").when(m == 24, "Y").otherwise(m.cast("string"))
    kind = F.coalesce(*[F.when(F.col("p_type") == k, v) for k, v in CONSEQUENCES.items()])
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("variant_id"), chrom.alias("chrom"), (F.col("p_partkey") * 1000 + 1).alias("pos"), F.concat_ws("_", "p_brand", "p_type").alias("gene"), kind.alias("consequence"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line item: sample, label, sex, variant columns, dosage, gq, score, null_score, sift, polyphen.

    Scores are whole numbers, so that sums are the same in any order.
    """
    price = F.col("l_extendedprice")
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    # samples meet the orders first, so that line items are shuffled by order and by part only
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("sample_id")).join(samples(spark, sf_dir), "sample_id")
    joined = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(variants(spark, sf_dir), F.col("l_partkey") == F.col("variant_id"))
    return joined.select(
        "sample_id", "label", "sex", "variant_id", "chrom", "pos", "gene", "consequence", F.when(F.col("l_quantity") >= 25, 2).otherwise(1).alias("dosage"), F.round(F.col("l_discount") * 1000).cast("int").alias("gq"),
        F.round(price * F.col("l_discount")).alias("score"), F.round(price * F.col("l_tax")).alias("null_score"), F.when(F.col("l_tax") > 0, F.col("l_tax") * 10).alias("sift"), F.when(F.col("l_discount") > 0, F.col("l_discount") * 10).alias("polyphen"),
    )


_KIND = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CONSEQUENCES.items())
SQL = f"""WITH samples AS (SELECT c_custkey AS sample_id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END AS label, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex FROM customer),
variants AS (SELECT p_partkey AS variant_id, CASE (p_size - 1) % 24 + 1 WHEN 23 THEN 'X' WHEN 24 THEN 'Y' ELSE ((p_size - 1) % 24 + 1)::VARCHAR END AS chrom, p_partkey * 1000 + 1 AS pos, p_brand || '_' || p_type AS gene, CASE p_type {_KIND} END AS consequence FROM part),
calls AS (SELECT s.*, v.*, CASE WHEN l_quantity >= 25 THEN 2 ELSE 1 END AS dosage, round(l_discount * 1000)::INTEGER AS gq, round(l_extendedprice * l_discount) AS score, round(l_extendedprice * l_tax) AS null_score, CASE WHEN l_tax > 0 THEN l_tax * 10 END AS sift, CASE WHEN l_discount > 0 THEN l_discount * 10 END AS polyphen
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN samples s ON o_custkey = s.sample_id JOIN variants v ON l_partkey = v.variant_id),
v AS (SELECT chrom, pos, gene, avg(score) AS mean_score, max(score) AS max_score, median(score) AS median_score, stddev_pop(score) AS std_score, count(score) AS num_samples,
  avg(score) FILTER (WHERE label = 1) AS case_mean, count(score) FILTER (WHERE label = 1) AS case_n, avg(score) FILTER (WHERE label = 0) AS control_mean, count(score) FILTER (WHERE label = 0) AS control_n FROM calls GROUP BY chrom, pos, gene)
"""
