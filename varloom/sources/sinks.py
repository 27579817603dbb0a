"""Writers: cohorts, rankings, attributions, matrices, summaries and reports."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_cohort(samples: DataFrame, calls: DataFrame, path: str, **facts: str) -> None:
    """Samples and calls as Parquet, with a one-row table of facts beside them."""
    samples.write.mode("overwrite").parquet(f"{path}/samples")
    calls.write.mode("overwrite").parquet(f"{path}/calls")
    samples.sparkSession.createDataFrame([tuple(map(str, facts.values())) or ("",)], list(facts) or ["none"]).write.mode("overwrite").json(f"{path}/metadata")


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None, sep: str = ",") -> None:
    rows.select(*(columns or rows.columns)).write.mode("overwrite").csv(path, header=True, sep=sep)


def export_rankings(variants: DataFrame, genes: DataFrame, path: str, prefix: str = "cohort", tops: tuple[int, int] = (100, 50)) -> None:
    write_csv(variants, f"{path}/{prefix}_variant_rankings")
    write_csv(genes, f"{path}/{prefix}_gene_rankings")
    write_csv(variants.orderBy("rank").limit(tops[0]), f"{path}/{prefix}_top_variants")
    write_csv(genes.orderBy("gene_rank").limit(tops[1]), f"{path}/{prefix}_top_genes")


def write_attributions(rows: DataFrame, path: str, buckets: int = 64) -> None:
    """Per-sample reads prune to one of a fixed number of folders, however many samples there are."""
    rows.withColumn("bucket", F.pmod(F.xxhash64("sample_id"), F.lit(buckets)).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_sample(spark, path: str, sample_id, buckets: int = 64) -> DataFrame:  # noqa: ANN001
    want = F.pmod(F.xxhash64(F.lit(sample_id)), F.lit(buckets)).cast("int")
    bucket = spark.range(1).select(want.alias("b")).first().b
    return spark.read.parquet(path).where((F.col("bucket") == bucket) & (F.col("sample_id") == sample_id)).drop("bucket")


def write_by(rows: DataFrame, path: str, *keys: str) -> None:
    """One folder a combination of keys (level, top_k, classifier)."""
    rows.write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_summary(row: DataFrame, path: str) -> None:
    row.select(F.to_json(F.struct(*row.columns)).alias("value")).write.mode("overwrite").text(path)


def markdown(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A report table of at most most rows; reports are of results, not of data."""
    head = f"# {title}\n\n| {' | '.join(rows.columns)} |\n|{'---|' * len(rows.columns)}\n"
    return head + "".join(f"| {' | '.join('' if v is None else str(v) for v in r)} |\n" for r in rows.limit(most).collect())


def top_k_name(base: str, k: int, several: bool) -> str:
    stem, dot, end = base.rpartition(".")
    return f"{stem}_topK{k}{dot}{end}" if several and dot else f"{base}_topK{k}" if several else base


def file_sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()
