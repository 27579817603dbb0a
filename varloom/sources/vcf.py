"""Variant call text: a multi-sample scan and the clinical and sex-check views of it, all DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.functions import annotation as an
from varloom.functions import genome
from varloom.sources import blocks


def read_lines(spark: SparkSession, path: str, samples: list[str] | None = None, regions: list[str] | None = None) -> DataFrame:
    """The lines behind the header's. Block-compressed files (bgzip) are read by many tasks each, and only
    the given samples (in that order) and regions (chrom:from-to) leave the reader; other gz files are
    one task each, and in them and in plain text all samples and regions are read."""
    if not blocks.is_blocked(path):
        if samples is not None or regions is not None:
            raise ValueError("samples and regions are chosen in block-compressed files only")
        return spark.read.text(path).where(~F.col("value").startswith("##"))
    options = {}
    if samples is not None:
        place = {x: i for i, x in enumerate(header_samples(spark, path))}
        if missing := [x for x in samples if x not in place]:
            raise ValueError(f"samples that the header lacks: {missing}")
        options["samples"] = ",".join(str(place[x]) for x in samples)
    if regions is not None:
        options["regions"] = ",".join(regions)
    return blocks.read_block_lines(spark, path, **options).where(~F.col("value").startswith("##"))


def header_samples(spark: SparkSession, path: str) -> list[str]:
    """The names in the header, which is read from a file's first bytes."""
    head = blocks.head_lines(path)
    if not any(r.startswith("##INFO=<ID=CSQ,") for r in head):
        ids = sorted(r.split("ID=")[1].split(",")[0] for r in head if r.startswith("##INFO=<ID="))
        raise ValueError(f"no CSQ annotation in the header; INFO has {ids}")
    names = [r for r in head if r.startswith("#CHROM")]
    if not names:
        raise ValueError("no #CHROM line")
    return names[0].split("\t")[9:]


def info_value(info: Column, key: str) -> Column:
    return F.nullif(F.regexp_extract(info, f"(?:^|;){key}=([^;]*)", 1), F.lit(""))


def parse_calls(lines: DataFrame, samples: list[str], phenotypes: DataFrame, sex: DataFrame | None = None, build: str = "GRCh37", min_gq: int = 20, most: int | None = None) -> DataFrame:
    """sample_id, label, chrom, pos, ref, alt, gene, consequence, dosage, sift, polyphen.

    One row a sample and alternate allele with a copy of it; records without annotation of the
    allele, samples without phenotype, and calls below min_gq are dropped. A missing quality keeps
    the call. A male's X outside the PAR counts double; a female's Y is dropped.
    """
    f = F.split("value", "\t", -1)
    rec = lines.where(~F.col("value").startswith("#")).select(genome.normalise_chrom(f[0]).alias("chrom"), f[1].cast("long").alias("pos"), f[3].alias("ref"), F.split(f[4], ",").alias("alts"), info_value(f[7], "CSQ").alias("csq"), F.split(f[8], ":").alias("format"), F.slice(f, 10, len(samples)).alias("calls"))
    one = rec.where("csq is not null").select("*", F.posexplode("alts").alias("alt_index", "alt"))
    one = one.withColumn("t", an.pick_transcript(an.parse_csq(F.col("csq"), F.col("alt")))).where("t is not null")
    names = F.array(*map(F.lit, samples))
    cells = one.select("chrom", "pos", "ref", "alt", "alt_index", "format", F.get("t", F.lit(1)).alias("consequence"), F.get("t", F.lit(3)).alias("gene"), an.numeric_suffix(F.get("t", F.lit(36))).alias("sift"), an.numeric_suffix(F.get("t", F.lit(37))).alias("polyphen"), F.posexplode(F.arrays_zip(names.alias("n"), F.col("calls").alias("c"))).alias("i", "cell"))
    part = F.split("cell.c", ":")
    field = lambda k: F.get(part, (F.array_position("format", k) - 1).cast("int"))
    cells = cells.withColumn("sample_id", F.col("cell.n")).withColumn("gt", F.split(F.regexp_replace(F.coalesce(field("GT"), F.lit("")), r"\|", "/"), "/")).withColumn("gq", F.when(F.array_contains("format", "GQ"), field("GQ")).try_cast("double"))
    copies = F.size(F.filter("gt", lambda a: a == (F.col("alt_index") + 1).cast("string")))
    cells = cells.withColumn("copies", copies).where("copies > 0").where(F.col("gq").isNull() | (F.col("gq") >= min_gq))
    rows = cells.join(phenotypes.select("sample_id", "label"), "sample_id")
    rows = rows.join(sex.select("sample_id", "sex"), "sample_id", "left") if sex is not None else rows.withColumn("sex", F.lit(None).cast("string"))
    rows = rows.withColumn("dosage", genome.ploidy_dosage(F.col("copies"), F.col("chrom"), F.col("pos"), F.col("sex"), build)).where("dosage is not null")
    out = rows.select("sample_id", "label", "sex", "chrom", "pos", "ref", "alt", "gene", "consequence", "dosage", "sift", "polyphen")
    if most is not None:
        from pyspark.sql import Window

        out = out.withColumn("_n", F.row_number().over(Window.partitionBy("sample_id").orderBy(genome.chrom_order(F.col("chrom")), "pos", "alt"))).where(F.col("_n") <= most).drop("_n")
    return out


def parse_clinical(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """chrom, pos, ref, alt, gene, clinical_significance of pathogenic records, one row an allele."""
    f = F.split("value", "\t", -1)
    sig = info_value(f[7], "CLNSIG")
    gene = F.regexp_extract(F.coalesce(info_value(f[7], "GENEINFO"), F.lit("")), "^([^:|]*)", 1)
    rows = lines.where(~F.col("value").startswith("#")).select(F.regexp_replace(f[0], "^chr", "").alias("chrom"), f[1].cast("long").alias("pos"), f[3].alias("ref"), F.explode(F.split(f[4], ",")).alias("alt"), gene.alias("gene"), sig.alias("clinical_significance"))
    # The significances that are kept.
    rows = rows.where(F.col("clinical_significance").rlike("Pathogenic|Likely_pathogenic|pathogenic"))
    return rows if limit is None else rows.limit(limit)


def x_genotypes(lines: DataFrame, samples: list[str], build: str = "GRCh37") -> DataFrame:
    """sample_id, pos, n_alt (null: missing) of single-base, passed sites of X outside the PAR."""
    f = F.split("value", "\t", -1)
    rec = lines.where(~F.col("value").startswith("#")).select(genome.normalise_chrom(f[0]).alias("chrom"), f[1].cast("long").alias("pos"), f[3].alias("ref"), f[4].alias("alt"), f[6].alias("filter"), F.slice(f, 10, len(samples)).alias("calls"))
    ok = rec.where((F.col("chrom") == "X") & (F.length("ref") == 1) & F.col("alt").rlike("^[ACGT]$") & F.col("filter").isin("PASS", ".") & ~genome.in_par(F.col("pos"), F.col("chrom"), build))
    cells = ok.select("pos", F.explode(F.arrays_zip(F.array(*map(F.lit, samples)).alias("n"), F.col("calls").alias("c"))).alias("x"))
    gt = F.split(F.regexp_replace(F.split("x.c", ":")[0], r"\|", "/"), "/")
    return cells.select(F.col("x.n").alias("sample_id"), "pos", F.when(~F.array_contains(gt, "."), F.size(F.filter(gt, lambda a: a != "0"))).alias("n_alt"))
