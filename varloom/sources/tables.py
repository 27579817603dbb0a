"""Text tables: phenotypes, sex maps, covariates, rankings, gene lists, study and gene-term tables."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varloom.functions import ordered
from varloom.functions.genome import normalise_chrom

#: Names under which a column may come, the first present wins; any case.
ALIASES = {
    "chrom": ("chrom", "chromosome", "chr", "#chrom"),
    "pos": ("pos", "position", "start"),
    "gene": ("gene_symbol", "gene_name", "gene", "gene_id"),
    "score": ("score", "mean_attribution", "z_attribution", "attribution", "gene_score", "gene_z_score", "mean_z_score"),
    "variant": ("variant_id", "variant", "id"),
}


def pick(columns: list[str], names: tuple[str, ...], required: bool = True) -> str | None:
    low = {c.lower(): c for c in columns}
    for n in names:
        if n in low:
            return low[n]
    if required:
        raise ValueError(f"none of {names} in {columns}")
    return None


def ascending(score: str) -> bool:
    """Whether smaller is better: p-values, FDRs and ranks, delta_rank excepted."""
    s = score.lower()
    return s != "delta_rank" and (s in ("p_rank_boot", "rank_real", "median_rank_null_boot") or s.startswith(("empirical_p", "fdr")) or s.endswith("rank"))


def phenotypes(spark: SparkSession, path: str) -> DataFrame:
    """sample_id and label of a two-column table without header: 1 is control, 2 is case, the last of
    repeated samples wins, lines with # and blank ones don't count, anything else is an error."""
    rows = spark.read.text(path).withColumn("n", F.monotonically_increasing_id()).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    f = F.split("value", "\t")
    code = F.trim(f[1])
    label = F.when(code == "1", 0).when(code == "2", 1).otherwise(F.raise_error(F.concat(F.lit("phenotype is neither 1 nor 2: "), F.col("value"))).cast("int"))
    named = rows.select(F.trim(f[0]).alias("sample_id"), label.alias("label"), "n")
    return named.groupBy("sample_id").agg(F.max_by("label", "n").alias("label"))


def sex_map(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.select("sample_id", F.col("inferred_sex").alias("sex")).where(F.col("sex").isin("M", "F"))


def known_sex(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", header=True)
    s = F.upper(F.trim(F.col(rows.columns[1])))
    return rows.select(F.col(rows.columns[0]).alias("sample_id"), F.when(s.isin("M", "MALE", "1"), "M").when(s.isin("F", "FEMALE", "2"), "F").alias("sex"))


def covariates(spark: SparkSession, path: str, n: int) -> DataFrame:
    """sample_id and its first n components as a float array; repeated samples and missing columns are errors."""
    rows = spark.read.csv(path, sep="\t", header=True)
    found = {m[1]: c for c in rows.columns if (m := re.fullmatch(r"(?i)pc(\d+)", c.strip()))}
    if missing := [i for i in range(1, n + 1) if str(i) not in found]:
        raise ValueError(f"components {missing} are missing")
    if twice := [r.sample_id for r in rows.groupBy("sample_id").count().where("count > 1").limit(5).collect()]:
        raise ValueError(f"repeated samples {twice}")
    return rows.select("sample_id", F.array(*[F.col(found[str(i)]).cast("float") for i in range(1, n + 1)]).alias("pcs"))


def rankings(spark: SparkSession, path: str, score: str | None = None) -> DataFrame:
    """variant, score (the worst value where it can't be read) and rank of a CSV; rows without an id go."""
    rows = spark.read.csv(path, header=True)
    score = score or pick(rows.columns, ALIASES["score"])
    up = ascending(score)
    given, chrom, pos = (pick(rows.columns, ALIASES[k], False) for k in ("variant", "chrom", "pos"))
    built = F.concat_ws(":", F.col(chrom), F.col(pos)) if chrom and pos else F.lit(None).cast("string")
    name = F.coalesce(*([F.nullif(F.col(given), F.lit(""))] if given else []), F.when(F.lit(bool(chrom and pos)) & (F.col(chrom or rows.columns[0]).isNotNull()), built))
    worst = F.lit(float("inf") if up else float("-inf"))
    out = rows.select(name.alias("variant"), F.coalesce(F.col(score).try_cast("double"), worst).alias("score")).where("variant is not null")
    return ordered.place(out, "rank", "score", F.asc("variant"), descending=not up).withColumn("rank", F.col("rank").cast("int")).orderBy("rank")


def ranking_levels(spark: SparkSession, paths: dict[str, str], score: str | None = None) -> DataFrame:
    """(level, variant, score, rank) of a ranking for each level."""
    out = None
    for level, path in sorted(paths.items()):
        one = rankings(spark, path, score).withColumn("level", F.lit(level))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no rankings")
    return out


def find_rankings(folder: str) -> dict[str, str]:
    """Level -> ranking file of a folder, by the strict name and then the loose one."""
    out: dict[str, str] = {}
    for pattern in ("L?_*_variant_rankings.csv", "*L?*rankings*.csv"):
        for p in sorted(Path(folder).glob(pattern)):
            if m := re.search(r"L\d", p.name):
                out.setdefault(m[0], str(p))
        if out:
            break
    return out


def parse_level_args(args: list[str]) -> dict[str, str]:
    """LEVEL:PATH pairs."""
    out = dict(a.split(":", 1) for a in args if ":" in a)
    if len(out) != len(args):
        raise ValueError("each ranking is LEVEL:PATH, each level once")
    return out


def gene_list(spark: SparkSession, path: str) -> DataFrame:
    first = spark.read.text(path).first()
    rows = spark.read.csv(path, header=True, sep="\t" if first and "\t" in first.value else ",", inferSchema=True)
    for c in ("gene_name", "gene_rank"):
        pick(rows.columns, (c,))
    return rows.orderBy("gene_rank")


def burden_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Long form (sample_id, gene, burden) of a wide matrix."""
    wide = spark.read.parquet(path)
    return wide.unpivot("sample_id", [c for c in wide.columns if c != "sample_id"], "gene", "burden")


def gene_rankings(spark: SparkSession, path: str, score: str | None = None) -> DataFrame:
    """gene, score, rank and fdr (if there) of a CSV: unreadable scores go, the best of repeated genes stays."""
    rows = spark.read.csv(path, header=True)
    gene, s = pick(rows.columns, ALIASES["gene"]), score or pick(rows.columns, ALIASES["score"])
    fdr = pick(rows.columns, ("fdr_gene", "fdr"), False)
    up = ascending(s)
    named = rows.select(F.col(gene).alias("gene"), F.col(s).try_cast("double").alias("score"), (F.col(fdr).try_cast("double") if fdr else F.lit(None).cast("double")).alias("fdr")).dropna(subset=["gene", "score"])
    order = F.asc("score") if up else F.desc("score")
    once = named.withColumn("_n", F.row_number().over(Window.partitionBy("gene").orderBy(order))).where("_n = 1").drop("_n")
    return ordered.place(once, "rank", "score", F.asc("gene"), descending=not up).withColumn("rank", F.col("rank").cast("int")).orderBy("rank")


def null_attributions(rows: DataFrame, drop_sex: bool = False) -> DataFrame:
    """Long null scores with normalised chromosomes, from ragged rows (sample_id, label, chroms, positions, genes, scores)."""
    sizes = [F.size(c) for c in ("chroms", "positions", "genes")]
    ok = F.assert_true(sum(((s != F.size("scores")).cast("int") for s in sizes), F.lit(0)) == 0, F.lit("arrays differ in length"))
    z = rows.withColumn("_ok", ok).where("_ok is null").select("sample_id", "label", F.explode(F.arrays_zip("chroms", "positions", "genes", "scores")).alias("x"))
    out = z.select("sample_id", "label", normalise_chrom(F.col("x.chroms")).alias("chrom"), F.col("x.positions").alias("pos"), F.col("x.genes").alias("gene"), F.col("x.scores").cast("double").alias("score"))
    return out.where(~F.col("chrom").isin("X", "Y")) if drop_sex else out


def studies(spark: SparkSession, path: str, max_p: float = 5e-8) -> DataFrame:
    """gene, disease_trait, p_value of an association catalogue: genes are split at the first separator
    present (', ', ' - ', '-'), empty ones and NR go, and each gene and trait is met once."""
    rows = spark.read.csv(path, sep="\t", header=True, encoding="iso-8859-1")
    gene, trait, p = (pick(rows.columns, n) for n in (("mapped_gene", "mapped gene", "gene"), ("disease/trait", "disease_trait"), ("p-value", "p_value")))
    g = F.col(f"`{gene}`")
    parts = F.when(g.contains(","), F.split(g, ",")).when(g.contains(" - "), F.split(g, " - ")).when(g.contains("-"), F.split(g, "-")).otherwise(F.array(g))
    out = rows.where(g.isNotNull() & (F.col(f"`{p}`").try_cast("double") < max_p)).select(F.explode(parts).alias("gene"), F.col(f"`{trait}`").alias("disease_trait"), F.col(f"`{p}`").cast("double").alias("p_value"))
    out = out.withColumn("gene", F.trim("gene")).where(~F.col("gene").isin("", "NR"))
    return out.groupBy("gene", "disease_trait").agg(F.min("p_value").alias("p_value"))


ASPECTS = {"P": "P", "F": "F", "C": "C", "biological_process": "P", "molecular_function": "F", "cellular_component": "C"}


def gene_terms(spark: SparkSession, path: str, aspects: str = "PFC", form: str = "biomart") -> DataFrame:
    """(gene, term) of a gene-term table: a headed table, or annotation files with ! comments."""
    if form == "biomart":
        r = spark.read.csv(path, sep="\t", header=True)
        name = {c.lower(): f"`{c}`" for c in r.columns}
        rows = r.select(F.col(name["gene name"]).alias("gene"), F.col(name["go term accession"]).alias("term"), F.col(name["go domain"]).alias("aspect"))
    else:
        r = spark.read.csv(path, sep="\t", comment="!")
        rows = r.select(F.col("_c2").alias("gene"), F.col("_c4").alias("term"), F.col("_c8").alias("aspect"))
    code = F.coalesce(*[F.when(F.col("aspect") == k, v) for k, v in ASPECTS.items()])
    return rows.where(F.col("term").startswith("GO:") & F.col("gene").isNotNull() & code.isin(*aspects)).select("gene", "term").distinct()


def term_map(terms: DataFrame, smallest: int = 1) -> DataFrame:
    """gene and its sorted terms, genes with too few left out."""
    return terms.groupBy("gene").agg(F.array_sort(F.collect_set("term")).alias("terms")).where(F.size("terms") >= smallest)


def flatten(x: dict, prefix: str = "") -> dict[str, str]:
    """Nested settings as lower-cased dotted keys."""
    out: dict[str, str] = {}
    for k, v in x.items():
        name = f"{prefix}.{k}".lower() if prefix else str(k).lower()
        out |= flatten(v, name) if isinstance(v, dict) else {name: v}
    return out


def first_metric(flat: dict, keys: tuple[str, ...]) -> float:
    """The first present key that reads as a number, else NaN."""
    for k in keys:
        try:
            return float(flat[k])
        except (KeyError, TypeError, ValueError):
            continue
    return float("nan")


def results(spark: SparkSession, folder: str, pattern: str = "**/*.json") -> DataFrame:
    """(run, key, value) of the nested result files below a folder: JSON, or YAML where its reader is there."""
    rows = []
    for p in sorted(Path(folder).glob(pattern)):
        if p.suffix in (".yaml", ".yml"):
            import yaml

            x = yaml.safe_load(p.read_text())
        else:
            x = json.loads(p.read_text())
        if not isinstance(x, dict):
            raise ValueError(f"{p} holds no mapping")
        rows += [(p.parent.name, k, str(v)) for k, v in flatten(x).items()]
    return spark.createDataFrame(rows, "run string, key string, value string")


def positive_ints(text: str) -> list[int]:
    out = list(dict.fromkeys(int(x) for x in text.split(",") if x.strip()))
    if not out or min(out) < 1:
        raise ValueError(f"positive numbers are asked for, not {text!r}")
    return out


def level_of(path: str, settings: dict | None = None) -> str:
    """A run's level: from its settings, else from its path, else UNKNOWN."""
    flat = flatten(settings or {})
    for k in ("level", "annotation_level", "model.level", "data.level"):
        if str(flat.get(k, "")).upper().startswith("L"):
            return str(flat[k]).upper()
    m = re.search(r"(?:^|[/_.-])(L\d+)(?:[/_.-]|$)", path)
    return m[1] if m else "UNKNOWN"
