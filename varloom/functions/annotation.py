"""Consequence and score expressions, and the feature encoders built from them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Severity of each consequence term, 4 the highest.
SEVERITY = {
    4: "transcript_ablation splice_acceptor_variant splice_donor_variant stop_gained frameshift_variant stop_lost start_lost transcript_amplification",
    3: "missense_variant inframe_insertion inframe_deletion protein_altering_variant",
    2: "synonymous_variant stop_retained_variant incomplete_terminal_codon_variant splice_region_variant splice_polypyrimidine_tract_variant coding_sequence_variant 5_prime_UTR_variant 3_prime_UTR_variant start_retained_variant",
    1: "intron_variant intergenic_variant upstream_gene_variant downstream_gene_variant non_coding_transcript_variant non_coding_transcript_exon_variant mature_miRNA_variant regulatory_region_variant TF_binding_site_variant TFBS_ablation TFBS_amplification",
    0: "unknown",
}
# The shorter table by which a transcript is picked where none is canonical.
PICK_SEVERITY = {
    4: "stop_gained frameshift_variant splice_acceptor_variant splice_donor_variant start_lost stop_lost",
    3: "missense_variant inframe_deletion inframe_insertion protein_altering_variant",
    2: "synonymous_variant stop_retained_variant splice_region_variant",
    1: "intron_variant upstream_gene_variant downstream_gene_variant 5_prime_UTR_variant 3_prime_UTR_variant",
}
NEUTRAL = 0.5


def severity(consequence: Column, table: dict[int, str] = SEVERITY) -> Column:
    """The highest severity among the terms of a compound (&) consequence; 0 for unknown terms and null."""

    def one(term: Column) -> Column:
        out = F.lit(0)
        for level, names in table.items():
            out = F.when(term.isin(*names.split()), level).otherwise(out)
        return out

    return F.coalesce(F.array_max(F.transform(F.split(consequence, "&"), one)), F.lit(0)).cast("int")


def consequence_class(consequence: Column) -> Column:
    """lof, missense, synonymous or other; the first that holds."""
    return F.when(severity(consequence) == 4, "lof").when(consequence.contains("missense"), "missense").when(consequence.contains("synonymous"), "synonymous").otherwise("other")


def numeric_suffix(text: Column) -> Column:
    """The number at the end of text such as deleterious0.05; null without one."""
    return F.nullif(F.regexp_extract(text, r"([0-9]+\.?[0-9]*)$", 1), F.lit("")).cast("double")


def parse_csq(csq: Column, alt: Column) -> Column:
    """Transcripts of one allele, each an array of fields: blanks, quotes and round brackets go first."""
    flat = F.translate(csq, " '()", "")
    return F.transform(F.filter(F.split(flat, ","), lambda t: t.startswith(F.concat(alt, F.lit("|")))), lambda t: F.split(t, r"\|", -1))


def pick_transcript(transcripts: Column, consequence: int = 1, canonical: int = 24) -> Column:
    """The first canonical transcript, else the first of the highest severity, else null."""
    chosen = F.filter(transcripts, lambda t: F.get(t, F.lit(canonical)) == "YES")
    ranked = F.array_sort(F.transform(transcripts, lambda t, i: F.struct((-severity(F.get(t, F.lit(consequence)), PICK_SEVERITY)).alias("s"), i.alias("i"), t.alias("t"))))
    return F.coalesce(F.get(chosen, F.lit(0)), F.get(ranked, F.lit(0))["t"])


def impute(score: Column, method: str = "median", over: tuple[str, ...] = ()) -> Column:
    """Null scores take the median or mean of the others in the group, or 0.5 (also where all are null)."""
    if method not in ("median", "mean", "neutral"):
        raise ValueError(f"unknown imputation {method!r}")
    if method == "neutral":
        return F.coalesce(score, F.lit(NEUTRAL))
    return F.coalesce(score, {"median": F.median, "mean": F.avg}[method](score).over(Window.partitionBy(*over)), F.lit(NEUTRAL))


def impute_columns(rows: DataFrame, how: dict[str, str], over: tuple[str, ...] = ()) -> DataFrame:
    """impute() of several columns by one aggregation that is joined back: no group meets in one task."""
    if unknown := set(how.values()) - {"median", "mean", "neutral"}:
        raise ValueError(f"unknown imputation {sorted(unknown)}")
    stats = {c: {"median": F.median, "mean": F.avg}[m](c) for c, m in how.items() if m != "neutral"}
    if stats:
        middle = rows.groupBy(*[F.col(c).alias(f"_by_{c}") for c in over]).agg(*[x.alias(f"_of_{c}") for c, x in stats.items()])
        rows = rows.join(middle, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in over], "left") if over else rows.crossJoin(middle)  # one row
    filled = {c: F.coalesce(F.col(c), F.col(f"_of_{c}") if c in stats else F.lit(None), F.lit(NEUTRAL)) for c in how}
    return rows.withColumns(filled).drop(*[f"_of_{c}" for c in stats], *[f"_by_{c}" for c in over])


def reduce_vector(v: Column, how: str = "l2") -> Column:
    """One number of a vector: l2, l1, sum or mean."""
    total = lambda f: F.aggregate(v, F.lit(0.0), lambda s, x: s + f(x.cast("double")))
    forms = {"l2": lambda: F.sqrt(total(lambda x: x * x)), "l1": lambda: total(F.abs), "sum": lambda: total(lambda x: x), "mean": lambda: F.try_divide(total(lambda x: x), F.size(v))}
    if how not in forms:
        raise ValueError(f"unknown reduction {how!r}")
    return forms[how]()


def one_hot_severity(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.when(s == i, 1.0).otherwise(0.0))


def sinusoid(pos: Column, dim: int = 64, longest: float = 10_000.0) -> Column:
    """Even places sin, odd places cos of pos * longest ** (-2 i / dim)."""
    waves = [math.exp(2 * i * -math.log(longest) / dim) for i in range(dim // 2)]
    return F.array(*[f(pos * F.lit(w)) for w in waves for f in (F.sin, F.cos)])


def relative_bucket(query: Column, key: Column, query_chrom: Column | None = None, key_chrom: Column | None = None, buckets: int = 32, farthest: int = 100_000) -> Column:
    """Half of the buckets for keys before the query; exact distances below a quarter, logarithmic
    beyond, and one bucket more across chromosomes."""
    if (query_chrom is None) != (key_chrom is None):
        raise ValueError("both chromosomes or neither")
    half, exact = buckets // 2, buckets // 4
    n = F.abs(query - key)
    far = exact + F.floor(F.log(F.greatest(n, F.lit(1)) / F.lit(float(exact))) / math.log(farthest / exact) * (half - exact))
    bucket = (F.when(query > key, half).otherwise(0) + F.when(n < exact, n).otherwise(F.least(far, F.lit(half - 1)))).cast("int")
    return bucket if query_chrom is None else F.when(query_chrom == key_chrom, bucket).otherwise(buckets)


def level_features(level: str, dosage: Column, sev: Column, sift: Column, polyphen: Column, pos: Column) -> Column:
    """Feature vectors of the ablation levels: dosage; + position; + severity and missense; + scores; L4 is L3."""
    parts = [F.array(dosage.cast("double")), sinusoid(pos), one_hot_severity(sev), F.array(F.coalesce(1 - sift, F.lit(NEUTRAL)), F.coalesce(polyphen, F.lit(NEUTRAL)))]
    upto = {"L0": 1, "L1": 2, "L2": 3, "L3": 4, "L4": 4}
    if level not in upto:
        raise ValueError(f"unknown level {level!r}")
    return F.concat(*parts[: upto[level]])


def sex_covariate(sex: Column) -> Column:
    return F.when(sex == "M", 1.0).when(sex == "F", 0.0).otherwise(-1.0)


def maf_labels(edges: list[float]) -> list[str]:
    pct = [f"{e * 100}" for e in edges]
    return [f"<{pct[0]}%", *(f"{lo}-{hi}%" for lo, hi in zip(pct, pct[1:], strict=False)), f">{pct[-1]}%"]


def maf_bin(freq: Column, edges: list[float]) -> Column:
    """Label of the right-open frequency bin; a value on an edge is in the upper bin."""
    labels = maf_labels(edges)
    out = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels, strict=False))):
        out = F.when(freq < edge, label).otherwise(out)
    return out
