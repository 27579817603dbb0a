"""Chromosome names, pseudoautosomal regions, ploidy and display order, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pseudoautosomal regions of the two public human builds, both ends included.
PAR = {
    "GRCh37": {"X": ((60001, 2699520), (154931044, 155260560)), "Y": ((10001, 2649520), (59034050, 59363566))},
    "GRCh38": {"X": ((10001, 2781479), (155701383, 156030895)), "Y": ((10001, 2781479), (56887903, 57217415))},
}
ALIASES = {"grch37": "GRCh37", "hg19": "GRCh37", "b37": "GRCh37", "grch38": "GRCh38", "hg38": "GRCh38", "b38": "GRCh38"}
SEX_CHROMS = ("X", "Y")
AUTOSOMES = tuple(str(i) for i in range(1, 23))


def build_name(name: str) -> str:
    try:
        return ALIASES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown genome build {name!r}; one of {sorted(ALIASES)}") from None


def normalise_chrom(c: Column) -> Column:
    """An exact lower-case chr prefix goes; 23 is X and 24 is Y; anything else stays."""
    bare = F.regexp_replace(c, "^chr", "")
    return F.when(bare == "23", "X").when(bare == "24", "Y").otherwise(bare)


def in_par(pos: Column, chrom: Column, build: str = "GRCh37") -> Column:
    out = F.lit(False)
    for name, spans in PAR[build_name(build)].items():
        for lo, hi in spans:
            out = out | ((chrom == name) & pos.between(lo, hi))
    return out


def is_sex_chrom(chrom: Column) -> Column:
    return normalise_chrom(chrom).isin(*SEX_CHROMS)


def is_autosome(chrom: Column) -> Column:
    return normalise_chrom(chrom).isin(*AUTOSOMES)


def ploidy_dosage(copies: Column, chrom: Column, pos: Column, sex: Column, build: str = "GRCh37") -> Column:
    """Copies of the alternate allele; doubled for a male's X outside the PAR, null for a female's Y."""
    doubled = (chrom == "X") & (sex == "M") & ~in_par(pos, chrom, build)
    return F.when((chrom == "Y") & (sex == "F"), None).when(doubled, copies * 2).otherwise(copies)


def chrom_order(c: Column) -> Column:
    """Sort key: 1..22, X, Y, MT, then the rest by name."""
    name = normalise_chrom(c)
    n = F.when(name.rlike("^[0-9]+$"), name.try_cast("int")).when(name == "X", 1_000_000).when(name == "Y", 1_000_001).when(name.isin("MT", "M"), 1_000_002).otherwise(1_000_003)
    return F.struct(n.alias("n"), name.alias("name"))


def dense_index(rows, column: str, order: Column | None = None):  # noqa: ANN001, ANN201
    """(value, index from 0) of the distinct values of a column, in order."""
    from pyspark.sql import Window

    names = rows.select(column).where(F.col(column).isNotNull()).distinct()
    return names.withColumn("index", F.row_number().over(Window.orderBy(F.col(column) if order is None else order)) - 1)
