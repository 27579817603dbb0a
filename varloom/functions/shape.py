"""Shapes of score distributions: standardised values, k-sample Anderson-Darling, densities, a verdict on two shapes.

Groups are given as a list of a few names (real and null). Nulls and values that are not finite take no part.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions import ordered

EULER = 0.5772156649015329
#: Critical values of the standardised statistic by m = k - 1: b0 + b1 / sqrt(m) + b2 / m (Scholz and Stephens
#: 1987, with the two outer levels of later tables). Fixed values.
LEVELS = (0.25, 0.1, 0.05, 0.025, 0.01, 0.005, 0.001)
B0 = (0.675, 1.281, 1.645, 1.96, 2.326, 2.573, 3.085)
B1 = (-0.245, 0.25, 0.678, 1.149, 1.822, 2.364, 3.615)
B2 = (-0.105, -0.305, -0.362, -0.391, -0.396, -0.345, -0.154)


def finite(df: DataFrame, value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def standardised(df: DataFrame, value: str, group: str, out: str = "z") -> DataFrame:
    """z by the group's mean and population deviation; a group of one value has z 0."""
    df = ordered.written(finite(df, value))
    facts = df.groupBy(group).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    # a row a group: joined by a shuffle, all rows of a group would meet in one task
    return df.join(F.broadcast(facts), group).withColumn(out, F.coalesce(F.try_divide(F.col(value) - F.col("_m"), F.col("_s")), F.lit(0.0))).drop("_m", "_s")


def harmonic(n: Column, power: int = 1) -> Column:
    """1 + 1/2^p + ... + 1/n^p for p 1 or 2: a table below 20, the asymptotic series from there on."""
    table = F.array(*[F.lit(float(sum(i**-power for i in range(1, k + 1)))) for k in range(20)])
    x = F.greatest(n, F.lit(20)).cast("double")
    if power == 1:
        series = F.ln(x) + EULER + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, F.lit(4))) - 1 / (252 * F.pow(x, F.lit(6)))
    else:
        series = math.pi**2 / 6 - 1 / x + 1 / (2 * x * x) - 1 / (6 * F.pow(x, F.lit(3))) + 1 / (30 * F.pow(x, F.lit(5)))
    return F.when(n < 20, F.get(table, n.cast("int"))).otherwise(series)


def anderson_darling(df: DataFrame, value: str, group: str, groups: list[str]) -> DataFrame:
    """One row: n, statistic (midrank form for ties, standardised by its exact mean and deviation) and p_value,
    interpolated between the levels 0.25 and 0.001 and held there. Null with under four rows, an empty group or a
    single distinct value. One pass over the distinct values with running counts; no row is sorted in one task."""
    k = len(groups)
    f = [f"_f{i}" for i in range(k)]
    rows = finite(df, value).where(F.col(group).isin(groups))
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("_l"), *[F.count_if(F.col(group) == g).alias(c) for g, c in zip(groups, f, strict=True)])
    x = ordered.running(ordered.written(counts), value, ["_l", *f])
    n, b = F.col("_l_all").cast("double"), F.col("_l_before") + F.col("_l") / F.lit(2.0)
    width = b * (n - b) - n * F.col("_l") / 4
    part = [F.sum(F.try_divide(F.col("_l") / n * F.pow(n * (F.col(f"{c}_before") + F.col(c) / F.lit(2.0)) - F.col(f"{c}_all") * b, F.lit(2)), width)) for c in f]
    sums = x.agg(F.max("_l_all").alias("n"), *[p.alias(f"_s{i}") for i, p in enumerate(part)], *[F.max(f"{c}_all").alias(c) for c in f])
    total = sums.select("n", sum((F.try_divide(F.col(f"_s{i}"), F.col(c)) for i, c in enumerate(f)), F.lit(0.0)).alias("_s"), sum((F.try_divide(F.lit(1.0), F.col(c)) for c in f), F.lit(0.0)).alias("_h"))
    total = total.withColumn("_a", (F.col("n") - 1) / F.col("n") * F.col("_s")).withColumn("h", harmonic(F.col("n") - 1))
    up = harmonic(F.col("n"))
    total = total.withColumn("g", F.col("h") * F.col("h") - up * up + harmonic(F.col("n"), 2))
    n, h, g, sizes = F.col("n").cast("double"), F.col("h"), F.col("g"), F.col("_h")
    a = (4 * g - 6) * (k - 1) + (10 - 6 * g) * sizes
    c2 = (2 * g - 4) * k * k + 8 * h * k + (2 * g - 14 * h - 4) * sizes - 8 * h + 4 * g - 6
    c1 = (6 * h + 2 * g - 2) * k * k + (4 * h - 4 * g + 6) * k + (2 * h - 6) * sizes + 4 * h
    c0 = (2 * h + 6) * k * k - 4 * h * k
    variance = F.try_divide(a * F.pow(n, F.lit(3)) + c2 * n * n + c1 * n + c0, (n - 1) * (n - 2) * (n - 3))
    made = total.select("n", F.when(F.col("n") >= 4, F.try_divide(F.col("_a") - (k - 1), F.sqrt(variance))).alias("statistic"))
    return made.withColumn("p_value", _level(F.col("statistic"), k - 1))


def _level(statistic: Column, m: int) -> Column:
    critical = np.array(B0) + np.array(B1) / math.sqrt(m) + np.array(B2) / m
    a, b, c = map(float, np.polyfit(critical, np.log(LEVELS), 2))
    inside = F.exp(F.lit(a) * statistic * statistic + F.lit(b) * statistic + F.lit(c))
    return F.when(statistic < float(critical.min()), LEVELS[0]).when(statistic > float(critical.max()), LEVELS[-1]).otherwise(inside)


def density(df: DataFrame, value: str, group: str, points: int = 500, pad: float = 0.5) -> DataFrame:
    """(group, i, x, density): Gaussian density of each group on one grid of points from the least value less pad to
    the largest plus pad, Scott's bandwidth. Each value is shared between its two grid points, so that only points x
    groups masses are convolved, whatever the rows; the error is of the order of (grid step / bandwidth)^2 / 12. Groups of
    under three values or without spread have density 0, as has every group of an empty table."""
    rows = ordered.written(finite(df, value).select(F.col(group), F.col(value).cast("double").alias("_v")))
    ends = rows.agg((F.min("_v") - pad).alias("_lo"), ((F.max("_v") - F.min("_v") + 2 * pad) / (points - 1)).alias("_step"))  # one row
    facts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("_v").alias("_s")).crossJoin(F.broadcast(ends))
    u = (F.col("_v") - F.col("_lo")) / F.col("_step")
    at = rows.crossJoin(F.broadcast(ends)).select(group, F.floor(u).alias("_i"), (u - F.floor(u)).alias("_r"))
    two = F.array(F.struct(F.col("_i").alias("j"), (1 - F.col("_r")).alias("m")), F.struct((F.col("_i") + 1).alias("j"), F.col("_r").alias("m")))
    mass = at.select(group, F.explode(two).alias("_e")).groupBy(group, F.col("_e.j").alias("_j")).agg(F.sum("_e.m").alias("_m"))
    grid = facts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    h = F.col("_s") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    far = F.try_divide((F.col("i") - F.col("_j")) * F.col("_step"), h)
    made = grid.join(F.broadcast(mass), group).groupBy(group, "i").agg(F.max("_lo").alias("_lo"), F.max("_step").alias("_step"), F.max("_n").alias("_n"), F.max("_s").alias("_s"), F.sum(F.col("_m") * F.exp(-far * far / 2)).alias("_d"))
    flat = (F.col("_n") < 3) | (F.col("_s") < 1e-12)
    return made.select(group, "i", (F.col("_lo") + F.col("i") * F.col("_step")).alias("x"), F.when(flat, 0.0).otherwise(F.try_divide(F.col("_d"), F.col("_n") * h * math.sqrt(2 * math.pi))).alias("density"))


def compare_shapes(df: DataFrame, value: str, group: str, real: str, null: str) -> DataFrame:
    """One row: skewness, excess kurtosis and share beyond three deviations of both groups, Anderson-Darling of
    the standardised values, and what the differences suggest."""
    z = ordered.written(standardised(df, value, group).select(group, F.round("z", 9).alias("z")))  # no ties lost to rounding of sums
    facts = []
    for name, g in (("real", real), ("null", null)):
        own = F.when(F.col(group) == g, F.col("z"))
        facts += [F.skewness(own).alias(f"skew_{name}"), F.kurtosis(own).alias(f"kurtosis_{name}"), F.avg((F.abs(own) > 3).cast("double")).alias(f"tail_{name}")]
    row = z.agg(*facts)
    test = anderson_darling(z, "z", group, [real, null]).select(F.col("statistic").alias("anderson"), F.col("p_value").alias("anderson_p"))
    heavier, tilted = F.col("kurtosis_real") - F.col("kurtosis_null"), F.abs("skew_real") - F.abs("skew_null")
    kind = F.when((heavier > 0.5) & (tilted > 0.2), "concentrated").when(heavier > 0.5, "heavier_tails").when((F.abs(heavier) <= 0.5) & (F.abs(tilted) <= 0.2), "similar").otherwise("different")
    return row.crossJoin(F.broadcast(test)).withColumn("shape", kind)
