"""Ranks, corrections and exact tests as Column builders and DataFrame operators."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions import ordered

INT_MAX = 2**63 - 1


def _w(by: tuple[str, ...], *order: Column):  # noqa: ANN202
    return Window.partitionBy(*by).orderBy(*order)


def average_rank(df: DataFrame, value: str, out: str, by: tuple[str, ...] = (), descending: bool = True) -> DataFrame:
    """Ties share the mean of their places."""
    return ordered.ranked(df, value, out, ordered.ahead(value, descending, False) + (F.col("_n") + 1) / F.lit(2.0), by)


def min_rank(df: DataFrame, value: str, out: str, by: tuple[str, ...] = (), descending: bool = True) -> DataFrame:
    """Ties share the first place; nulls come last."""
    return ordered.ranked(df, value, out, ordered.ahead(value, descending) + 1, by)


def position_rank(*order: Column, by: tuple[str, ...] = ()) -> Column:
    return F.row_number().over(_w(by, *order))


def rank_quantile(df: DataFrame, value: str, out: str, key: str) -> DataFrame:
    """Share of the positive finite values at or below a row's; 0 for the other rows."""
    df = ordered.written(df)
    ok = df.where((F.col(value) > 0) & ~F.isnan(value) & (F.col(value) < F.lit(float("inf"))))
    q = ordered.counted(ok, value).select(value, ((F.col("_n_before") + F.col("_n")) / F.col("_n_all")).alias(out))
    return ordered.same(df, q, [value], "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def group_z(df: DataFrame, value: str, out: str, by: tuple[str, ...]) -> DataFrame:
    """z-score within a group by sample deviation; a zero or missing deviation counts as 1."""
    facts = df.groupBy(*by).agg(F.avg(value).alias("_mean"), F.coalesce(F.nullif(F.stddev_samp(value), F.lit(0.0)), F.lit(1.0)).alias("_std"))
    return ordered.same(df, facts, list(by)).withColumn(out, (F.col(value) - F.col("_mean")) / F.col("_std")).drop("_mean", "_std")


def empirical_p(real: DataFrame, null: DataFrame, score: str, out: str = "p_value") -> DataFrame:
    """(k + 1) / (N + 1) with k null scores at or above each real one. Running counts over the distinct
    scores of both take the place of comparing all pairs."""
    both = real.select(score, F.lit(0).alias("_null")).union(null.select(score, F.lit(1)))
    counts = ordered.running(ordered.written(both.groupBy(score).agg(F.sum("_null").alias("_null"))), score, ["_null"])
    p = (F.col("_null_all") - F.col("_null_before") + 1) / (F.col("_null_all") + 1)
    return ordered.same(real, counts.select(score, p.alias(out)), [score])


def bh_fdr(df: DataFrame, p: str, out: str = "fdr", by: tuple[str, ...] = ()) -> DataFrame:
    """Benjamini-Hochberg: p n / rank, made monotone from the largest p down, 1 at most. Null where p is."""
    df = ordered.written(df)
    c = ordered.counted(df.where(F.col(p).isNotNull()), p, by)
    q = c.select(*by, p, (F.col(p) * F.col("_n_all") / (F.col("_n_before") + F.col("_n"))).alias("_q"))
    low = ordered.lowest_from(q, p, "_q", "_low", by)
    return ordered.same(df, low.select(*by, p, F.least(F.lit(1.0), "_low").alias(out)), [*by, p], "left")


def correct(df: DataFrame, p: str, method: str, alpha: float = 0.05, out: str = "p_adjusted") -> DataFrame:
    if method == "none":
        df = df.withColumn(out, F.col(p))
    elif method == "bonferroni":
        tests = df.agg(F.count(p).alias("_tests"))  # one row
        df = df.crossJoin(F.broadcast(tests)).withColumn(out, F.least(F.lit(1.0), F.col(p) * F.col("_tests"))).drop("_tests")
    elif method == "fdr_bh":
        df = bh_fdr(df, p, out)
    else:
        raise ValueError(f"unknown correction {method!r}")
    return df.withColumn("reject", F.col(out) < alpha)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def log_factorial_of(k: Column) -> Column:
    """log k!: a table up to 15, Stirling's series above."""
    first = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])

    def series(x: Column) -> Column:
        return (x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5)))

    return F.when(k < 16, F.get(first, k.cast("int"))).otherwise(let(F.greatest(k, F.lit(16)).cast("double"), series))


def log_factorial(n: str) -> Column:
    """Column of log k! for k = 0..n, for few rows and small n; fisher() needs none."""
    return F.transform(F.sequence(F.lit(0), F.col(n)), log_factorial_of)


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _decreasing(x: int, end: int, step: int, row: int, col: int, total: int, chunk: int = 4096) -> float:
    """Sum of hypergeometric probabilities from x, at or beyond the mode, outward to end, by the ratios of neighbours.
    It ends where all that follow, at most a geometric series, are below the last bit of the sum."""
    rel, out, free = 1.0, 1.0, total - row - col
    while x != end:
        k = np.arange(x, min(x + chunk, end), dtype=float) if step > 0 else np.arange(x, max(x - chunk, end), -1, dtype=float)
        ratio = (row - k) * (col - k) / ((k + 1) * (free + k + 1)) if step > 0 else k * (free + k) / ((row - k + 1) * (col - k + 1))
        terms = rel * np.cumprod(ratio)
        rel, out, x = float(terms[-1]), out + float(terms.sum()), x + step * len(k)
        if ratio[-1] < 1 and rel * ratio[-1] <= 1e-17 * out * (1 - ratio[-1]):
            break
    return out


def fisher_p(n11: int, row: int, col: int, total: int, side: str) -> float:
    """Fisher's exact p in a number of steps of the order of the distribution's deviation, not of its margins."""
    lo, hi = max(0, row + col - total), min(row, col)
    log_pmf = lambda k: _log_choose(row, k) + _log_choose(total - row, col - k) - _log_choose(total, col)
    mode = min(max((row + 1) * (col + 1) // (total + 2), lo), hi)
    down = lambda k: math.exp(log_pmf(k)) * _decreasing(k, lo, -1, row, col, total) if k >= lo else 0.0
    up = lambda k: math.exp(log_pmf(k)) * _decreasing(k, hi, 1, row, col, total) if k <= hi else 0.0
    if side == "greater":
        return 0.0 if n11 > hi else min(1.0, up(n11) if n11 > mode else 1 - down(min(n11, mode) - 1))
    if side == "less":
        return 0.0 if n11 < lo else min(1.0, down(n11) if n11 < mode else 1 - up(max(n11, mode) + 1))
    if n11 == mode or not lo <= n11 <= hi:
        return 1.0 if lo <= n11 <= hi else 0.0
    most = log_pmf(n11) + math.log1p(1e-7)
    near, far = (mode, hi + 1) if n11 < mode else (mode, lo - 1)  # the first place beyond the mode that is no likelier
    sign = 1 if far > near else -1
    a, b = 0, abs(far - near)
    while a < b:
        mid = (a + b) // 2
        a, b = (a, mid) if log_pmf(near + sign * mid) <= most else (mid + 1, b)
    y = near + sign * a
    return min(1.0, down(n11) + up(y) if sign > 0 else up(n11) + down(y))


def fisher(table: Column | None, n11: Column, row: Column, col: Column, total: Column, side: str = "greater") -> Column:
    """Fisher's exact p of a 2x2 table by its first cell and margins. A table of log factorials is not needed any more."""
    if side not in ("greater", "less", "two-sided"):
        raise ValueError(f"unknown alternative {side!r}")

    @F.pandas_udf("double")
    def p(a: pd.Series, r: pd.Series, c: pd.Series, n: pd.Series) -> pd.Series:
        rows = zip(a, r, c, n, strict=True)
        return pd.Series([None if any(pd.isna(v) for v in x) else fisher_p(*map(int, x), side) for x in rows], dtype=float)

    return p(*[x.cast("long") for x in (n11, row, col, total)])


def hypergeom_sf(table: Column | None, k: Column, drawn: Column, marked: Column, total: Column) -> Column:
    """P(X >= k)."""
    return fisher(table, k, drawn, marked, total, "greater")


def effective_n(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    """Harmonic cell size; 0 where a cell is empty."""
    cells = [n11, n10, n01, n00]
    return F.when(F.least(*cells) > 0, 1.0 / sum((F.lit(1.0) / F.nullif(c, F.lit(0)) for c in cells[1:]), F.lit(1.0) / F.nullif(cells[0], F.lit(0)))).otherwise(0.0)


def z_of(p: float) -> float:
    return NormalDist().inv_cdf(p)


def minimum_effect(n: Column, sigma: float, alpha: float, power: float = 0.8) -> Column:
    """Smallest effect detectable with an effective n; infinite without any."""
    return F.when(n > 0, F.lit((z_of(1 - alpha / 2) + z_of(power)) * sigma) / F.sqrt(F.nullif(n, F.lit(0.0)))).otherwise(F.lit(float("inf")))


def alpha_threshold(alpha: float, tests: int, method: str = "fdr_bh") -> float:
    if method not in ("none", "bonferroni", "fdr_bh"):
        raise ValueError(f"unknown correction {method!r}")
    return alpha / tests if method == "bonferroni" and tests > 0 else alpha


def n_for_effect(effect: float, sigma: float, alpha: float, power: float = 0.8) -> int:
    return INT_MAX if effect <= 0 else math.ceil(((z_of(1 - alpha / 2) + z_of(power)) * sigma / effect) ** 2)


def mann_whitney_u(df: DataFrame, value: str, group: str, by: tuple[str, ...] = ()) -> DataFrame:
    """n1, n0, U of group 1, AUC and the tie term for each key; the p-value is a normal tail with tie correction.
    Ranks are of distinct values, so no group's rows meet."""
    one = lambda g: F.count_if(F.col(group) == g)
    c = ordered.running(ordered.written(df.groupBy(*by, value).agg(one(1).alias("_a"), one(0).alias("_b"), F.count(F.lit(1)).alias("_n"))), value, ["_n"], by)
    rank = F.col("_n_before") + (F.col("_n") + 1) / F.lit(2.0)
    out = c.groupBy(*by).agg(F.sum("_a").alias("n1"), F.sum("_b").alias("n0"), F.sum(F.when(F.col("_a") > 0, F.col("_a") * rank)).alias("_s"), F.sum(F.col("_n") ** 3 - F.col("_n")).alias("tie_term"))
    out = out.withColumn("u", F.col("_s") - F.col("n1") * (F.col("n1") + 1) / F.lit(2.0)).drop("_s")
    return out.withColumn("auc", F.try_divide(F.col("u"), F.col("n1") * F.col("n0")))


def mann_whitney_p(df: DataFrame, side: str = "two-sided") -> DataFrame:
    """Adds p_value to mann_whitney_u()'s rows: continuity-corrected normal tail, as the public libraries do."""
    @F.pandas_udf("double")
    def tail(u: pd.Series, n1: pd.Series, n0: pd.Series, tie: pd.Series) -> pd.Series:
        out = []
        for x, a, b, t in zip(u, n1, n0, tie, strict=True):
            n = a + b
            var = a * b / 12 * ((n + 1) - t / (n * (n - 1))) if n > 1 else 0
            if not var > 0:
                out.append(1.0)
                continue
            d = {"greater": x - a * b / 2, "less": a * b / 2 - x}.get(side, abs(x - a * b / 2)) - 0.5
            p = math.erfc(d / math.sqrt(var) / math.sqrt(2)) / 2
            out.append(min(1.0, 2 * p if side == "two-sided" else p))
        return pd.Series(out, dtype=float)

    return df.withColumn("p_value", tail("u", "n1", "n0", "tie_term"))


def ks_statistic(df: DataFrame, value: str, group: str) -> DataFrame:
    """Largest distance of the two groups' distribution functions, over distinct values with their counts."""
    one = lambda g: F.count_if(F.col(group) == g)
    counts = ordered.running(ordered.written(df.groupBy(value).agg(one(1).alias("_a"), one(0).alias("_b"))), value, ["_a", "_b"])
    share = lambda c: (F.col(f"{c}_before") + F.col(c)) / F.col(f"{c}_all")
    return counts.select(F.abs(share("_a") - share("_b")).alias("d")).agg(F.max("d").alias("ks"))


def hodges_lehmann(df: DataFrame, a: str, b: str, by: str, most: int = 1_000_000) -> DataFrame:
    """Median of a - b over the pairs of a key's arrays, or the difference of medians beyond most pairs:
    values are gathered for keys of that many pairs at most."""
    sizes = df.groupBy(by).agg((F.count(a) * F.count(b)).alias("_pairs"), (F.median(a) - F.median(b)).alias("_far"))
    small = df.join(sizes.where(F.col("_pairs") <= most).select(by), by, "left_semi").groupBy(by).agg(F.collect_list(a).alias("_a"), F.collect_list(b).alias("_b"))
    pairs = F.array_sort(F.flatten(F.transform("_a", lambda x: F.transform("_b", lambda y: x - y))))
    n = F.size("_p")
    middle = (F.get("_p", F.floor((n - 1) / 2).cast("int")) + F.get("_p", F.floor(n / 2).cast("int"))) / 2
    near = small.select(by, pairs.alias("_p")).select(by, middle.alias("_near"))
    return sizes.join(near, by, "left").select(by, F.coalesce("_near", "_far").alias("shift"))


def middle_difference(a, b) -> float:  # noqa: ANN001
    """Median of all a[i] - b[j], by selection in their sorted matrix: rows are cut between two bounds, and a
    median of the rows' middles is the next guess, so the pairs are never built. Bounds are searched in all rows at once."""
    a, b = np.sort(np.asarray(a, float)), np.sort(np.asarray(b, float))[::-1]  # rows a[i] - b ascend
    n = len(a) * len(b)
    k = (n - 1) // 2
    lo, hi = np.zeros(len(a), np.int64), np.full(len(a), len(b), np.int64)

    def count(x: float, ties: bool) -> np.ndarray:
        """How many of each row are smaller than x (with ties: or the same), which is between its bounds."""
        i, j = lo.copy(), hi.copy()
        while len(live := np.flatnonzero(i < j)):
            mid = (i[live] + j[live]) // 2
            d = a[live] - b[mid]
            go = d <= x if ties else d < x
            i[live[go]], j[live[~go]] = mid[go] + 1, mid[~go]
        return i

    while True:
        live = np.flatnonzero(hi > lo)
        mid = (lo[live] + hi[live]) // 2
        guess = a[live] - b[mid]
        order = np.argsort(guess)
        weight = np.cumsum((hi - lo)[live][order])
        x = guess[order][np.searchsorted(weight, (weight[-1] + 1) // 2)]
        below, upto = count(x, False), count(x, True)
        if k < below.sum():
            hi = below
        elif k >= upto.sum():
            lo = upto
        else:
            break
    if n // 2 < upto.sum():
        return float(x)
    more = np.flatnonzero(upto < len(b))
    return float((x + (a[more] - b[upto[more]]).min()) / 2)


def shifts(df: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """(by, shift): median of b - a over all of a key's pairs, null where a side has none. A key's two columns of
    numbers are gathered, one key at a time; the pairs are not."""

    def middle(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[a].dropna().to_numpy(float), pdf[b].dropna().to_numpy(float)
        return pd.DataFrame({by: pdf[by].iloc[:1], "shift": [middle_difference(y, x) if len(x) and len(y) else None]}).astype({"shift": "float64"})

    rows = df.select(by, F.col(a).cast("double").alias(a), F.col(b).cast("double").alias(b))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be coalesced
    return rows.repartition(parts, by).groupBy(by).applyInPandas(middle, f"{by} {df.schema[by].dataType.simpleString()}, shift double")


def ks_p(d: float, n: int, m: int, exact: int = 4_000_000) -> float:
    """Two-sided p of a Kolmogorov-Smirnov distance of n against m values: lattice paths that stay within the
    distance, or Kolmogorov's series where n m is beyond exact."""
    if not n or not m:
        return 1.0
    if n * m > exact:
        x = d * math.sqrt(n * m / (n + m))
        return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))) if x > 0.2 else 1.0
    h = round(d * n * m)  # the distance is a whole number of steps of 1 / (n m)
    inside = np.zeros(n + 1)
    inside[0] = 1.0
    i = np.arange(n + 1)
    for s in range(1, n + m + 1):  # a path's s-th step ends in i values of the first and s - i of the second
        j = s - i
        moved = np.concatenate([[0.0], inside[:-1]])
        inside = np.where((j >= 0) & (j <= m) & (np.abs(i * m - j * n) < h), (moved * i + inside * np.maximum(j, 0)) / s, 0.0)
    return float(min(1.0, max(0.0, 1 - inside[n])))


def with_ks_p(df: DataFrame, d: str, n: str, m: str, out: str = "p_value") -> DataFrame:
    @F.pandas_udf("double")
    def p(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([ks_p(x, int(a), int(b)) for x, a, b in zip(d, n, m, strict=True)], dtype=float)

    return df.withColumn(out, p(d, n, m))


def percentile_interval(value: str, lo: float = 0.025, hi: float = 0.975) -> Column:
    return F.percentile(value, F.array(F.lit(lo), F.lit(hi)))


def bce_loss(logit: Column, label: Column) -> Column:
    """Mean binary cross-entropy of logits, in the form that can't overflow."""
    return F.avg(F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit))))
