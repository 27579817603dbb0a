"""Ranks, running sums and running minima over a whole table without a single-task window.

A table is first reduced to its distinct values with their counts, so ties are one row. Values are then
dealt out by PARTS quantiles of themselves; inside a part a window runs over its own rows alone, and what
the parts before it hold is carried over as an offset, PARTS numbers a group. A table is written to the shared
folder before it is ranked: it is read for the quantiles, the parts' sums and the ranks, is computed once, and
chains of ranks don't multiply their plans. Nulls are the smallest value and NaN the largest, as in Spark's own order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.sources.scratch import scratch

PARTS = 64


def written(df: DataFrame) -> DataFrame:
    """df as a table of the shared folder."""
    path = scratch(df.sparkSession, "ordered")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right's other columns where all keys are the same; nulls are the same as nulls."""
    renamed = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]  # by name: both may come from one table
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(renamed, cond, how).drop(*[f"_k_{k}" for k in keys])


def parted(counts: DataFrame, value: str) -> DataFrame:
    """Adds _part, the place of the value between the quantiles; equal values share one."""
    cuts = F.percentile_approx(F.col(value).cast("double"), F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)]), F.lit(1000))
    bounds = counts.agg(F.coalesce(F.array_distinct(cuts), F.array().cast("array<double>")).alias("_cuts"))  # one row
    part = F.size(F.filter("_cuts", lambda q: q < F.coalesce(F.col(value).cast("double"), F.lit(float("-inf")))))
    return counts.crossJoin(F.broadcast(bounds)).withColumn("_part", part).drop("_cuts")


def _carried(parts: DataFrame, by: tuple[str, ...], columns: list[str], fold, start) -> DataFrame:  # noqa: ANN001
    """(by, _part) with what fold makes of the columns of all smaller parts, and of all parts (_all)."""
    a = parts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_part", *columns))).alias("_a"))  # PARTS structs a group
    over = lambda x, c: F.aggregate(F.transform(x, lambda s: s[c]), start(c), fold)
    rows = F.transform("_a", lambda s, i: F.struct(s["_part"].alias("_part"), *[over(F.slice("_a", 1, i), c).alias(f"{c}_carried") for c in columns], *[over(F.col("_a"), c).alias(f"{c}_all") for c in columns]))
    return a.select(*by, F.explode(rows).alias("_r")).select(*by, "_r.*")


def _offsets(x: DataFrame, offsets: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return same(x, offsets, [*by, "_part"]) if by else x.join(F.broadcast(offsets), "_part")  # PARTS rows


def running(counts: DataFrame, value: str, sums: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Adds, for each column c of sums, c_before (its sum over the smaller values of the group) and c_all.
    A row is a (by, value); counts should be read from a table, as it is used three times."""
    x = parted(counts, value)
    kinds = {c: "double" if t in ("double", "float") else "bigint" for c, t in counts.dtypes if c in sums}
    totals = x.groupBy(*by, "_part").agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in sums])
    offsets = _carried(totals, by, sums, lambda a, b: a + b, lambda c: F.lit(0).cast(kinds[c]))
    w = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    x = _offsets(x, offsets, by)
    return x.select(*counts.columns, *[(F.coalesce(F.sum(c).over(w), F.lit(0).cast(kinds[c])) + F.col(f"{c}_carried")).alias(f"{c}_before") for c in sums], *[f"{c}_all" for c in sums])


def lowest_from(rows: DataFrame, value: str, column: str, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds the least of the column over this and all larger values of the group. A row is a (by, value)."""
    rows = written(rows)
    x = parted(rows, value).withColumn("_part", -F.col("_part"))
    least = x.groupBy(*by, "_part").agg(F.min(column).alias("_low"))
    offsets = _carried(least, by, ["_low"], lambda a, b: F.least(a, b), lambda _: F.lit(float("inf")))
    w = Window.partitionBy(*by, "_part").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    return _offsets(x, offsets, by).select(*rows.columns, F.least(F.min(column).over(w), F.col("_low_carried")).alias(out))


def counted(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, value) with _n, its number of rows, _n_before, of smaller ones, _n_all, of all, and _null, of nulls."""
    c = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    c = c.withColumn("_z", F.when(F.col(value).isNull(), F.col("_n")).otherwise(F.lit(0)).cast("long"))
    return running(c, value, ["_n", "_z"], by).withColumnRenamed("_z_all", "_null").drop("_z", "_z_before")


def ranked(df: DataFrame, value: str, out: str, form: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """df with a rank that form makes of counted()'s columns."""
    df = written(df)
    return same(df, counted(df, value, by).select(*by, value, form.alias(out)), [*by, value])


def ahead(value: str, descending: bool, nulls_last: bool = True) -> Column:
    """How many rows come before a value, of counted()'s columns."""
    if descending:
        return F.col("_n_all") - F.col("_n_before") - F.col("_n")
    if not nulls_last:
        return F.col("_n_before")
    return F.when(F.col(value).isNull(), F.col("_n_all") - F.col("_null")).otherwise(F.col("_n_before") - F.col("_null"))


def place(df: DataFrame, out: str, value: str, *ties: Column, by: tuple[str, ...] = (), descending: bool = True) -> DataFrame:
    """1, 2, ... by a number and, where it is the same, by ties; nulls come last. Rows of one value meet in one task."""
    x = ranked(df, value, "_ahead", ahead(value, descending), by)
    return x.withColumn(out, (F.col("_ahead") + F.row_number().over(Window.partitionBy(*by, value).orderBy(*ties or (F.col(value),)))).cast("long")).drop("_ahead")
