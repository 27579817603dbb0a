from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from varloom.functions import stats
from varloom.operators import cohort


def test_a_shift_is_of_all_pairs_however_many(spark):
    rng = np.random.default_rng(8)
    a, b = np.round(rng.exponential(300, 1201) * 2) / 2, np.round(rng.normal(900, 200, 1100) ** 2 / 500) / 2
    want = np.median(np.subtract.outer(b, a))
    assert want != np.median(b) - np.median(a) and len(a) * len(b) > 1_000_000
    rows = [("g", x, b[i] if i < len(b) else None) for i, x in enumerate(a.tolist())] + [("h", 1.0, 4.0), ("h", 3.0, None), ("n", 1.0, None)]
    df = spark.createDataFrame([(g, x, None if y is None else float(y)) for g, x, y in rows], "gene string, x double, y double")
    assert {r.gene: r["shift"] for r in stats.shifts(df, "x", "y", "gene").collect()} == {"g": want, "h": 2.0, "n": None}
    genes = cohort.gene_bootstrap(df.select("gene", F.col("x").alias("rank_real"), F.col("y").alias("rank_null"), (df.y - df.x).alias("delta_rank")))
    assert {r.gene: r.effect_size_hodges_lehmann for r in genes.collect()} == {"g": want, "h": None, "n": None}


def test_the_middle_of_even_numbers_of_pairs_and_of_ties():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a, b = (rng.integers(0, 4, k) / 2 for k in rng.integers(1, 30, 2))
        assert stats.middle_difference(a, b) == np.median(np.subtract.outer(a, b))
    a, b = rng.integers(0, 10**7, 40_000) / 2, rng.integers(0, 10**7, 36_000) / 2  # 1.4 thousand million pairs
    x, a = stats.middle_difference(a, b), np.sort(a)
    below, upto = (int(np.searchsorted(a, b + x, side).sum()) for side in ("left", "right"))
    assert below <= (len(a) * len(b) - 1) // 2 and len(a) * len(b) // 2 < upto
