import random

import numpy as np

from varloom.plans.queries import hodges_lehmann


def test_every_call_of_a_gene_counts(spark, tmp_path):
    rng = random.Random(2)
    price, off, tax = (lambda: rng.randrange(1000, 9000) / 4), (lambda: rng.randrange(9) / 8), (lambda: rng.randrange(9) / 8)
    lines = [(1 + i % 5, 1 + (i % 4 if i < 80 else 4), 10.0, price(), off(), tax()) for i in range(80 + 1001)]
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put(lines, "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double", "lineitem")
    put([(i, i) for i in range(1, 6)], "o_orderkey long, o_custkey long", "orders")
    put([(i, "BUILDING") for i in range(1, 6)], "c_custkey long, c_mktsegment string", "customer")
    put([(i, i, ("A", "A", "B", "C", "D")[i - 1], "T") for i in range(1, 6)], "p_partkey long, p_size int, p_brand string, p_type string", "part")
    by = {}
    for _, part, _, p, d, t in lines:
        a, b = by.setdefault(("A_T", "A_T", "B_T", "C_T", "D_T")[part - 1], ([], []))
        a.append(np.floor(p * t + 0.5))
        b.append(np.floor(p * d + 0.5))
    want = {g: np.median(np.subtract.outer(a, b)) if len(a) * len(b) <= 1_000_000 else np.median(a) - np.median(b) for g, (a, b) in by.items()}
    assert {r.gene: r["shift"] for r in hodges_lehmann(spark, str(tmp_path)).collect()} == want and len(by["D_T"][0]) == 1001
