from __future__ import annotations

import time

import numpy as np
import pyarrow as pa

from varloom.llm import near_dedup as nd


def test_a_prefix_has_the_most_frequent_shingles_last(spark):
    rng = np.random.default_rng(2)
    h = np.unique(rng.integers(-(2**63), 2**63 - 1, 60))
    common = np.sort(rng.choice(h, 50, replace=False))
    place = rng.permutation(len(common))
    of = dict(zip(common.tolist(), place.tolist(), strict=True))
    for n in (1, 7, 30, 60):
        g = np.sort(rng.choice(h, n, replace=False))
        want = [x for x in g.tolist() if x not in of] + sorted((x for x in g.tolist() if x in of), key=of.get)
        for threshold in (0.3, 0.8):
            assert nd.prefix(g, threshold, common, place).tolist() == want[: n - int(np.ceil(threshold * n - 1e-9)) + 1]
    assert nd.prefix(h, 0.8, h[:0], place[:0]).tolist() == h[: len(h) - int(np.ceil(0.8 * len(h))) + 1].tolist()
    docs = spark.createDataFrame([(f"a b c d e{' f' * (i % 3 > 0)}",) for i in range(900)], "text string")
    common, place = nd._common(docs, 5)
    few, many = (int(nd.shingles(t)[0]) for t in ("a b c d e", "b c d e f"))
    assert common.tolist() == sorted([few, many]) and place[common == many] < place[common == few]


def test_a_prefix_costs_no_pass_over_the_common_shingles():
    rng = np.random.default_rng(7)
    common = np.sort(rng.integers(-(2**63), 2**63 - 1, nd.MOST_COMMON))
    texts = [" ".join(map(str, rng.integers(0, 9000, 300))) for _ in range(300)]
    batch = pa.record_batch([pa.array(range(300), pa.int64()), pa.array(range(300), pa.int64()), pa.array(texts)], names=["doc_id", "tid", "text"])
    began = time.process_time()
    made = list(nd._prefixes(5, 0.8, common, np.arange(len(common)))(iter([batch])))
    assert time.process_time() - began < 3  # 300 searches of all common shingles by sorting took over 10
    assert made[0].num_rows == 300
