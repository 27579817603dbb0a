import math
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import varloom.llm.sentencepiece_sampling as sps
from varloom.llm.sentencepiece_sampling import Lattices, Pieces, decode_ids, encode_samples, op7_sentencepiece


@pytest.fixture(scope="module")
def pieces():
    return Pieces()


def every(pieces, unit):
    """All segmentations of a unit with their probabilities, by plain recursion."""
    arcs = pieces.lattice(unit)[0]

    def go(i):
        if i == len(unit):
            yield (), 0.0
        else:
            for lp, j, ids in arcs[i]:
                for seg, rest in go(j):
                    yield ids + seg, lp + rest

    found = {s: math.exp(lp) for s, lp in go(0)}
    total = sum(found.values())
    return {s: p / total for s, p in found.items()}


def test_both_lattices_agree(pieces):
    units = ["▁hello", "héé漢", "\udc81x", "\n", "▁▁▁a", "▁hello", "\ue000", "x" * 300]
    both = Lattices(pieces, units)
    for i, unit in enumerate(units):
        arcs, mass = pieces.lattice(unit)
        node = both.root[i]
        assert math.isclose(both.mass[node], mass[0], rel_tol=1e-12)
        fan = slice(both.at[node], both.at[node] + len(arcs[0]))
        assert np.allclose(sorted(both.log_p[fan]), sorted(a[0] for a in arcs[0])) and both.upto[fan][-1] == 1 << sps.BITS


def test_samples_follow_the_distribution_without_replacement(pieces):
    text = "ab on"
    units = [every(pieces, "▁ab"), every(pieces, "▁on")]
    want = {s + t: p * q for s, p in units[0].items() for t, q in units[1].items()}
    n, first, second = 6000, Counter(), Counter()
    inclusion = Counter()
    for seed in range(n):
        got = pieces.sample(text, xxhash.xxh64_intdigest(str(seed)))
        keys = [tuple(g[0]) for g in got]
        assert len(set(keys)) == 2
        for key, (_, lp, inc) in zip(keys, got, strict=True):
            assert math.isclose(math.exp(lp), want[key], rel_tol=1e-6)
            inclusion[key] += 1 / inc
        first[keys[0]] += 1
        second[keys[1]] += 1
    for key, p in want.items():
        assert abs(first[key] / n - p) < 0.03
        exact = sum(q * p / (1 - q) for other, q in want.items() if other != key)
        assert abs(second[key] / n - exact) < 0.03
    for key in sorted(want, key=want.get)[-2:]:
        assert abs(inclusion[key] / n - 1) < 0.1  # Horvitz-Thompson weights


def test_all_segmentations_are_found_in_order_of_search(pieces):
    want = every(pieces, "▁abc")
    got = pieces.sample("abc", 1, k=10_000)
    found = Counter(tuple(g[0]) for g in got)
    assert max(found.values()) == 1 and {s for s, p in want.items() if p > 1e-9} <= set(found) <= set(want)
    assert all(g[2] == 1.0 for g in got)


TEXTS = [None, "", " ", "a  b\n\n c ", "▁literal ▁ and é漢字 🙂", "x" * 400, "word " * 30_000, "\x00\t ", "</s> <s><0x0A>"]


def test_round_trip_and_grouping(pieces):
    texts = [t or "" for t in TEXTS]
    for k in (2, 3):
        together = pieces.sample_texts(texts * 2, list(range(len(texts))) * 2, k)
        for i, t in enumerate(texts):
            got = pieces.sample(t, i, k)
            assert all(pieces.decode(g[0].tolist()) == t for g in got)
            assert len({tuple(g[0]) for g in got}) == len(got)
            for other in (together[i], together[i + len(texts)]):
                assert [(*g[0], *g[1:]) for g in got] == [(*g[0], *g[1:]) for g in other]


def test_table(spark, tmp_path):
    df = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, samples int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = op7_sentencepiece(spark, str(tmp_path)).collect()
    assert len(rows) == 2 * len(TEXTS) and all(r.round_trip for r in rows)
    by = {}
    for r in rows:
        assert by.setdefault(r.doc_id, r) == r
    assert by[1].n_samples == 0 and by[3].n_samples == 2 and len(set(by[3].ids_hash)) == 2
    got = decode_ids(encode_samples(df).select("doc_id", F.explode("samples.ids").alias("ids"))).collect()
    assert {(r.doc_id, r.decoded) for r in got} == {(i if i else None, t) for i, t in enumerate(TEXTS) if t}
    assert encode_samples(df.limit(0)).count() == 0
