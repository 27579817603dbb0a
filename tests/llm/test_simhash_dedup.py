import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

from varloom.llm.simhash_dedup import GrayIndex, fingerprint, gray_rank, near_links, op10_simhash_dedup, simhash_groups


def slow_fingerprint(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(ids, fps):
    top = {i: i for i in range(len(fps))}
    find = lambda x: x if top[x] == x else find(top[x])
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                top[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(fps))]


TEXTS = [None, "", " \t\n", "a", "A b", "a b c d e f", "É B c", "x\x0by\x0cz w", "x y", "a b c d e f g"] + ["w" * 5000 + " " + "q r " * 3000]


def test_fingerprints():
    for t in [*TEXTS, *(" ".join(random.Random(i).choices("abc", k=i)) for i in range(50))]:
        assert fingerprint(t) == slow_fingerprint(t)


def test_gray_order():
    order = sorted(range(16), key=lambda x: int(gray_rank(np.array([x]))[0]))
    assert all((a ^ b).bit_count() == 1 for a, b in zip(order, order[1:], strict=False))


def test_index_finds_all_within_radius():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64)) for _ in range(60))]))
    index = GrayIndex(fps)
    got = {(int(a), int(b)) for w, p in index.within(index.fps) for a, b in zip(w, p, strict=True)}
    want = {(i, j) for i in range(len(fps)) for j in range(len(fps)) if int(index.fps[i] ^ index.fps[j]).bit_count() <= 2}
    assert got == want


@pytest.mark.parametrize("split", [50_000, 10])
def test_links_connect_what_pairs_connect(spark, split):
    rng = random.Random(5)
    fps = {0}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(15):
            fps.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3])))
    fps |= {(7 << 40) ^ (1 << a) ^ (1 << b) for a in range(8) for b in range(32)}
    fps = sorted(fps)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    got = near_links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), split).collect()
    top = {f: f for f in map(signed, fps)}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for r in got:
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2
        top[find(r.a)] = find(r.b)
    want = slow_components(list(range(len(fps))), fps)
    groups = {}
    for f, w in zip(fps, want, strict=True):
        groups.setdefault(w, set()).add(find(signed(f)))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    texts = list(TEXTS)
    for _ in range(40):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(60, 160))]
        for _ in range(rng.randrange(1, 5)):
            texts.append(" ".join(words))
            words[rng.randrange(len(words))] = "z"
    ids = [*range(100, 100 + len(texts) - 2), None, 100]
    spark.createDataFrame([Row(doc_id=i, text=t, fp=1, component_id="x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, fp int, component_id string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(repr, map(tuple, op10_simhash_dedup(spark, str(tmp_path)).collect())))
    fps = [slow_fingerprint(t) for t in texts]
    assert got == sorted(map(repr, zip(ids, (f"{f:016x}" for f in fps), slow_components(ids, fps), strict=True)))


def test_no_rows(spark):
    assert simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
