import random
import re
from collections import Counter
from functools import cache

from pyspark.sql import functions as F

import varloom.llm.decontaminate as dc
from varloom.llm.decontaminate import find_leaks, op8_decontaminate, stage


def slow(docs, items):
    words = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).split()
    out = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            k = min(5, len(v))
            if not v:
                continue
            shingles = lambda x: Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1))  # noqa: E731, B023
            b = shingles(v)
            for s in range(len(w) - len(v) + 1):
                a = shingles(w[s : s + len(v)])
                low = sum((a & b).values())
                if low / sum((a | b).values()) >= 0.8:
                    old = out.get((d, text, i), (0, 0))
                    out[d, text, i] = (max(old[0], low / sum((a | b).values())), old[1] + 1)
    return sorted((str(d), i, round(s, 9), n) for (d, _, i), (s, n) in out.items())


def make():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefg", k=4))
    items = [(i, " ".join(word() for _ in range(rng.choice([16, 16, 25, 40, 58])))) for i in range(12)]
    items += [(20, "tiny one"), (21, None), (22, "!!"), (23, items[0][1]), (24, "la la la la la la la la la la la la")]
    docs = []
    for i in range(70):
        body = [word() for _ in range(rng.randrange(80))]
        if i % 2:
            v = items[i % 12][1].split()
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(v))
                rng.choice([lambda: v.__setitem__(at, "zzz"), lambda: v.insert(at, "yyy"), lambda: v.pop(at)])()  # noqa: B023
            at = rng.randrange(len(body) + 1)
            body[at:at] = [x.upper() + "," for x in v]
        docs.append((i, " ".join(body)))
    docs += [(100, None), (101, ""), (102, "Tiny... ONE"), (103, "la " * 40), (None, items[3][1]), (1, items[4][1]), (5, docs[5][1]), (104, "word " * 2_000 + items[5][1])]
    return docs, items


@cache
def want():
    docs, items = make()
    return slow(sorted(set(docs), key=str), items)


def test_against_brute_force(spark, tmp_path):
    docs, items = make()
    spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, similarity int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((str(r.doc_id), r.item_id, round(r.similarity, 9), r.windows) for r in op8_decontaminate(spark, str(tmp_path)).collect())
    assert got == want() and len(got) > 15
    left = stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    assert {str(r.doc_id) for r in left} == {str(d) for d, _ in docs} - {w[0] for w in want()}


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)
    docs, items = make()
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count()
    assert got == len(want())


def test_blocks_cover_the_word_and_pairs_meet_once(spark):
    assert len(dc.BLOCKS) == dc.RADIUS + 1 and sorted(b for at, w in dc.BLOCKS for b in range(at, at + w)) == list(range(64))
    rng = random.Random(1)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = [(signed(sum(1 << b for b in rng.sample(range(64), rng.randrange(22)))),) for _ in range(200)]
    assert spark.createDataFrame(rows, "x long").select(dc._first_shared(F.col("x")).alias("b")).where("b < 0").count() == 0


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert find_leaks(docs.limit(0), items).count() == 0 and find_leaks(docs, items.limit(0)).count() == 0 and find_leaks(docs, items).count() == 1


def test_recall_at_the_threshold(spark):
    """Windows at 0.80 to 0.84, right above the threshold, of which the fingerprint radius must lose next to none."""
    rng = random.Random(12)
    items, docs = [], []
    for i in range(400):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        items.append((i, " ".join(words)))
        words[rng.randrange(5, 55)] = "x"
        if i % 2:
            words[-1] = "y"
        docs.append((i, " ".join([*(f"b{j}" for j in range(10)), *words, "end"])))
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {r.doc_id for r in got if r.doc_id == r.item_id and 0.8 <= r.similarity < 0.85}
    assert len(found) >= 0.99 * len(items)
