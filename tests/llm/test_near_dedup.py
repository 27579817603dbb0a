import random

import varloom.llm.near_dedup as nd
from varloom.llm.near_dedup import near_groups, stage


def slow(texts, size=5, threshold=0.8):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    top = list(range(len(texts)))
    find = lambda x: x if top[x] == x else find(top[x])
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or (a and sets[j] and len(a & sets[j]) / len(a | sets[j]) >= threshold):
                top[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def make():
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(30)]
    texts = [None, "", " \n", "a b", "A b", "a b c d e", "a b c d e f"]
    for _ in range(30):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(20, 150))] + passage * (rng.random() < 0.5)
        texts.append(" ".join(words))
        for _ in range(rng.randrange(5)):
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = ["z"]
            texts.append(" ".join(words))
    base = [f"g{i}" for i in range(100)]
    texts += [" ".join([*base[:i], "y", *base[i + 1 :]]) for i in range(20)]
    rng.shuffle(texts)
    return texts


def test_groups_against_brute_force(spark, monkeypatch):
    texts = make()
    ids = [*range(100, 100 + len(texts) - 1), None]
    groups = {}
    for i, c in zip(ids, slow(texts), strict=True):
        groups.setdefault(c, []).append(i)
    lows = {c: min((i for i in g if i is not None), default=None) for c, g in groups.items()}
    want = sorted(map(repr, zip(ids, (lows[c] for c in slow(texts)), strict=True)))
    docs = spark.createDataFrame(list(zip(ids, texts, range(len(ids)), strict=True)), "doc_id long, text string, n int")
    assert sorted(map(repr, map(tuple, near_groups(docs).collect()))) == want
    assert 30 < len(groups) < len(texts) - 40
    monkeypatch.setattr(nd, "SAMPLE", 0.5)
    assert sorted(map(repr, map(tuple, near_groups(docs).collect()))) == want
    assert {r.doc_id for r in stage(spark, docs, "").collect()} == set(lows.values()) | {None}
    assert near_groups(docs.limit(0)).count() == 0


def test_the_pipeline_removes_near_copies(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(200)]
    near = [*words[:40], "x", *words[41:120], "y", *words[121:]]
    docs = spark.createDataFrame([(1, " ".join(words), "en", "s", 1), (2, " ".join(near), "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars int")
    assert [r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, "").collect()] == [1]


def test_copies_of_a_row_without_an_id(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(None, text), (2, text), (3, text), (None, "alone"), (None, "pair of rows"), (None, "pair of rows")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in near_groups(docs).collect()), key=str)
    assert got == sorted([(None, 2), (2, 2), (3, 2), (None, None), (None, None), (None, None)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in stage(spark, docs, "").collect()), key=str)
    assert kept == sorted([(None, text), (2, text), (None, "alone"), (None, "pair of rows"), (None, "pair of rows")], key=str)
