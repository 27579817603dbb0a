import random
import re
from collections import Counter

import pytest

import varloom.llm.decontaminate as dc
from varloom.llm.decontaminate import find_leaks


def slow(docs, items):
    words = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).split()
    out = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            k = min(5, len(v))
            if not v or not w:
                continue
            shingles = lambda x: Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1))  # noqa: E731, B023
            b = shingles(v)
            for s in range(max(1, len(w) - len(v) + 1)):
                a = shingles(w[s : s + len(v)])
                part = sum((a & b).values()) / sum((a | b).values())
                if part >= 0.8:
                    old = out.get((d, text, i), (0, 0))
                    out[d, text, i] = (max(old[0], part), old[1] + 1)
    return sorted((str(d), i, round(s, 9), n) for (d, _, i), (s, n) in out.items())


@pytest.mark.parametrize("rows", [100_000, 0])
def test_texts_shorter_than_an_item(spark, monkeypatch, rows):
    monkeypatch.setattr(dc, "BROADCAST_ROWS", rows)
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefg", k=4))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([100, 30, 25, 20])] + [(7, "one two three four"), (8, "la " * 20)]
    long = items[0][1].split()
    docs = [(0, " ".join(long[:95])), (1, " ".join(long[5:])), (2, " ".join([*long[:40], "x", *long[41:95]])), (3, " ".join(long[:60])), (4, "one two three"), (5, "la " * 17), (6, "la " * 15), (9, " ".join(long[:85])), (10, " ".join(long[:80]))]
    docs += [(20 + j, " ".join(items[1 + j % 3][1].split()[: -1 - j % 6])) for j in range(18)] + [(None, docs[0][1]), (1, docs[1][1]), (40, ""), (41, None)]
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = slow(sorted(set(docs), key=str), items)
    assert sorted((str(r.doc_id), r.item_id, round(r.similarity, 9), r.windows) for r in got) == want
    assert ("0", 0, round(91 / 96, 9), 1) in want and len(want) > 10
