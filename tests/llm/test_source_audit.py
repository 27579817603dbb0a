from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from varloom.llm import source_audit
from varloom.llm.source_audit import Node, divergence, share, source_divergence

SCHEMA = "doc_id long, text string, lang string, source string, terms string, prefix int"
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least):
    docs = [((t or ""), (g or ""), (s or "")) for _, t, g, s, *_ in rows]
    groups = defaultdict(set)
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for t, g, s in docs:
        groups[g].add(s)
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(UPPER))
        df[g].update(set(words))
        counts[g, s].update(words)
    out = []
    for g, sources in groups.items():
        kept = [t for t, n in df[g].items() if n >= least]
        total = {s: sum(counts[g, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (counts[g, s][t] + 2) // (total[s] + 2 * len(kept)) for t in kept} for s in sources}
        whole = sum(total.values())
        q = {t: 1 + 10**9 * (sum(counts[g, s][t] for s in sources) + 2) // (whole + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), "pair", o) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), "term", t) for t in kept if counts[g, s][t] and p[s][t] > q[t]]
            for part, most in ((pairs, None), (terms, 10)):
                out += [(g, s, kind, item, -v, i + 1) for i, (v, _, kind, item) in enumerate(sorted(part)[:most])]
    return sorted(out)


def fixture(n, seed):
    rng = random.Random(seed)
    words = ["The", "the", "über", "Über", "naïve", "x1y", "ab", "abc", "abcd", "abcde", "a_b", "日本", "日本語", "z" * 50]
    rows = []
    for i in range(n):
        text = rng.choice([" ", ", ", "\n"]).join(rng.choice(words[: 4 + i % 11]) for _ in range(rng.randrange(40)))
        rows.append((i if i % 9 else None, text if i % 13 else None, rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "b", "", None, "é"]), "clash", 7))
    return rows + rows[:25]


@pytest.mark.parametrize(("node", "flush"), [(400_000, 600_000), (3, 20)])
def test_equals_brute_force_with_and_without_bursts(spark, node, flush):
    rows = fixture(300, 3)
    got = source_divergence(spark.createDataFrame(rows, SCHEMA).repartition(5), 10, node, flush)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 10)


def test_groups_without_terms_and_one_source(spark):
    rows = [(1, None, "en", "a", "", 0), (2, "", "en", "b", "", 0), (3, "12 34", "en", "c", "", 0), (4, "word", "de", "a", "", 0)]
    got = sorted(map(tuple, source_divergence(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == brute(rows, 10)
    assert len(got) == 6 and all(r[4] == 0 for r in got)


def test_empty_table(spark):
    assert source_divergence(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_text(spark):
    rows = [(i, "lorem ipsum " * 20_000 if i == 3 else "lorem dolor", "en", "ab"[i % 2], "", 0) for i in range(24)]
    assert sorted(map(tuple, source_divergence(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows, 10)


def test_merge_of_nodes_adds_leaves_and_counters():
    import numpy as np

    a = lambda *x: np.array(x, np.int64)
    x = Node([b"ab", b"b"], a(1, 2), ["s"], a(0, 1), a(0, 0), a(5, 6))
    y = Node([b"a", b"b"], a(3, 4), ["r", "s"], a(0, 1, 1), a(0, 0, 1), a(7, 8, 9))
    m = Node.merge([x, y])
    assert m.terms == [b"a", b"ab", b"b"] and m.df.tolist() == [3, 1, 6] and m.sources == ["r", "s"]
    assert list(zip(m.leaf.tolist(), m.source.tolist(), m.n.tolist(), strict=True)) == [(0, 0, 7), (1, 1, 5), (2, 0, 8), (2, 1, 15)]
    assert [(p, c.terms, c.n.tolist()) for p, c in m.children(1)] == [(b"a", [b"a", b"ab"], [7, 5]), (b"b", [b"b"], [8, 15])]


def test_arithmetic_is_exact():
    import numpy as np

    rng = random.Random(1)
    for _ in range(300):
        total = rng.randrange(5, 10 ** rng.randrange(1, 15) + 5)
        count = rng.randrange(0, total - 3)
        p = int(share(np.array([count], np.int64), total)[0])
        assert p == 1 + 10**9 * (count + 2) // total
        q = rng.randrange(1, 10**9)
        assert int(divergence(np.array([p]), np.array([q]))[0]) == (p - q) ** 2 // (p + q)


def test_query_has_sql():
    assert set(source_audit.SQL) == set(source_audit.QUERIES)


def test_counters_are_arrays_and_nodes_are_read_without_an_object_a_number(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    docs = [([rng.choice([b"a", b"b", b"ab", b"abc"]) for _ in range(rng.randrange(6))], rng.choice("xyz")) for _ in range(60)]
    made = source_audit.Counts()
    for at in range(0, 60, 7):
        part = docs[at : at + 7]
        made.add([made.numbers(w) for w, _ in part], [s for _, s in part])
        if at % 3 == 0:
            made.fold()
    rows = [r for r in made.trie("en") if r[2]]
    counts, df = Counter((w, s) for words, s in docs for w in words), Counter(w for words, _ in docs for w in set(words))
    seen = {(r[3][t], r[5][s]): n for r in rows for t, s, n in zip(r[6], r[7], r[8], strict=True)}
    assert seen == counts and {t: n for r in rows for t, n in zip(r[3], r[4], strict=True)} == df
    batch = source_audit._record(rows, source_audit._ARROW)
    monkeypatch.setattr(source_audit, "values", None)  # rows as Python objects took most of a merge's time
    merged = [r for b in source_audit.merge_nodes(1)(iter([batch])) for r in b.to_pylist()]
    assert {t: n for r in merged for t, n in zip(r["terms"], r["df"], strict=True)} == df
    assert sum(b.num_rows for b in source_audit.burst(3)(iter([batch]))) == 4
    node = next(source_audit._nodes(pa.record_batch(batch.columns, schema=batch.schema)))[1]
    assert all(x.dtype == np.int64 for x in (node.df, node.leaf, node.source, node.n))
