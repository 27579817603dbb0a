import random

import pytest
import xxhash
from pyspark.sql import functions as F

from varloom.llm import line_dedup
from varloom.llm.line_dedup import EDITS, MIN_CHARS, banded_distance, drop_repeats, op1_line_dedup, signature, stage, with_keys


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
    return row[-1]


def mutate(rng, line, n):
    x = list(line)
    for _ in range(n):
        at = rng.randrange(len(x) + 1)
        rng.choice([lambda: x.insert(at, rng.choice("ab é🙂")), lambda: x.pop(min(at, len(x) - 1)), lambda: x.__setitem__(min(at, len(x) - 1), "z")])()  # noqa: B023
    return "".join(x)


def test_banded_distance_and_segments(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(400):
        a = "".join(rng.choices("abé🙂", k=rng.randrange(5, 30)))
        b = mutate(rng, a, rng.randrange(5))
        if abs(len(a) - len(b)) <= EDITS and len(b) >= 5:
            rows.append((a, b, distance(a, b)))
    df = spark.createDataFrame(rows, "a string, b string, d int")
    for r in df.select("d", banded_distance(F.col("a"), F.col("b")).alias("got")).collect():
        assert r.got == r.d if r.d <= EDITS else r.got > EDITS
    rows = []
    for i in range(500):
        a = "".join(rng.choices("abé🙂 e", k=rng.choice([12, 13, 15, 16, 30, 63, 64, 65, 66, 127, 128, 129, 130, 257])))
        b = mutate(rng, a, rng.randrange(EDITS + 1))
        rows.append((i, *sorted((a, b), key=len)))
    df = spark.createDataFrame(rows, "i int, a string, b string").where(F.length("a") >= line_dedup.SHORT)
    side = lambda c: with_keys(df.select("i", F.col(c).alias("line"), F.length(c).alias("n")))
    met = side("a").where("kept").join(side("b").drop("kept", "line", "n"), ["i", "key"]).select("i").distinct()
    assert met.count() == df.count() > 400
    assert df.where(F.bit_count(signature(F.col("a")).bitwiseXOR(signature(F.col("b")))) > 2 * EDITS).count() == 0


def test_hot_keys_change_nothing(spark, monkeypatch):
    """A group of lines that share most of their text: the same links with and without hot keys."""
    rng = random.Random(3)
    base = "a line of several words that many others share with it, up to one of them or two".split()
    lines = {" ".join(base[:i] + [rng.choice(["word", "other", "yet", "w"])] + base[i + 1 :]) for i in range(len(base)) for _ in range(6)}
    df = line_dedup.document_lines(spark.createDataFrame(list(enumerate(sorted(lines))), "doc_id long, text string"))
    got = []
    for sample, hot in ((1, 2), (16, 10**9)):
        monkeypatch.setattr(line_dedup, "SAMPLE", sample)
        monkeypatch.setattr(line_dedup, "HOT", hot)
        got.append(sorted(map(repr, line_dedup.edit_links(df).collect())))
    want = sum(distance(a, b) <= EDITS for a in lines for b in lines if a < b)
    assert got[0] == got[1] and len(got[0]) == want > 0


def slow(docs):
    """Classes, kept lines and links of distinct documents by comparing all pairs of lines."""
    cells = {}
    for d, text in docs:
        cells[d, text] = [(p, x.strip(" \t\r")) for p, x in enumerate((text or "").split("\n")) if x.strip(" \t\r")]
    lines = sorted({x for c in cells.values() for _, x in c})
    links, close, first = dict.fromkeys(lines, 0), {x: set() for x in lines}, {}
    for (d, _), c in cells.items():
        for p, x in c:
            at = (d is not None, d or 0, p)
            first[x] = min(at, first.get(x, at))
    for i, a in enumerate(lines):
        for b in lines[:i]:
            n = distance(a, b) if min(len(a), len(b)) >= MIN_CHARS and abs(len(a) - len(b)) <= EDITS else EDITS + 1
            if n <= EDITS:
                links[a] += 1
                links[b] += 1
                if 10 * n <= min(len(a), len(b)):
                    close[a].add(b)
                    close[b].add(a)

    def hashed(x):
        n = xxhash.xxh64_intdigest(x, seed=42)
        return n - (1 << 64) if n >> 63 else n

    stays = {x for x in lines if all(first[x] < first[y] for y in close[x])}
    for x in sorted(set(lines) - stays, key=hashed):
        if not close[x] & stays:
            stays.add(x)
    rule = {x: x if x in stays else min(close[x] & stays, key=first.get) for x in lines}
    return cells, rule.get, links


def make():
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base = [" ".join(word() for _ in range(rng.choice([5, 6, 20]))) for _ in range(14)]
    docs = []
    for i in range(30):
        ls = [mutate(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randrange(6))] + rng.choices(["Short.", "", "  ", "Es."], k=2)
        rng.shuffle(ls)
        docs.append((i, "\n".join(f"\t{x} " if rng.random() < 0.2 else x for x in ls)))
    return docs + [(100, None), (101, ""), (102, " \n\t\n"), (3, docs[3][1]), (None, docs[4][1]), (103, docs[5][1]), (104, "x" * 50_000 + "\n" + "x" * 50_001), (105, "\n".join(["The same line again and again"] * 50))]


def test_query_against_brute_force(spark, tmp_path):
    docs = make()
    spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, id int").write.parquet(f"{tmp_path}/documents.parquet")
    got = op1_line_dedup(spark, str(tmp_path)).collect()
    quick = [d for d in docs if d[0] != 104]
    cells, find, links = slow(quick)
    assert len(got) == len(set(docs))
    big = next(r for r in got if r.doc_id == 104)
    assert (big.n_lines, big.n_dropped, big.n_links) == (2, 1, 2) and len(set(big.class_ids)) == 1
    left = sorted((str(r.doc_id), r.n_lines, r.n_links) for r in got if r.doc_id != 104)
    assert left == sorted((str(d), len(c), sum(links[x] for _, x in c)) for (d, _), c in cells.items())
    by = {}
    for (d, t), c in cells.items():
        by.setdefault(d, []).append(c)
    classes = {}
    for r in got:
        if r.doc_id in by and len(by[r.doc_id]) == 1 and r.doc_id != 104:
            for k, (_, x) in zip(r.class_ids, by[r.doc_id][0], strict=True):
                assert classes.setdefault(find(x), k) == k
    assert len(set(classes.values())) == len(classes)
    total = len({find(x) for c in cells.values() for _, x in c})
    assert sum(r.n_lines - r.n_dropped for r in got if r.doc_id != 104) == total


def test_stage_keeps_first_lines_and_whole_repeats(spark):
    a, b, c = "The first line of all of them", "The second line of all of them", "A third one that differs a lot"
    docs = [(1, f"{a}\n{b}\n\n{a}", "x", 5), (2, f"{a}!\n{c}", "y", 6), (3, f"{a}\n{b}", "z", 7), (4, None, None, None), (None, "Es.\nEs.", "q", 3), (2, f"{a}!\n{c}", "y", 6)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, n_chars int")
    out = drop_repeats(df)
    assert out.columns == df.columns and out.schema["n_chars"].dataType == df.schema["n_chars"].dataType
    got = sorted(map(repr, map(tuple, out.collect())))
    want = [(1, f"{a}\n{b}\n", "x", len(f"{a}\n{b}\n")), (2, c, "y", len(c)), (3, f"{a}\n{b}", "z", 7), (4, None, None, None), (None, "Es.", "q", 3), (2, c, "y", len(c))]
    assert got == sorted(map(repr, want))
    assert drop_repeats(df.limit(0)).count() == 0


def test_stage_with_clashing_names_and_repeated_ids(spark):
    names = "doc_id text row at hash rid gone n parts left cells id _class _k key kept line pos".split()
    a, b = "The first line of all of them", "A third one that differs a lot"
    docs = [(1, a, *range(16)), (1, f"{b}\n{a}", *range(16, 32)), (1, a, *range(32, 48))]
    df = spark.createDataFrame(docs, ", ".join(f"`{c}` {'string' if c == 'text' else 'long'}" for c in names))
    got = sorted(map(tuple, stage(spark, df, "").collect()))
    first = min((1, t) for _, t, *_ in docs)
    assert df.columns == stage(spark, df, "").columns
    assert sorted(x[1:] for x in got) in (sorted([docs[0][1:], (b, *docs[1][2:]), docs[2][1:]]), sorted([docs[1][1:]])) and first


@pytest.mark.parametrize("text", ["Yes\nNo\n1\n12\n123\n{\n}", "On\nOff\n1984\n42\nend", "a\nabc\nabcde\nabcdefg\nabcdefghi"])
def test_unlike_short_lines_stay(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [r.text for r in stage(spark, df, "").collect()] == [text]


def test_chains_take_no_line_that_is_not_close_to_a_kept_one(spark):
    """A line that grows by two characters a step: each is close to the next one only."""
    lines = ["=" * 20 + "ab" * i for i in range(60)]
    random.Random(5).shuffle(lines)
    docs = [(i, x) for i, x in enumerate(lines)] + [(100, "\n".join(lines[:7])), (None, lines[3])]
    cells, rule, _ = slow(docs)
    kept = [r.text for r in stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()]
    assert sorted(kept) == sorted({rule(x) for x in lines}) and 20 <= len(kept) <= 30
