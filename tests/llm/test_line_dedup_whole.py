import random

from tests.llm.test_line_dedup import distance, mutate
from varloom.llm.line_dedup import EDITS, document_lines, edit_links, stage


def test_short_lines_are_joined_by_edits(spark):
    rng = random.Random(8)
    lines = {"a", "b", "xyz", "Yes.", "é🙂"}
    for n in range(1, 30):
        for _ in range(4):
            x = "".join(rng.choices("abcé🙂 ", k=n)).strip() or "q"
            lines |= {x, *((mutate(rng, x, min(k, len(x))).strip() or "r") for k in (1, 2, 3))}
    lines = sorted(lines)
    df = document_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    ids = {r.id: r.line for r in df.collect()}
    got = sorted(tuple(sorted((ids[r.a], ids[r.b]))) for r in edit_links(df).collect())
    want = sorted((a, b) for i, b in enumerate(lines) for a in lines[:i] if abs(len(a) - len(b)) <= EDITS and distance(a, b) <= EDITS)
    assert got == want and any(len(a) < 5 for a, _ in want) and any(12 > len(a) > 8 for a, _ in want)


def test_stage_takes_repeats_out_of_every_document(spark):
    a, b, c, d = (f"{x} line that is like no other here, {x}" for x in ("first", "second", "third", "a wholly different"))
    docs = [(1, f"{a}\n{b}"), (2, f"{c}\n{d}"), (3, f"{b}\n{c}"), (4, d), (5, f"{a}\nA new line of its own that stays"), (6, None), (7, "")]
    out = stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").orderBy("doc_id").collect()
    assert [tuple(r) for r in out] == [docs[0], docs[1], (5, "A new line of its own that stays"), docs[5], docs[6]]
