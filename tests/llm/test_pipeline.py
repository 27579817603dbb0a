import random

import xxhash

import corpus_pipeline
from tests.llm.test_decontaminate import slow as slow_leaks
from tests.llm.test_language_id import WORDS
from tests.llm.test_line_dedup import slow as slow_lines
from tests.llm.test_near_dedup import slow as slow_groups
from varloom.llm.language_id import classify, encoders, is_held_out, learn, rejected
from varloom.llm.sentencepiece_sampling import Pieces


def make():
    rng = random.Random(11)
    say = lambda lang, k: " ".join(rng.choices(WORDS[lang], k=k))
    items = [(i, say("en", 20)) for i in range(4)]
    docs = []
    for i in range(24):
        lang = ("en", "fr")[i % 2]
        docs.append((i, "\n".join(say(lang, rng.randrange(12, 30)) for _ in range(rng.randrange(1, 5))), lang, "s", 1))
    docs.append((50, docs[2][1], "en", "s", 1))
    docs.append((51, docs[4][1] + " the", "en", "s", 1))
    docs.append((52, docs[5][1].split("\n")[0] + "\n" + say("fr", 15), "fr", "s", 1))
    docs += [(53 + i, say("en", 10) + " " + t + " " + say("en", 9), "en", "s", 1) for i, t in items]
    docs += [(60, None, None, None, None), (61, "12 !", "en", "s", 4), (62, "", "fr", "s", 0)]
    return docs, items


def test_stages_against_brute_force(spark, tmp_path):
    docs, items = make()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    by = encoders(learn(table.where(~is_held_out())))
    rows = [(d, t) for d, t, *_ in docs]
    rows = [(d, t) for d, t in rows if not rejected(*classify(t, by))]
    cells, find, _ = slow_lines(rows)
    first, out = {}, []
    for d, t in sorted(rows):
        for p, x in cells[d, t]:
            first.setdefault(find(x), (d, p))
    for d, t in rows:
        gone = {p for p, x in cells[d, t] if first[find(x)] != (d, p)}
        if not cells[d, t] or len(gone) < len(cells[d, t]):
            out.append((d, "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone) if gone else t))
    groups = slow_groups([t for _, t in out])
    low = {}
    for (d, _), g in zip(out, groups, strict=True):
        low[g] = min(d, low.get(g, d))
    out = [r for r, g in zip(out, groups, strict=True) if r[0] == low[g]]
    leaked = {x[0] for x in slow_leaks(out, items)}
    out = {d: t for d, t in out if str(d) not in leaked}
    got = {r.doc_id: r.samples for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(out) and 15 < len(got) < len(docs) - 6
    pieces = Pieces()
    for d, t in out.items():
        want = pieces.sample(t, xxhash.xxh64_intdigest(str(d)))
        assert [list(s.ids) for s in got[d]] == [w[0].tolist() for w in want] and pieces.decode(list(got[d][0].ids)) == t


def test_stages_judge_rows_not_ids_and_keep_clashing_columns(spark, tmp_path):
    """Two rows of one id: where one goes, the other stays; columns named as helpers are untouched."""
    rng = random.Random(2)
    say = lambda k: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(k))
    item, one, other = say(20), say(60), say(60)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = "rid gone tid group sid fp keys n key of c a b x y line id at hash row parts left lang held_out rejected similarity item_id w k".split()
    schema = f"doc_id long, text string, {', '.join(f'`{c}` string' for c in names)}"
    extra = [f"v{i}" for i in range(len(names))]
    rows = [(1, one), (5, one), (5, other), (7, item), (7, say(50)), (9, None), (9, ""), (None, say(30))]
    table = spark.createDataFrame([(*r, *extra) for r in rows], schema)
    stages = dict(corpus_pipeline.STAGES)
    for name, gone in (("simhash_dedup", {(5, one), (9, "")}), ("decontaminate", {(7, item)}), ("line_dedup", {(5, one)})):
        out = stages[name](spark, table, str(tmp_path))
        got = [tuple(r) for r in out.collect()]
        assert out.dtypes == table.dtypes and all(list(r[2:]) == extra for r in got)
        if name == "simhash_dedup":  # the texts without words are one group: either stays
            got = [r for r in got if r[0] != 9]
        assert sorted(map(repr, (r[:2] for r in got))) == sorted(map(repr, (r for r in rows if r not in gone and (name != "simhash_dedup" or r[0] != 9)))), name


def test_empty_tables_and_an_empty_benchmark(spark, tmp_path):
    docs, _ = make()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("some", docs), ("none", [])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        n = corpus_pipeline.run(spark, f"{tmp_path}/{name}").count()
        assert n > 15 if rows else n == 0


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs, items = make()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, str(tmp_path))
        assert out.columns == table.columns and out.dtypes == table.dtypes
        assert stage(spark, table.limit(0), str(tmp_path)).count() == 0
