import random
import zlib

import zstandard as zstd
from pyspark.sql import functions as F

from varloom.llm import language_id
from varloom.llm.language_id import classify, encoders, identify, is_held_out, learn, normal, op6_language_id, stage

WORDS = {"en": "the and with that from have this was were house river stone".split(), "fr": "le la les des était avec pour dans maison rivière pierre".split()}


def make(n=120):
    rng = random.Random(0)
    return [(i, " ".join(rng.choices(WORDS[x], k=40)), x) for i in range(n) for x in [("en", "fr")[i % 2]]]


def test_normal():
    assert normal(" Été_1, 2 B!\n") == "été b"


def test_query_predicts_held_out_rows(spark, tmp_path):
    rows = [*make(), (900, None, "en"), (901, "12 !?", "fr"), (902, "", None), (None, "the house and the river with that stone", "en"), (903, "the and with that from have " * 20000, "fr"), (0, make()[0][1], "en")]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int").write.parquet(f"{tmp_path}/documents.parquet")
    got = op6_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, _, lang in make():
        assert by[i].lang_pred == lang and 0 <= by[i].score <= 1
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert by[900].lang_pred == by[901].lang_pred == by[902].lang_pred == "und" and by[900].rejected and by[901].score == 0
    assert by[None].lang_pred == "en" and by[None].held_out and by[903].lang_pred == "en"
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = stage(spark, docs, "")
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, *_ in make()} | {None, 903}


def test_ties_and_no_languages():
    by = encoders({"b": b"xyz xyz xyz xyz", "a": b"xyz xyz xyz xyz"})
    lang, score, margin = classify("xyz", by)
    assert (lang, score, margin) == ("a", 0.5, 0.0)
    assert classify("xyz", {}) == ("und", 0.0, 0.0)


def test_copies_teach_once(spark):
    df = spark.createDataFrame([(i, "le la les", "fr") for i in range(50)] + [(99, "the and", "en"), (98, None, "en"), (97, "x", None)], "doc_id long, text string, lang string")
    assert learn(df) == {"en": b"the and", "fr": b"le la les"}
    assert learn(df.limit(0)) == {} and identify(df.limit(0), {}, is_held_out()).count() == 0


def slow(rows, language=None):
    """Predictions by plain Python: dictionaries of the taught texts, one compressor for each window."""
    texts = {}
    for i, t, lang in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 3 != 1 and lang and lang != language and t and any(c.isalpha() for c in t):
            texts.setdefault(lang, set()).add(t)
    dicts = {}
    for lang, ts in texts.items():
        import xxhash

        order = sorted(ts, key=lambda t: (h := xxhash.xxh64_intdigest(t, 42)) - (h >> 63 << 64))
        dicts[lang] = " ".join(normal(t)[: language_id.SAMPLE_CHARS] for t in order[: language_id.SAMPLE_ROWS]).encode()
    out = []
    for _, t, _ in rows:
        raw, cost = normal(t or "").encode(), {}
        for lang, d in dicts.items():
            made = zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=language_id.LEVEL)
            cost[lang] = sum(len(zstd.ZstdCompressor(level=language_id.LEVEL, dict_data=made).compress(raw[i : i + 1024])) for i in range(0, len(raw), 1024))
        ranked = sorted(cost, key=lambda k: (cost[k], k))
        out.append(ranked[0] if raw and ranked else "und")
    return out


def test_query_against_brute_force(spark, tmp_path):
    rows = [*make(60), (900, None, "en"), (901, "!", "fr"), (902, "the river la maison", None), (903, "stone house " * 900 + "le la les", "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.lang_pred for r in op6_language_id(spark, str(tmp_path)).collect()}
    assert [got[r[0]] for r in rows] == slow(rows)


def test_unlearned_languages_are_rejected_at_any_length(spark):
    rng = random.Random(5)
    syllables = {x: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(40)] for x in ("a", "b", "c")}
    say = lambda x, n: " ".join("".join(rng.choices(syllables[x], k=3)) for _ in range(n))
    docs = spark.createDataFrame([(i, say("ab"[i % 2], 40), "ab"[i % 2]) for i in range(300)], "doc_id long, text string, lang string")
    dicts = learn(docs)
    asked = [(i, say("abc"[i % 3], n), "abc"[i % 3]) for i, n in enumerate([60, 60, 60, 3000, 3000, 3000, 30_000, 30_000, 30_000])]
    got = identify(spark.createDataFrame(asked, "doc_id long, text string, lang string"), dicts, F.lit(True)).collect()
    assert {(r.doc_id % 3 == 2, r.rejected) for r in got} == {(True, True), (False, False)}


def test_stage_judges_rows_not_ids(spark):
    rows = [*make(), (900, "the river and the house with that stone was from the house", "en"), (900, "12 !", "en"), (900, None, None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, held_out int, rejected int")
    left = stage(spark, docs, "")
    assert left.dtypes == docs.dtypes and left.count() == len(rows) - 2 and left.where("doc_id = 900").count() == 1
