from __future__ import annotations

import random
import re

import pytest

from varloom.llm.license_scan import NOTICES, PHRASES, SHORT, common_words, scan_licenses, words_of

SCHEMA = "doc_id long, text string, template int, at int, h string"
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
FILL = "the license of this mit under version cc by nc 2 apache grüße text is free software and".split()


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    found = [(i, label) for label, p in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def scanned(spark, texts, **more):
    df = spark.createDataFrame([(i, t, 1, 2, "h") for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: r for r in scan_licenses(df.repartition(3), **more).collect()}


def test_base_places_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [rng.choice([" ", "-", "\n", ", "]).join(rng.choice(FILL) for _ in range(rng.randrange(120))) for _ in range(300)]
    for i in range(0, 300, 4):
        texts[i] += " Under the MIT\tLicense. CC-BY-NC cc by nc" if i % 8 else " Apache License, Version 2.0 apache_license/version~2"
    texts += [None, "", " ", "...", "cc by", "cc by nc", "É CC BY NC", "CC BY NCÉ", "under the mit licenseunder the mit license"]
    got = scanned(spark, texts)
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:6] == brute(t), t
        assert not got[i].n_base or got[i].score == 1
        assert set(got[i].base_labels.split(",")) <= set(got[i].labels.split(",")) or not got[i].base_labels


def test_every_notice_is_found_whole_and_alone_and_changed(spark):
    rng = random.Random(8)
    plain = ["wort%d" % i for i in range(40)]
    texts, want = [], []
    for label, notice in NOTICES:
        words = notice.split()
        texts.append(" ".join([*rng.sample(plain, 20), *words, *rng.sample(plain, 20)]))
        want.append((label, 1.0))
        if len(words_of(notice)) >= SHORT + 4:
            words[len(words) // 2] = "ersetzt"
            words.insert(3, "dazu")
            texts.append(" ".join([*rng.sample(plain, 20), *words, *rng.sample(plain, 20)]))
            want.append((label, 0.8))
    got = scanned(spark, texts)
    for i, (label, least) in enumerate(want):
        assert got[i].labels.split(",") == [label], texts[i]
        assert got[i].score >= least
    assert all(r.score < 1 for i, r in got.items() if want[i][1] < 1 and "gpl" not in want[i][0])


def test_clean_texts_have_no_labels(spark):
    texts = ["Permission is hereby granted, free of charge, to enter the park.", "licensed under CC BY", "the terms of the general public", "This program is free of charge and of the software", "You may obtain a copy of the book"]
    assert {(r.labels, r.score, r.n_base) for r in scanned(spark, texts).values()} == {("", 0.0, 0)}


def test_nulls_repeats_and_long_text(spark):
    long = "wort " * 70_000 + "released under the mit license " + "wort " * 70_000 + NOTICES[0][1]
    rows = [(None, "cc by nc", 1, 2, "h")] * 2 + [(7, "cc by nc", 1, 2, "h")] * 3 + [(8, long, 1, 2, "h"), (9, None, 1, 2, "h")]
    got = sorted(map(tuple, scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert len(got) == 7
    assert [r for r in got if r[0] is None] == [(None, 3, 1, 0, 0, "cc-by-nc", "cc-by-nc", 1.0)] * 2
    assert [r for r in got if r[0] == 8] == [(8, 140_005 + len(words_of(NOTICES[0][1])), 1, 70_001, 70_001, "mit", "mit", 1.0)]
    assert [r for r in got if r[0] == 9] == [(9, 0, 0, None, None, "", "", 0.0)]


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).collect() == []


def test_unbroadcast_index_gives_the_same(spark, monkeypatch):
    texts = ["cc by nc " * 3, NOTICES[0][1], "nothing"]
    first = scanned(spark, texts)
    monkeypatch.setattr("varloom.llm.license_scan.BROADCAST", 0)
    assert scanned(spark, texts) == first


def test_phrase_too_short(spark):
    with pytest.raises(ValueError, match="3 words"):
        scan_licenses(spark.createDataFrame([], SCHEMA), phrases=(("x", "two words"),))


def test_common_words():
    assert common_words([b"a", b"b", b"c", b"d"], [b"a", b"c", b"x", b"d"]) == 3
    assert common_words([], [b"a"]) == 0
