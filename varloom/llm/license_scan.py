"""License scans by diagonal voting (operator 11).

Rolling hashes of all word 3-grams of all texts are joined with those of the templates; each meeting
votes for a diagonal, the text's place less the template's. Votes are added up by diagonal, diagonals
that lie close together are merged (words put in or left out shift the rest of a notice), and each
merged run is verified word by word on the text: phrases and short notices must stand there as they are,
longer notices need the votes that a place with a fifth of its words replaced keeps, and a longest common
subsequence of LIKE of their words or more.

The templates are a fixed table, so their side of the join is small whatever the input; a text goes
along only if its meetings reach the votes of some template, which loses no run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varloom.llm.common import cut, released, table, values

GRAM, BLOCK, WORDS = 3, 1 << 16, 1 << 18
#: Words by which neighbouring diagonals of a notice may lie apart, and the share of its words that must be found.
DRIFT, LIKE = 6, 0.8
#: Notices of fewer words must stand there as they are: a word more or less would be another license.
SHORT = 12
#: Rows of the templates' index beyond which it isn't broadcast.
BROADCAST = 100_000

# The phrases of the contract.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
# Public notices and the label of each.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "released under the MIT license"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2", "licensed under the Apache License, Version 2.0"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl-3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    ("lgpl-3", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("agpl-3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

#: Bytes to lower-cased word characters; what belongs to no word separates words.
WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORD).split()


class Template:
    """A phrase or notice: its label, words, and the meetings that a place of it needs at least."""

    def __init__(self, label: str, text: str, exact: bool):
        self.label, self.words, self.exact = label, words_of(text), exact
        n = len(self.words)
        if n < GRAM:
            raise ValueError(f"a template needs {GRAM} words: {text!r}")
        lost = 0 if exact or n < SHORT else n - int(np.ceil(LIKE * n))
        # a word that is replaced breaks GRAM grams at most
        self.votes = max(1, n - GRAM + 1 - GRAM * lost)


def templates(phrases=PHRASES, notices=NOTICES) -> list[Template]:  # noqa: ANN001
    return [Template(label, text, True) for label, text in phrases] + [Template(label, text, False) for label, text in notices]


class Hasher:
    """Rolling hashes of word grams; hashes of words are kept for WORDS words at a time."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def words(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > WORDS:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def grams(self, words: list[bytes], size: int = GRAM) -> np.ndarray:
        h = self.words(words)
        if len(h) < size:
            return np.empty(0, np.int64)
        out = np.zeros(len(h) - size + 1, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(size):
                out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)]
        return out.view(np.int64)


def _index(made: list[Template]) -> list[tuple[int, int, int]]:
    """(h, template, place) of all grams of the templates."""
    return [(int(h), t, i) for t, x in enumerate(made) for i, h in enumerate(Hasher().grams(x.words))]


def _rolling(made: list[Template]):  # noqa: ANN202
    """Rows (row, doc_id, text) to one with the number of words and, where it may be needed, the text,
    and one for each gram."""
    grams = sorted({h for h, _, _ in _index(made)})
    marks = np.array(grams, np.int64)
    own = {h: i for i, h in enumerate(grams)}
    holds = [np.array(sorted({own[h] for h, t, _ in _index(made) if t == k})) for k in range(len(made))]
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("text", pa.large_string()), ("at", pa.int64()), ("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, heads, at, rows, h, held = Hasher(), [], [], [], [], 0

        def out() -> pa.RecordBatch:
            head = pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*heads, strict=True) if heads else [()] * 6, schema, strict=True)], schema=schema)
            n = sum(map(len, at))
            null = lambda t: pa.nulls(n, t)
            cat = lambda x: np.concatenate([np.empty(0, np.int64), *x])
            body = pa.record_batch([pa.array(cat(rows)), null(pa.int64()), null(pa.int64()), null(pa.large_string()), pa.array(cat(at)), pa.array(cat(h))], schema=schema)
            return pa.Table.from_batches([head, body]).combine_chunks().to_batches()

        for b in batches:
            for row, doc, text in zip(values(b.column(0)), values(b.column(1)), values(b.column(2)), strict=True):
                words, met = words_of(text or ""), np.zeros(len(marks), np.int64)
                for lo in range(0, max(1, len(words) - GRAM + 1), BLOCK):
                    g = hasher.grams(words[lo : lo + BLOCK + GRAM - 1])
                    place = np.minimum(np.searchsorted(marks, g), len(marks) - 1)
                    met += np.bincount(place[marks[place] == g], minlength=len(marks)) if len(g) else 0
                    at.append(np.arange(lo, lo + len(g)))
                    rows.append(np.full(len(g), row, np.int64))
                    h.append(g)
                    held += len(g)
                reach = bool(met.any()) and any(met[k].sum() >= x.votes for k, x in zip(holds, made, strict=True))
                heads.append((row, doc, len(words), text if reach else None, -1, None))
                if held > BLOCK:
                    yield from out()
                    heads, at, rows, h, held = [], [], [], [], 0
        if heads:
            yield from out()

    return released(run)


def common_words(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, a bit a word of b."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(b):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    v = full
    for w in a:
        if m := where.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def _likeness(words: list[bytes], t: Template, run: dict) -> list[tuple[float, int, int]]:
    """(share of t's words, first word, end) of the windows of a run that are t's."""
    n = len(t.words)
    if len(t.words) < SHORT:
        return [(1.0, d, d + n) for d in run["diagonals"] if words[d : d + n] == t.words]
    if run["votes"] < t.votes:
        return []
    lo, hi = max(0, run["lo"] - run["first"] - DRIFT), min(len(words), run["hi"] + n - run["last"] + DRIFT)
    found = []
    for at in range(lo, hi, n // 2):  # a place with half as many words put in fits into one of the windows
        end = min(hi, at + 2 * n)
        if (like := common_words(words[at:end], t.words) / n) >= LIKE:
            found.append((like, at, end))
        if end == hi:
            break
    return found


def _verified(made: list[Template]):  # noqa: ANN202
    """Rows (doc_id, n_words, text, runs) to the result's columns."""

    def one(text: str | None, runs: list[dict] | None) -> tuple:
        words = words_of(text or "") if runs else []
        base, places, notices = set(), [], []
        for r in runs or ():
            t = made[r["template"]]
            if t.exact:
                found = [d for d in r["diagonals"] if words[d : d + len(t.words)] == t.words]
                places += found
                base |= {t.label} if found else set()
            else:
                notices += [(like, len(t.words), at, end, t.label) for like, at, end in _likeness(words, t, r)]
        # of notices that lie over each other the most alike, then the longest, gives the label
        taken: list[tuple] = []
        for x in sorted(notices, key=lambda x: (-x[0], -x[1], x[2:])):
            if not any(y[4] != x[4] and y[2] < x[3] and x[2] < y[3] for y in taken):
                taken.append(x)
        labels = base | {x[4] for x in taken}
        score = max([1.0 if places else 0.0, *(x[0] for x in taken)])
        join = lambda x: ",".join(sorted(x))
        return len(places), min(places, default=None), max(places, default=None), join(base), join(labels), score

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [one(text, runs) for text, runs in zip(values(b.column(2)), values(b.column(3)), strict=True)]
            made_of = list(zip(*found, strict=True)) if found else [()] * 6
            yield pa.record_batch([b.column(0), b.column(1), *[pa.array(list(c), f.type) for c, f in zip(made_of, list(schema)[2:], strict=True)]], schema=schema)

    return released(run)


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases=PHRASES, notices=NOTICES) -> DataFrame:  # noqa: ANN001
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    Base places are those where a phrase's words stand one after the other; all count, overlapping ones
    too. labels has the labels of notices as well, of overlapping ones that of the most alike; score is the
    highest share of a template's words found in order (1 for a phrase, 0 without any). Null and empty texts have no words. Repeated rows and rows
    with a null key stay rows of their own. Other columns are ignored. No rows: no rows.
    """
    made = templates(phrases, notices)
    spark = docs.sparkSession
    index = _index(made)
    grams = spark.createDataFrame(index, "h long, template int, place int")
    # rows of a file keep their order when a lost task runs again, so numbers are the same
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rolled = rows.mapInArrow(_rolling(made), "row long, doc_id long, n_words long, text string, at long, h long")
    met = rolled.join(F.broadcast(grams) if len(index) <= BROADCAST else grams, "h", "left").where("at < 0 or template is not null")
    met = cut(met.select("row", "doc_id", "n_words", "text", "at", "template", (F.col("at") - F.col("place")).alias("diagonal"), "place"))
    votes = met.where("at >= 0").groupBy("row", "template", "diagonal").agg(F.count(F.lit(1)).alias("votes"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.min("place").alias("first"), F.max("place").alias("last"))
    w = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(w) > DRIFT, F.lit(True)).cast("int")
    runs = votes.withColumn("new", apart).withColumn("run", F.sum("new").over(w)).groupBy("row", "template", "run")
    runs = runs.agg(F.sum("votes").alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min_by("first", "lo").alias("first"), F.max_by("last", "hi").alias("last"), F.sort_array(F.collect_list("diagonal")).alias("diagonals"))
    listed = runs.groupBy("row").agg(F.collect_list(F.struct("template", "votes", "lo", "hi", "first", "last", "diagonals")).alias("runs"))
    heads = met.where("at < 0").select("row", "doc_id", "n_words", "text").join(listed, "row", "left")
    out = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return heads.select("doc_id", "n_words", "text", "runs").mapInArrow(_verified(made), out)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_licenses() of all documents; nulls, ties and repeats as there."""
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Shares of common subsequences have no SQL form; tests hold the query's rows against brute force.
SQL: dict[str, str] = {}
QUERIES = {"op11_license_scan": op11_license_scan}
