"""Language identification by compression (operator 6).

Each language has a raw-content zstandard dictionary, taken from a bounded sample of labelled
rows. A text, lower-cased and cut to letters and single spaces, is encoded in windows with every
dictionary; the language with the fewest bytes wins. Its margin is what the next language needs
more, as a share of its own bytes, so that it means the same for texts of any length; a row whose
margin is under MIN_MARGIN is rejected.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varloom.llm.common import released, table, values

#: The bounded sample that a dictionary is fitted on: distinct texts of a language, the first characters of
#: each, and languages (those with the most distinct texts, if there are more).
SAMPLE_ROWS, SAMPLE_CHARS, MAX_LANGS = 200, 160, 200
WINDOW, LEVEL = 1024, 7
#: Set on labelled rows with a language held out: see README.
MIN_MARGIN = 0.02
#: Bits of code length count this much each in the score.
TEMPER = 0.25

_GAPS = re.compile(r"[\W\d_]+")


def normal(text: str) -> str:
    """Lower case, letters alone, one space between words."""
    return _GAPS.sub(" ", text.lower()).strip()


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """A dictionary for each language, of SAMPLE_ROWS distinct texts with the smallest hashes.

    Rows with a null text or language, or without a letter, teach nothing. The hash is of the
    text, so copies count once however many they are, and no identifier matters.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where(r"lang is not null and text rlike '\\p{L}'").withColumn("h", F.xxhash64("text"))
    distinct = rows.groupBy("lang", "h").agg(F.lit(1).alias("one"))
    known = [r.lang for r in distinct.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()]
    if not known:
        return {}
    # The smallest of each bucket first, so that a common language isn't ranked in one task.
    parts = distinct.where(F.col("lang").isin(known)).withColumn("bucket", F.pmod("h", F.lit(64)))
    for over in (("lang", "bucket"), ("lang",)):
        parts = parts.withColumn("n", F.row_number().over(Window.partitionBy(*over).orderBy("h"))).where(F.col("n") <= SAMPLE_ROWS)
    few = parts.select("lang", "h").collect()  # SAMPLE_ROWS * MAX_LANGS rows at most
    chosen = F.broadcast(labelled.sparkSession.createDataFrame(few, "lang string, h long"))
    texts = rows.join(chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.min(F.substring("text", 1, 4 * SAMPLE_CHARS)).alias("part"))
    taken: dict[str, list[str]] = defaultdict(list)
    for r in sorted(texts.collect(), key=lambda r: (r.lang, r.h)):
        taken[r.lang].append(normal(r.part)[:SAMPLE_CHARS])
    return {k: " ".join(v).encode() for k, v in sorted(taken.items())}


def encoders(dicts: dict[str, bytes]) -> dict[str, Callable[[bytes], bytes]]:
    out = {}
    for k, v in dicts.items():
        d = zstd.ZstdCompressionDict(v, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        p = zstd.ZstdCompressionParameters.from_level(LEVEL)
        d.precompute_compress(compression_params=p)
        out[k] = zstd.ZstdCompressor(dict_data=d, compression_params=p).compress
    return out


def classify(text: str | None, by: dict[str, Callable[[bytes], bytes]]) -> tuple[str, float, float]:
    """Language, score and margin over the whole text; ``und``, 0 and 0 without a letter. Ties go to the smaller name."""
    flat = normal(text or "")
    if not flat or not by:
        return "und", 0.0, 0.0
    raw = flat.encode()
    cost = {k: sum(len(code(raw[i : i + WINDOW])) for i in range(0, len(raw), WINDOW)) for k, code in by.items()}
    best = min(cost, key=lambda k: (cost[k], k))
    margin = min(((v - cost[best]) / cost[best] for k, v in cost.items() if k != best), default=1.0)
    return best, 1.0 / sum(2.0 ** (-8 * TEMPER * min(v - cost[best], 400)) for v in cost.values()), margin


def rejected(lang: str, score: float, margin: float) -> bool:
    return lang == "und" or margin < MIN_MARGIN


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, margin double, rejected boolean"


def identify(docs: DataFrame, dicts: dict[str, bytes], held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for every row. Null and letterless texts are ``und`` and rejected; so is a text whose
    margin is narrow, with its best language kept in lang_pred. Very long texts are read in
    windows; other columns are ignored; no labelled rows make all ``und``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = encoders(dicts)
        for b in batches:
            got = [classify(t, by) for t in values(b.column(2))]
            lang, score, margin = zip(*got, strict=True) if got else ((), (), ())
            cols = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array([rejected(*x) for x in got], pa.bool_())]
            yield pa.record_batch([b.column(0), b.column(1), *cols], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(key).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text")).mapInArrow(released(run), SCHEMA)


def is_held_out(key: str = "doc_id") -> Column:
    """The fold that teaches nothing; a null id teaches nothing either."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(True))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identify() on all documents, with dictionaries learned from the folds that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, learn(docs.where(~is_held_out())), is_held_out())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected rows go, each judged by its own text alone: rows that share an id or repeat one another
    are judged one by one. Null, empty and letterless texts go; an empty table stays empty."""
    dicts, at = learn(docs.where(~is_held_out())), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = encoders(dicts)
        for b in batches:
            yield b.filter(pa.array([not rejected(*classify(t, by)) for t in values(b.column(at))], pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)


SQL: dict[str, str] = {}
QUERIES = {"op6_language_id": op6_language_id}
