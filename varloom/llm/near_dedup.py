"""Near-duplicate documents at a similarity of word shingles: the pipeline's SimHash stage (operator 10).

Texts at THRESHOLD or more in the Jaccard similarity of their shingles of WORDS words are linked and
components become groups; no such pair is missed, and every link is verified exactly.

Fingerprints of those shingles meet first, in operator 10's Gray-order index. Pairs at the threshold
differ in up to 21 of 64 bits, far beyond what any index of fingerprints prunes, so the other pairs
come from a prefix join: under one order of all shingles, two texts of that similarity share a shingle
among the first n - ceil(THRESHOLD * n) + 1 of each (the prefix). Texts that share such a key are first
compared with the smallest of them, then with those that all this left in other components, so a large
group of near copies does not give all its pairs. Of two texts that share c keys no more than the
longer rest behind the prefixes can be common besides; pairs that cannot reach the threshold with that
are not verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.common import connected_components, cut, drop_cut, released, values
from varloom.llm.simhash_dedup import near_links

WORDS, THRESHOLD, SEED = 5, 0.8, 42
#: Shingles that COMMON documents of a sample hold come last in the order, the most frequent at the end. The order decides the cost alone.
SAMPLE, COMMON, MOST_COMMON = 0.02, 4, 100_000


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Distinct hashes of the shingles in order; a text of fewer words is one shingle, none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.int64)
    w = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in words), np.uint64, len(words))
    k = min(size, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : j + len(h)]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique((h ^ (h >> np.uint64(31))).view(np.int64))


def majority(hashes: np.ndarray) -> int:
    """The SimHash of distinct shingles, as a signed number."""
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


def prefix(g: np.ndarray, threshold: float, common: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The first n - ceil(threshold * n) + 1 of a text's n sorted shingles: those that are not common, then the common
    ones by place, so that the most frequent come last. common is sorted, and is searched, not gone through."""
    at = np.searchsorted(common, g)
    at[at == len(common)] = 0
    late = common[at] == g if len(common) else np.zeros(len(g), bool)
    few = g[late][np.argsort(place[at[late]])]
    return np.concatenate([g[~late], few])[: len(g) - int(np.ceil(threshold * len(g) - 1e-9)) + 1]


def _prefixes(size: int, threshold: float, common: np.ndarray, place: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ns, keys, fps = [], [], [], []
            for text in values(b.column(2)):
                g = shingles(text, size)
                ids.append(xxhash.xxh3_128_digest(g.tobytes()))
                fps.append(majority(g))
                ns.append(len(g))
                keys.append(prefix(g, threshold, common, place))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(ids, pa.binary()), pa.array(ns, pa.int32()), pa.array(fps, pa.int64()), _lists(keys)], names=["doc_id", "tid", "sid", "n", "fp", "keys"])

    return run


def _sets(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), _lists([shingles(t, size) for t in values(b.column(1))])], names=["sid", "g"])

    return run


def _common(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The common shingles in order, and the place of each from the least to the most frequent."""
    sample = texts.sample(SAMPLE, SEED).select(F.lit(b"").alias("sid"), "text")
    counts = sample.mapInArrow(released(_sets(size)), "sid binary, g array<long>").select(F.explode("g").alias("h")).groupBy("h").count()
    top = counts.where(F.col("count") >= COMMON).orderBy(F.desc("count"), "h").limit(MOST_COMMON).collect()
    h = np.array([r.h for r in top], np.int64)
    order = np.argsort(h)
    return h[order], len(h) - order  # top begins with the most frequent


def _grouped(docs: DataFrame, key: str, text: str, size: int, threshold: float) -> DataFrame:
    """doc_id, tid (of the text), group (the first (doc_id, tid) of the component) of every row."""
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("tid"), F.col(text).alias("text"))
    rows = cut(texts.mapInArrow(released(_prefixes(size, threshold, *_common(texts, size))), "doc_id long, tid long, sid binary, n int, fp long, keys array<long>"))
    fits = lambda a, b: F.least(a, b) >= F.lit(threshold) * F.greatest(a, b) - 1e-9
    held = rows.select(F.explode("keys").alias("key"), "sid", "n").groupBy("key").agg(F.collect_set(F.struct("sid", "n")).alias("of"))
    buckets = cut(held.where(F.size("of") > 1).withColumn("of", F.array_sort("of")))
    row = F.struct("doc_id", "tid")  # rows with an id go before those without
    first = rows.groupBy("sid").agg(F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), row)), F.min(row)).alias("own"), F.min("tid").alias("tid"))

    def shared(met: DataFrame) -> DataFrame:
        """Pairs of (a, b, an, bn) rows, one for each key that both share, that can reach the threshold."""
        rest = F.ceil(F.lit(threshold) * F.greatest("an", "bn") - 1e-9) - 1
        enough = F.col("c") + rest >= F.lit(threshold / (1 + threshold)) * (F.col("an") + F.col("bn")) - 1e-9
        return met.groupBy("a", "b", "an", "bn").agg(F.count(F.lit(1)).alias("c")).where(enough).select("a", "b")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs.distinct())
        asked = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(first.select("sid", "tid"), "sid")
        held = texts.select("tid", "text").join(asked, "tid").dropDuplicates(["sid"]).select("sid", "text")
        sets = cut(held.mapInArrow(released(_sets(size)), "sid binary, g array<long>"))
        side = lambda c: sets.select(F.col("sid").alias(c), F.col("g").alias(f"{c}_g"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("both", F.size(F.array_intersect("a_g", "b_g")))
        out = cut(both.where(F.col("both") >= (F.size("a_g") + F.size("b_g") - F.col("both")) * F.lit(threshold) - 1e-9).select("a", "b"))
        for done in (pairs, sets):
            drop_cut(done)
        return out

    heads = cut(rows.groupBy("fp").agg(F.min("sid").alias("head")))
    same = rows.select("fp", "sid").distinct().join(heads, "fp").where(F.col("sid") != F.col("head")).select(F.col("head").alias("a"), F.col("sid").alias("b"))
    bits = near_links(heads.select("fp"))
    head = lambda c: heads.select(F.col("fp").alias(f"{c}_fp"), F.col("head").alias(c))
    bits = bits.withColumnsRenamed({"a": "a_fp", "b": "b_fp"}).join(head("a"), "a_fp").join(head("b"), "b_fp").select("a", "b")
    low = F.get("of", F.lit(0))
    stars = buckets.select(low.alias("x"), F.explode(F.slice("of", 2, F.size("of"))).alias("y"))
    stars = stars.where(fits(F.col("x.n"), F.col("y.n"))).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"), F.col("x.n").alias("an"), F.col("y.n").alias("bn"))
    links = verified(shared(stars).union(same).union(bits))
    near = connected_components(links).withColumnsRenamed({"node": "sid", "component": "c"})
    told = buckets.select("key", F.explode("of").alias("x")).select("key", "x.sid", "x.n").join(near, "sid", "left").withColumn("c", F.coalesce("c", "sid"))
    mixed = told.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
    left = cut(told.join(mixed, "key"))
    a, b = left.withColumnsRenamed({"sid": "a", "n": "an", "c": "ac"}), left.withColumnsRenamed({"sid": "b", "n": "bn", "c": "bc"})
    rest = a.join(b, "key").where((F.col("ac") < F.col("bc")) & fits(F.col("an"), F.col("bn"))).select("a", "b", "an", "bn")
    labels = connected_components(links.union(verified(shared(rest))))
    for done in (buckets, heads, left):
        drop_cut(done)
    named = first.join(labels.withColumnRenamed("node", "sid"), "sid")
    lows = named.groupBy("component").agg(F.min("own").alias("low"), F.min(F.when(F.col("own.doc_id").isNotNull(), F.col("own"))).alias("known"))
    final = first.join(named.join(lows, "component").select("sid", "low", "known"), "sid", "left")
    known = F.when(F.col("own.doc_id").isNotNull(), F.col("own"))
    return rows.join(final.select("sid", F.coalesce("known", known, "low", "own").alias("group")), "sid").select("doc_id", "tid", "group")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, component_id of every row.

    Texts without words are copies of each other. component_id is the smallest doc_id that links lead
    to; rows with a null doc_id link too, but give no id (null where a component has no other).
    Repeated rows stay. Other columns are ignored. No rows: no rows.
    """
    return _grouped(docs, key, text, size, threshold).select("doc_id", F.col("group.doc_id").alias("component_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group one document stays: that of the smallest doc_id, and of its texts in the group the
    one with the smallest hash. Rows of one id and text are one document; rows without a doc_id stay."""
    group = _grouped(docs, "doc_id", "text", WORDS, THRESHOLD)
    gone = cut(group.where(F.col("doc_id").isNotNull() & (F.struct("doc_id", "tid") != F.col("group"))).select("doc_id", "tid").distinct())
    here = (docs["doc_id"].cast("long") == gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["tid"])
    return docs.join(gone, here, "left_anti")


QUERIES: dict = {}
SQL: dict[str, str] = {}
