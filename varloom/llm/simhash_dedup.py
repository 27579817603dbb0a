"""SimHash near-duplicates by a Gray-order hierarchical index (operator 10).

Fingerprints of all rows are reduced to distinct ones first, so a group of copies is one entry.
Two fingerprints at RADIUS or fewer differing bits agree on two of the four 16-bit blocks at
least: those 32 shared masked bits are the upper nodes of the index and deal it out over the
cluster. Below such a node the fingerprints are sorted by Gray rank; every node holds the bits
that its whole run shares and that no node above has, and a query drops the run as soon as the
differences added up on the way down exceed the radius. Each node gives a spanning forest of its
links, not all pairs; the components are found by distributed label propagation.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.common import connected_components, cut, released, table, values

SHINGLE, SEED, RADIUS, FAN, LEAF = 3, 42, 2, 8, 24
#: An upper node with more distinct fingerprints is split by 8-bit blocks of its other 32 bits, to 2**16 at most.
SPLIT = 50_000
PAIRS = list(combinations(range(4), 2))
BLOCK = 1 << 16  # shingles a vector step


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64 bits; bit i is 1 where over half of the shingles' hashes have it. No words: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    grams = zip(*(words[i:] for i in range(size)), strict=False) if len(words) >= size else iter([tuple(words)])
    ones, n = np.zeros(64, np.int64), 0
    while part := [digest(join(g), SEED) for g in islice(grams, BLOCK)]:
        ones += np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
        if len(part) < BLOCK:
            break
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.fromiter(map(fingerprint, values(b.column(1))), np.uint64, b.num_rows)
        yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each word in the reflected Gray order."""
    x = x.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayIndex:
    """Levels of runs over distinct fingerprints in Gray order. A node has the mask of the bits that
    its run shares and its parent's doesn't, and the pattern of those bits."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps[np.argsort(gray_rank(fps), kind="stable")]
        runs, self.levels = np.arange(0, len(fps), LEAF), []
        spans = [(runs, np.append(runs[1:], len(fps)))]
        while len(spans[0][0]) > FAN:
            lo = spans[0][0][::FAN]
            spans.insert(0, (lo, np.append(lo[1:], len(fps))))
        above = None
        for lo, hi in spans:
            same = ~(np.bitwise_or.reduceat(self.fps, lo) & ~np.bitwise_and.reduceat(self.fps, lo))
            mask = same if above is None else same & ~np.repeat(above, FAN)[: len(lo)]
            self.levels.append((lo, hi, mask, self.fps[lo] & mask))
            above = same

    def within(self, queries: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query numbers, positions in self.fps) of all fingerprints within the radius, in blocks."""
        for at in range(0, len(queries), 512):
            q = queries[at : at + 512]
            who, node = np.divmod(np.arange(len(q) * len(self.levels[0][0])), len(self.levels[0][0]))
            spent = np.zeros(len(who), np.int64)
            for depth, (_, _, mask, pattern) in enumerate(self.levels):
                if depth:
                    n = len(mask)
                    who, spent = np.repeat(who, FAN), np.repeat(spent, FAN)
                    node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    real = node < n
                    who, spent, node = who[real], spent[real], node[real]
                spent = spent + np.bitwise_count((q[who] & mask[node]) ^ pattern[node])
                near = spent <= radius
                who, spent, node = who[near], spent[near], node[near]
            lo, hi = self.levels[-1][0][node], self.levels[-1][1][node]
            pos = (lo[:, None] + np.arange(LEAF)).ravel()
            who, real = np.repeat(who, LEAF), pos < np.repeat(hi, LEAF)
            who, pos = who[real], pos[real]
            near = np.bitwise_count(q[who] ^ self.fps[pos]) <= radius
            yield who[near] + at, pos[near]


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect all of fps that near pairs connect, one for each fingerprint but the roots."""
    if len(fps) <= 2 * LEAF:
        a, b = np.triu_indices(len(fps), 1)
        near = np.bitwise_count(fps[a] ^ fps[b]) <= RADIUS
        found, fps = [(a[near], b[near])], fps
    else:
        index = GrayIndex(fps)
        fps, found = index.fps, index.within(index.fps)
    root = list(range(len(fps)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    links = []
    for who, pos in found:
        for x, y in zip(who.tolist(), pos.tolist(), strict=True):
            if x < y and (p := top(x)) != (q := top(y)):
                root[q] = p
                links.append((x, y))
    signed = fps.view(np.int64).tolist()
    return [(signed[x], signed[y]) for x, y in links]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, fp) sorted by k; a node's run may go over from batch to batch."""

    def out(links: list) -> pa.RecordBatch:
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
    for b in (*batches, None) if isinstance(batches, list) else _then_none(batches):
        last = b is None
        if not last:
            keys = np.concatenate([keys, b.column(0).to_numpy()])
            fps = np.concatenate([fps, b.column(1).to_numpy().view(np.uint64)])
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        ends = np.append(starts[1:], len(keys))
        if not last and len(starts):
            starts, ends, rest = starts[:-1], ends[:-1], starts[-1]
        else:
            rest = len(keys)
        links = []
        for i in np.flatnonzero(ends - starts > 1):
            links += _forest(fps[starts[i] : ends[i]])
        yield out(links)
        keys, fps = keys[rest:], fps[rest:]


def _then_none(it: Iterator) -> Iterator:
    yield from it
    yield None


def _bits(x, blocks: tuple[int, ...], width: int):  # noqa: ANN001
    out = F.lit(0).cast("long")
    for b in blocks:
        out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned(x, b * width).bitwiseAND(F.lit((1 << width) - 1)))
    return out


def near_links(fps: DataFrame, split: int = SPLIT) -> DataFrame:
    """(a, b) over distinct fingerprints fp: a spanning set of the links at RADIUS or fewer bits."""
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("m"), _bits(F.col("fp"), p, 16).alias("bits")) for i, p in enumerate(PAIRS)])).alias("x")).select("fp", "x.m", "x.bits")
    crowded = cut(keyed.groupBy("m", "bits").count().where(F.col("count") > split).select("m", "bits"))
    if crowded.isEmpty():
        parts = keyed.select(F.xxhash64("m", "bits").alias("k"), "fp")
    else:
        rest = F.coalesce(*[F.when(F.col("m") == i, _bits(F.col("fp"), tuple(b for b in range(4) if b not in p), 16)) for i, p in enumerate(PAIRS)])
        finer = F.explode(F.array(*[F.struct(F.lit(i).alias("m2"), _bits(F.col("rest"), p, 8).alias("bits2")) for i, p in enumerate(PAIRS)])).alias("y")
        dense = keyed.join(crowded, ["m", "bits"], "left_semi").withColumn("rest", rest).select("fp", "m", "bits", finer).select(F.xxhash64("m", "bits", "y.m2", "y.bits2").alias("k"), "fp")
        parts = keyed.join(crowded, ["m", "bits"], "left_anti").select(F.xxhash64("m", "bits").alias("k"), "fp").union(dense)
    return parts.repartition("k").sortWithinPartitions("k").mapInArrow(_linked, "a long, b long")


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row.

    Null and empty texts, and texts of white space, have fingerprint zero and link like any other.
    component_id is the smallest doc_id that links lead to; rows with a null doc_id link too, but
    give no id (null where a component has no other). Repeated rows stay. Other columns are
    ignored. No rows: no rows.
    """
    rows = cut(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(released(_fingerprints), "doc_id long, fp long"))
    first = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("own")))
    labels = connected_components(near_links(first.select("fp")))
    named = first.join(labels.withColumnRenamed("node", "fp"), "fp")
    low = named.groupBy("component").agg(F.min("own").alias("low"))
    linked = named.join(low, "component").select("fp", "low")
    final = first.join(linked, "fp", "left").select("fp", F.coalesce("low", "own").alias("component_id"))
    return rows.join(final, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """simhash_groups() of all documents: a row for every row; nulls, ties and repeats as there."""
    return simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL: dict[str, str] = {}
QUERIES = {"op10_simhash_dedup": op10_simhash_dedup}
