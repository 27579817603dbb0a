"""Benchmark decontamination by SimHash of item-sized windows (operator 8), with DataFrame functions alone.

Texts become lower-case words (letters and digits) and hashed shingles of SHINGLE words. A window
has as many words as a benchmark item. Windows that hold too few shingles of items of their size to
reach THRESHOLD cannot be similar and are not fingerprinted; this bound is exact. The fingerprints
of the others meet those of the items in a multi-index: RADIUS + 1 blocks of bits, of which two
fingerprints within the radius share one at least. Pairs within the radius are verified by the
exact similarity of the shingles weighted by their multiplicity (sum of minima over sum of maxima).
A text of fewer words than an item is one window, the whole of it, and is compared exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.common import cut, table

SHINGLE, THRESHOLD = 5, 0.8
#: At similarity 0.8 fingerprints differ in 9.6 of 64 bits on average, with deviation 2.9: 21 is four deviations above.
RADIUS = 21
BLOCKS = [(3 * i, 3) for i in range(20)] + [(60, 2), (62, 2)]
#: Index tables are broadcast up to this many rows, and joined by key beyond.
BROADCAST_ROWS = 100_000


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text; none for null."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.transform(F.filter(F.split(flat, " ", -1), lambda w: w != ""), lambda w: F.xxhash64(w))


def grams(words: str, k: int) -> Column:
    """Hashes of all shingles of k words of a column of word hashes."""
    n = F.size(words)
    at = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))


def simhash(hashes: str) -> Column:
    """64 bits; each is the majority of the shingles' bits, with their multiplicity as weight."""
    ones = lambda b: F.aggregate(hashes, F.lit(0), lambda s, h: s + F.getbit(h, b).cast("int"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda x, b: x.bitwiseOR(F.when(ones(b) * 2 > F.size(hashes), F.expr("1L")).otherwise(F.expr("0L")) * F.call_function("shiftleft", F.expr("1L"), b)))


def _block(x: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << width) - 1).cast("long")).cast("int")


def _blocks(fp: str) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("block"), _block(F.col(fp), *b).alias("bits")) for i, b in enumerate(BLOCKS)]))


def _first_shared(x: Column) -> Column:
    """The first block in which two fingerprints agree, of their xor: a pair is met once there."""
    return reduce(lambda rest, i: F.when(_block(x, *BLOCKS[i]) == 0, i).otherwise(rest), reversed(range(len(BLOCKS))), F.lit(-1))


def _held(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def tagged(hashes: str) -> Column:
    """Each hash with its number among its equals, hashed: what two arrays have in common of these is
    the sum of the smaller multiplicities."""
    order = F.array(F.array_sort(hashes))
    number = lambda of: F.transform(of, lambda h, i: F.xxhash64(h, i.cast("long") - F.array_position(of, h)))
    return F.get(F.transform(order, number), F.lit(0))


def _short_texts(hits: DataFrame, index: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, rid, item_id, similarity) at the threshold of texts and the longer items they may be most of."""
    of_text = hits.where(F.col("dn") < F.array_max("ns")).groupBy("doc_id", "rid", "dn", "k", "h").agg(F.count_distinct("pos").alias("times"))
    kinds = index.select("item_id", F.xxhash64("its").alias("iid"), "n", "k", "its").dropDuplicates(["item_id", "iid"])
    of_item = kinds.select("item_id", "iid", "n", "k", F.explode("its").alias("h")).groupBy("item_id", "iid", "n", "k", "h").agg(F.count(F.lit(1)).alias("asked"))
    of_item = _held(of_item, of_item.count())
    m, of = F.col("dn") - F.col("k") + 1, F.col("n") - F.col("k") + 1
    met = of_text.join(of_item, ["k", "h"]).where((F.col("dn") < F.col("n")) & (m >= F.lit(threshold) * of - 1e-9))
    pairs = met.groupBy("doc_id", "rid", "item_id", "iid", m.alias("m"), of.alias("of")).agg(F.sum(F.least("times", "asked")).alias("shared"))
    return pairs.select("doc_id", "rid", "item_id", (F.col("shared") / (F.col("m") + F.col("of") - F.col("shared"))).alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", threshold: float = THRESHOLD) -> DataFrame:
    """_leaks() without the rows' hashes."""
    return _leaks(docs, items, key, text, item, threshold).drop("rid")


def _leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, rid, item_id, similarity, windows): each pair of a document and an item with a window at
    the threshold or above, the best similarity, and how many windows there are. A text shorter than
    the item is its own window.

    Items of under SHINGLE words are one shingle; items and texts without words, null ones too,
    match nothing. Rows that repeat both id and text give one row; rows with a null id are matched,
    under null. Repeated items match each. Other columns are ignored; empty tables give no rows.
    """
    least = lambda m: F.ceil(F.lit(2.0 * threshold / (1.0 + threshold) - 1e-9) * m)  # noqa: E731  shingles to share at the threshold
    asked = items.select(F.col(item).alias("item_id"), word_hashes(F.col(text)).alias("w")).withColumn("n", F.size("w")).where("n > 0").withColumn("k", F.least(F.lit(SHINGLE), "n"))
    by_k = [asked.where(F.col("k") == k).select("item_id", "n", "k", grams("w", k).alias("its")) for k in range(1, SHINGLE + 1)]
    index = cut(reduce(DataFrame.union, by_k).select("*", simhash("its").alias("ifp"), tagged("its").alias("itags"), F.monotonically_increasing_id().alias("at")))
    ks = [r.k for r in index.select("k").distinct().collect()]  # SHINGLE rows at most
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(key, text).alias("rid"), F.col(text).alias("text"))
    if not ks:
        return rows.select("doc_id", "rid", F.lit(None).cast(index.schema["item_id"].dataType).alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).cast("long").alias("windows")).where("false")
    known = index.select("k", "n", F.explode("its").alias("h")).groupBy("k", "h").agg(F.collect_set("n").alias("ns"))
    known = _held(known, known.count())
    words = rows.select("doc_id", "rid", word_hashes(F.col("text")).alias("w"))
    hits = cut(reduce(DataFrame.union, [words.select("doc_id", "rid", F.size("w").alias("dn"), F.lit(k).alias("k"), F.posexplode(grams("w", k)).alias("pos", "h")).join(known, ["k", "h"]) for k in ks]))

    spots = hits.select("doc_id", "rid", "k", "dn", "pos", F.explode("ns").alias("n")).where("dn >= n").groupBy("doc_id", "rid", "k", "n").agg(F.array_sort(F.collect_set("pos")).alias("ps"), F.first("dn").alias("dn"))
    spots = spots.withColumn("m", F.col("n") - F.col("k") + 1).withColumn("need", least(F.col("m")).cast("int"))
    low = lambda p, i: F.greatest(F.lit(0), F.get("ps", i + F.col("need") - 1) - F.col("m") + 1, F.when(i > 0, F.get("ps", i - 1) + 1).otherwise(0))  # noqa: E731  the first start whose first hit is p
    high = lambda p: F.least(p, F.col("dn") - F.col("n"))
    enough = lambda p, i: (i + F.col("need") <= F.size("ps")) & (low(p, i) <= high(p))
    starts = F.flatten(F.transform("ps", lambda p, i: F.when(enough(p, i), F.sequence(low(p, i), high(p))).otherwise(F.array().cast("array<int>"))))
    near = cut(spots.where(F.size("ps") >= F.col("need")).select("doc_id", "rid", "k", "n", "m", starts.alias("starts")).where(F.size("starts") > 0))

    # Whole texts are read again for the rows with such windows alone; no other text is shuffled.
    few = near.select(F.col("doc_id").alias("of"), F.col("rid").alias("of_rid")).distinct()
    few = _held(few, few.limit(BROADCAST_ROWS + 1).count())
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("rid") == F.col("of_rid"))
    texts = rows.join(few, same, "left_semi").dropDuplicates(["doc_id", "rid"]).select("doc_id", "rid", word_hashes(F.col("text")).alias("w"))
    parts = []
    for k in ks:
        at = near.where(F.col("k") == k).withColumnsRenamed({"doc_id": "of", "rid": "of_rid"})
        held = texts.select("doc_id", "rid", grams("w", k).alias("g")).join(at, same)
        parts.append(held.select("doc_id", "rid", "k", "n", "m", "g", F.explode("starts").alias("s")).select("doc_id", "rid", "k", "n", "m", F.slice("g", F.col("s") + 1, F.col("m")).alias("hs")))
    windows = cut(reduce(DataFrame.union, parts).select("doc_id", "rid", "k", "n", "m", simhash("hs").alias("fp"), tagged("hs").alias("tags"), F.monotonically_increasing_id().alias("wid")))

    # Only numbers and fingerprints go through the index; tags are fetched for the pairs within the radius.
    wide = windows.select("wid", "fp", "k", "n", _blocks("fp").alias("x")).select("wid", "fp", "k", "n", "x.block", "x.bits")
    blocks = index.select("at", "ifp", "k", "n", _blocks("ifp").alias("x")).select("at", "ifp", "k", "n", "x.block", "x.bits")
    total = index.count()
    apart = F.col("fp").bitwiseXOR(F.col("ifp"))
    pairs = wide.join(_held(blocks, total * len(BLOCKS)), ["k", "n", "block", "bits"]).where((F.bit_count(apart) <= RADIUS) & (_first_shared(apart) == F.col("block"))).select("wid", "at")
    both = pairs.join(windows.select("wid", "doc_id", "rid", "m", "tags"), "wid").join(_held(index.select("at", "item_id", "itags"), total), "at")
    both = both.select("doc_id", "rid", "item_id", "m", F.size(F.array_intersect("tags", "itags")).alias("shared"))
    scored = both.select("doc_id", "rid", "item_id", (F.col("shared") / (F.lit(2) * F.col("m") - F.col("shared"))).alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)
    scored = scored.union(_short_texts(hits, index, threshold))
    return scored.groupBy("doc_id", "rid", "item_id").agg(F.max("similarity").alias("similarity"), F.count(F.lit(1)).alias("windows"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_leaks() of all documents and benchmark items: a row for each pair of them that matches."""
    return find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a leak go, by id and text: a clean row that shares its id with a leaked one stays.
    Null and empty texts stay; with an empty benchmark all do."""
    gone = cut(_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "rid").distinct())
    gone = _held(gone, gone.limit(BROADCAST_ROWS + 1).count())
    here = (F.xxhash64(docs["doc_id"], docs["text"]) == gone["rid"]) & docs["doc_id"].eqNullSafe(gone["doc_id"])
    return docs.join(gone, here, "left_anti")


SQL: dict[str, str] = {}
QUERIES = {"op8_decontaminate": op8_decontaminate}
