"""Source divergence audit by mergeable radix tries (operator 12).

Each task counts the terms of its documents in byte tries, one a language: the upper levels are the
first bytes of a term, a node below them is a sorted run of leaves, and each leaf has the number of
its documents and a counter for each source. Tries are written node by node, so nodes of one prefix
from all tasks meet by ranges of (language, prefix) and are merged there. Nodes that hold too many
leaves are burst: their prefix is made longer until they fit, so no prefix is a hot key.

What is kept is read in UTF-8 order: each task adds up the divergence of all pairs of a language's
sources and keeps its best terms of each group, which a last ranking merges.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varloom.llm.common import cut, released, table, values

LEAST, SCALE, PRIOR, BEST = 10, 1_000_000_000, 2, 10
#: Bytes of the first prefixes, leaves that a merged node may hold, counters of a task's tries, and words counted at once.
DEPTH, NODE, FLUSH, WORDS = 2, 400_000, 600_000, 100_000

#: Bytes to lower-cased letters; what is no letter separates terms.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SEGMENT = "lang string, prefix binary, leaves long, terms array<binary>, df array<long>, sources array<string>, term_at array<int>, source_at array<int>, n array<long>"
_ARROW = pa.schema([("lang", pa.string()), ("prefix", pa.binary()), ("leaves", pa.int64()), ("terms", pa.list_(pa.binary())), ("df", pa.list_(pa.int64())), ("sources", pa.list_(pa.string())), ("term_at", pa.list_(pa.int32())), ("source_at", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])


class Node:
    """Sorted leaves below a prefix: terms, their documents, and counters as (leaf, source, count) triples."""

    def __init__(self, terms: list[bytes], df: np.ndarray, sources: list[str], leaf: np.ndarray, source: np.ndarray, n: np.ndarray):
        self.terms, self.df, self.sources, self.leaf, self.source, self.n = terms, df, sources, leaf, source, n

    @staticmethod
    def merge(nodes: list[Node]) -> Node:
        """Leaves of equal terms become one: documents and counters are added."""
        terms = sorted(set().union(*[x.terms for x in nodes]))
        sources = sorted(set().union(*[x.sources for x in nodes]))
        place, seat = {t: i for i, t in enumerate(terms)}, {s: i for i, s in enumerate(sources)}
        df, keys, counts = np.zeros(len(terms), np.int64), [], []
        for x in nodes:
            at = np.fromiter(map(place.__getitem__, x.terms), np.int64, len(x.terms))
            df[at] += x.df
            own = np.fromiter(map(seat.__getitem__, x.sources), np.int64, len(x.sources))
            keys.append(at[x.leaf] * len(sources) + own[x.source] if len(x.leaf) else np.empty(0, np.int64))
            counts.append(x.n)
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.zeros(len(key), np.int64)
        np.add.at(n, back, np.concatenate(counts))
        leaf, source = np.divmod(key, max(1, len(sources)))
        return Node(terms, df, sources, leaf, source, n)

    def take(self, keep: np.ndarray) -> Node:
        """The leaves where keep is true."""
        to = np.cumsum(keep) - 1
        own = keep[self.leaf] if len(self.leaf) else np.empty(0, bool)
        return Node([t for t, k in zip(self.terms, keep, strict=True) if k], self.df[keep], self.sources, to[self.leaf[own]] if len(own) else self.leaf, self.source[own], self.n[own])

    def children(self, depth: int) -> Iterator[tuple[bytes, Node]]:
        """Its parts by longer prefixes, in order."""
        if not self.terms:
            return
        heads = [t[:depth] for t in self.terms]
        starts = [i for i, h in enumerate(heads) if not i or h != heads[i - 1]]
        bounds = np.searchsorted(self.leaf, [*starts, len(heads)])
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(heads)], strict=True)):
            lo, hi = bounds[k], bounds[k + 1]
            used = np.flatnonzero(np.bincount(self.source[lo:hi], minlength=len(self.sources)))
            seat = np.zeros(len(self.sources), np.int64)
            seat[used] = np.arange(len(used))
            yield heads[a], Node(self.terms[a:b], self.df[a:b], [self.sources[i] for i in used], self.leaf[lo:hi] - a, seat[self.source[lo:hi]], self.n[lo:hi])

    def row(self, lang: str, prefix: bytes) -> tuple:
        return lang, prefix, len(self.terms), self.terms, self.df, self.sources, self.leaf.astype(np.int32), self.source.astype(np.int32), self.n


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)


def _numbered() -> defaultdict:
    """Numbers its keys in the order in which they are first asked for."""
    made: defaultdict = defaultdict()
    made.default_factory = made.__len__
    return made


class Counts:
    """Counters of one language: of each (term, source) its occurrences and documents, as arrays."""

    def __init__(self) -> None:
        self.terms, self.sources = _numbered(), _numbered()
        self.key, self.n, self.docs = (np.empty(0, np.int64) for _ in range(3))
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.terms.__getitem__, words), np.int64, len(words))

    def add(self, texts: list[np.ndarray], sources: list[str]) -> None:
        """Counts documents' words, as numbers; a document has one source, so it counts once for each of its terms."""
        term = np.concatenate(texts)
        doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        source = np.fromiter(map(self.sources.__getitem__, sources), np.int64, len(sources))
        own, n = np.unique(term * len(texts) + doc, return_counts=True)
        term, doc = np.divmod(own, len(texts))
        self.new.append((term << 32 | source[doc], n))
        self.waiting += len(own)

    def fold(self) -> int:
        """Adds up what waits; gives the number of counters, one more for each term."""
        if self.new:
            key = np.concatenate([self.key, *[k for k, _ in self.new]])
            n = np.concatenate([self.n, *[c for _, c in self.new]])
            docs = np.concatenate([self.docs, np.ones(self.waiting, np.int64)])
            order = np.argsort(key)
            key = key[order]
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
            self.key, self.n, self.docs = (key[at], np.add.reduceat(n[order], at), np.add.reduceat(docs[order], at)) if len(at) else (key, n, docs)
            self.new, self.waiting = [], 0
        return len(self.key) + len(self.terms)

    def trie(self, lang: str) -> Iterator[tuple]:
        """Rows of the language's trie: its sources under the empty prefix, then its nodes."""
        self.fold()
        terms, sources = sorted(self.terms), sorted(self.sources)
        place, seat = np.empty(len(terms), np.int64), np.empty(len(sources), np.int64)
        place[self.numbers(terms)] = np.arange(len(terms))
        seat[np.fromiter(map(self.sources.__getitem__, sources), np.int64, len(sources))] = np.arange(len(sources))
        leaf, source = place[self.key >> 32], seat[self.key & 0xFFFFFFFF]
        order = np.argsort(leaf * len(sources) + source)
        df = np.zeros(len(terms), np.int64)
        np.add.at(df, leaf, self.docs)
        empty = np.empty(0, np.int64)
        yield Node([], empty, sources, empty, empty, empty).row(lang, b"")
        for prefix, node in Node(terms, df, sources, leaf[order], source[order], self.n[order]).children(DEPTH):
            yield node.row(lang, prefix)


def count_tries(flush: int = FLUSH):  # noqa: ANN201
    """A task's tries over rows (text, lang, source); they are written when they hold flush counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counts] = defaultdict(Counts)
        texts: dict[str, tuple[list, list]] = defaultdict(lambda: ([], []))
        step, size, held = min(flush, WORDS), 0, 0

        def counted() -> None:
            for lang, (words, sources) in texts.items():
                counts[lang].add(words, sources)
            texts.clear()

        def written() -> Iterator[pa.RecordBatch]:
            for lang in sorted(counts):
                rows = []
                for row in counts[lang].trie(lang):
                    rows.append(row)
                    if len(rows) == 64:
                        yield _record(rows, _ARROW)
                        rows = []
                yield _record(rows, _ARROW)
            counts.clear()

        for b in batches:
            for text, lang, source in zip(values(b.column(0)), values(b.column(1)), values(b.column(2)), strict=True):
                words = text.encode().translate(LETTERS).split()
                own = texts[lang]
                own[0].append(counts[lang].numbers(words))
                own[1].append(source)
                size += len(words) + 1
                if size > step:
                    counted()
                    size = 0
                    if held + sum(c.waiting for c in counts.values()) > flush:
                        held = sum(c.fold() for c in counts.values())
                        if held > flush:
                            yield from written()
                            held = 0
        counted()
        yield from written()

    return released(run)


def _nodes(b: pa.RecordBatch) -> Iterator[tuple[int, Node]]:
    """The nodes of a batch's rows, one at a time; numbers are copied as arrays, without an object for each."""
    terms, df, sources, term_at, source_at, n = map(b.column, _ARROW.names[3:])
    a = lambda x: np.array(x.values.to_numpy(zero_copy_only=False), np.int64)
    for i in range(b.num_rows):
        yield i, Node(terms[i].as_py(), a(df[i]), sources[i].as_py(), a(term_at[i]), a(source_at[i]), a(n[i]))


def burst(depth: int):  # noqa: ANN201
    """Nodes to their children by prefixes of depth bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, node in _nodes(b):
                lang = b.column(0)[i].as_py()
                yield _record([part.row(lang, prefix) for prefix, part in node.children(depth)], _ARROW)

    return released(run)


def merge_nodes(least: int):  # noqa: ANN201
    """Merges the nodes of each (lang, prefix) of a sorted range; leaves of under least documents go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, held, most = None, [], 0, 0

        def done() -> Iterator[pa.RecordBatch]:
            if nodes:
                node = Node.merge(nodes)
                if (keep := node.df >= least).any():
                    yield _record([node.take(keep).row(*key)], _ARROW)

        for b in batches:
            for i, node in _nodes(b):
                if (own := (b.column(0)[i].as_py(), b.column(1)[i].as_py())) != key:
                    yield from done()
                    key, nodes, held, most = own, [], 0, 0
                nodes.append(node)
                held += len(nodes[-1].terms)
                if held > 2 * max(most, NODE // 4):  # leaves that recur are folded before they pile up
                    nodes = [Node.merge(nodes)]
                    held = most = len(nodes[0].terms)
        yield from done()

    return released(run)


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE (count + PRIOR) / total) without a product beyond 64 bits: three digits a step."""
    rest = count + PRIOR
    q, rest = np.divmod(rest, total)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, total)
        q = q * 1000 + step
    return 1 + q


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kept nodes with their language's sources, totals and number of terms: partial sums of
    pairs, and the task's best terms of each group."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    pairs: dict[str, tuple[list[str], np.ndarray]] = {}
    best: dict[tuple[str, str], list] = defaultdict(list)
    for b in batches:
        for at, node in _nodes(b):
            row = {c: b.column(c)[at].as_py() for c in ("lang", "all_sources", "totals", "kept")}
            lang, names = row["lang"], row["all_sources"]
            seat, width = {s: i for i, s in enumerate(names)}, len(names)
            own = np.array([seat[s] for s in node.sources], np.int64)
            sums = pairs.setdefault(lang, (names, np.zeros((width, width), np.int64)))[1]
            totals = np.array(row["totals"], np.int64) + PRIOR * row["kept"]
            whole = int(sum(row["totals"])) + PRIOR * row["kept"]
            step = max(1, 4_000_000 // max(1, width))
            for lo in range(0, len(node.terms), step):
                hi = min(lo + step, len(node.terms))
                a, z = np.searchsorted(node.leaf, [lo, hi])
                dense = np.zeros((hi - lo, width), np.int64)
                dense[node.leaf[a:z] - lo, own[node.source[a:z]]] = node.n[a:z]
                p, q = share(dense, totals[None, :]), share(dense.sum(axis=1), whole)
                for i in range(width):
                    sums[i, i + 1 :] += divergence(p[:, i : i + 1], p[:, i + 1 :]).sum(axis=0)
                    up = np.flatnonzero((dense[:, i] > 0) & (p[:, i] > q))
                    f = divergence(p[up, i], q[up])
                    if len(f) > BEST:  # ties go to the smaller term, and terms are in order
                        first = np.sort(np.argsort(-f, kind="stable")[:BEST])
                        up, f = up[first], f[first]
                    top = best[lang, names[i]]
                    top += [(-int(v), node.terms[lo + t]) for v, t in zip(f, up, strict=True)]
                    top.sort()
                    del top[BEST:]
    rows = [(lang, names[i], "pair", names[j], int(sums[i, j])) for lang, (names, sums) in pairs.items() for i in range(len(names)) for j in range(i + 1, len(names))]
    rows += [(lang, source, "term", t.decode(), -v) for (lang, source), top in best.items() for v, t in top]
    for at in range(0, len(rows), 20_000):
        yield _record(rows[at : at + 20_000], schema)


def merged_tries(docs: DataFrame, least: int = LEAST, node: int = NODE, flush: int = FLUSH) -> tuple[DataFrame, DataFrame]:
    """(groups, kept): the (lang, source) groups that occur, and nodes of the terms in at least ``least``
    documents of their language. Nodes of over ``node`` leaves in all tasks are burst before they are merged."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    tries = cut(read.mapInArrow(count_tries(flush), SEGMENT))
    groups = cut(tries.where("leaves = 0").select("lang", F.explode("sources").alias("source")).distinct())
    nodes, depth, done = tries.where("leaves > 0"), DEPTH, []
    while True:
        size = nodes.groupBy("lang", "prefix").agg(F.sum("leaves").alias("_all"))
        # a prefix as long as the depth may still branch; a shorter one is a whole term
        large = cut(size.where((F.col("_all") > node) & (F.length("prefix") == depth)).select("lang", "prefix"))
        if large.isEmpty():
            break
        done.append(nodes.join(large, ["lang", "prefix"], "left_anti"))
        depth *= 2
        nodes = cut(nodes.join(large, ["lang", "prefix"], "left_semi").select(tries.columns).mapInArrow(burst(depth), SEGMENT))
    for x in done:
        nodes = nodes.unionByName(x)
    ranged = nodes.repartitionByRange("lang", "prefix").sortWithinPartitions("lang", "prefix")
    return groups, cut(ranged.mapInArrow(merge_nodes(least), SEGMENT))


def source_divergence(docs: DataFrame, least: int = LEAST, node: int = NODE, flush: int = FLUSH) -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source) group.

    Part ``pair``: each other source of the language with the divergence summed over all kept terms (0
    without any), all ranks. Part ``term``: kept terms that the group has and uses more than its language,
    the ten of the highest divergence. Ties go to the smaller item by UTF-8.

    Null text, lang and source are the empty text. Repeated rows count again. Other columns are ignored.
    No rows: no rows. A language of one source has neither part.
    """
    groups, kept = merged_tries(docs, least, node, flush)
    cell = F.explode(F.arrays_zip("source_at", "n")).alias("c")
    sums = kept.select("lang", "sources", cell).groupBy("lang", F.get("sources", F.col("c.source_at")).alias("source")).agg(F.sum("c.n").alias("total"))
    number = kept.groupBy("lang").agg(F.sum("leaves").alias("kept"))
    listed = groups.join(sums, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("g"))
    langs = listed.select("lang", F.col("g.source").alias("all_sources"), F.col("g.total").alias("totals"))
    parts = cut(kept.join(langs, "lang").join(number, "lang").mapInArrow(released(_scores), "lang string, source string, part string, item string, value long"))
    half = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = half.union(half.select("lang", "item", "source", "value"))
    other = groups.withColumnRenamed("source", "item")
    pairs = groups.join(other, "lang").where("source <> item").join(both, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    w = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    rank = F.row_number().over(w).alias("rank")
    terms = parts.where("part = 'term'").select("*", rank).where(F.col("rank") <= BEST)
    return pairs.select("*", rank).union(terms)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_divergence() of all documents; nulls, ties and repeats as there."""
    return source_divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


_P = lambda n, total: f"(1 + ({SCALE}::HUGEINT * ({n} + {PRIOR})) // ({total} + {PRIOR} * v))"
_F = "((p - q) * (p - q)) // (p + q)"
SQL = {
    "op12_source_divergence": f"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d), t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST}), m AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, coalesce(n, 0)::HUGEINT AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, term, n, v, sum(n) OVER (PARTITION BY lang, source)::HUGEINT AS own, sum(n) OVER (PARTITION BY lang, term)::HUGEINT AS every, sum(n) OVER (PARTITION BY lang)::HUGEINT AS whole FROM f JOIN m USING (lang)),
p AS (SELECT lang, source, term, n, {_P("n", "own")} AS p, {_P("every", "whole")} AS q FROM s),
x AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, {_F} FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= {BEST}""",
}
QUERIES = {"op12_source_divergence": op12_source_divergence}
