"""Exact top-k inner-product search by a Voronoi kNN join (operator 5).

Vectors are grouped by their nearest pivot. A group's summary (its size, its radius, the smallest
distances to its pivot) bounds what any query can find in it: q.c <= q.p + |q| r, and a member at
distance d has q.c >= q.p - |q| d. The k-th largest lower bound over all summaries is a floor for
the k-th best score, and a query is sent only to the groups whose upper bound reaches it. Queries of
near groups share a block; a candidate is copied to the blocks alone that have a query for its group
which can reach its own distance. Groups and query sets are cut into parts of bounded size, so that a
hot group is many tasks; each part is solved locally and the results are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varloom.llm.common import cut, table

K, SCALE = 5, 256.0
#: Pivots: a quarter of the root of the number of vectors, within these; the bounded sample that they are placed by.
PIVOTS, SAMPLE, ROUNDS = (48, 1024), 4096, 4
#: Rows of a block of candidates or queries.
BLOCK = 16_384
MAX_LONG = 2**63 - 1
#: Rows of the table of blocks and the groups that they reach that are broadcast; more are joined.
BROADCAST_ROWS = 100_000


def _valid(vector: str) -> Column:
    """No null, and none that is NaN or infinite when scaled."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double") * SCALE) < float("inf")))


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id and floor(256 x) as the bytes of doubles."""
    for b in batches:
        lists = b.column(1)
        flat = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).tobytes()
        ends = (np.cumsum([0, *lists.value_lengths().to_pylist()]) * 8).tolist()
        out = [flat[lo:hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], names=["vec_id", "v"])


def _matrix(blobs: list[bytes], dim: int = 0) -> np.ndarray:
    """Rows of doubles; shorter ones end in zeros."""
    dim = max([dim, *(len(x) // 8 for x in blobs)])
    out = np.zeros((len(blobs), dim))
    for row, x in zip(out, blobs, strict=True):
        row[: len(x) // 8] = np.frombuffer(x)
    return out


def place_pivots(sample: np.ndarray, n: int = PIVOTS[0]) -> np.ndarray:
    """Farthest-first centres, moved by a few rounds of means; the result doesn't depend on chance."""
    centres = [sample[0]] if len(sample) else []
    far = np.full(len(sample), np.inf)
    while centres and len(centres) < n and len(centres) < len(sample):
        far = np.minimum(far, ((sample - centres[-1]) ** 2).sum(axis=1))
        if far.max() <= 0:
            break
        centres.append(sample[far.argmax()])
    c = np.array(centres).reshape(len(centres), sample.shape[1])
    for _ in range(ROUNDS if len(c) else 0):
        near = _nearest(sample, c)[0]
        c = np.array([sample[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
    return c


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A nearest pivot, up to rounding, and the distance to it."""
    half = (pivots**2).sum(axis=1) / 2
    near = np.concatenate([np.empty(0, np.int64), *((x[i : i + 4096] @ pivots.T - half).argmax(axis=1) for i in range(0, len(x), 4096))])
    return near, np.sqrt(((x - pivots[near]) ** 2).sum(axis=1))


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles where every partial sum is exact there, else in Python's
    integers, and then held to the range of a long."""
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1] < 2**53:
        return (q @ c.T).astype(np.int64)
    big = [[int(x) for x in row] for row in c.tolist()]
    return np.array([[max(-MAX_LONG - 1, min(MAX_LONG, sum(int(x) * y for x, y in zip(a, b, strict=True)))) for b in big] for a in q.tolist()], np.int64).reshape(len(q), len(c))


def solve(qids: np.ndarray, q: np.ndarray, cids: np.ndarray, c: np.ndarray, k: int = K) -> tuple[list, list, list]:
    """The k best of a block for each query, ties to the smaller id, its own id left out."""
    out: tuple[list, list, list] = ([], [], [])
    for at in range(0, len(q), 256):
        scores = exact_scores(q[at : at + 256], c)
        for i, row in zip(qids[at : at + 256], scores, strict=True):
            other = np.flatnonzero(cids != i)
            s = row[other]
            if len(s) > k:
                keep = s >= np.partition(s, len(s) - k)[len(s) - k]
                other, s = other[keep], s[keep]
            best = np.lexsort((cids[other], -s.astype(object) if len(s) and s.min() == -MAX_LONG - 1 else -s))[:k]
            out[0].extend([int(i)] * len(best))
            out[1].extend(cids[other[best]].tolist())
            out[2].extend(s[best].tolist())
    return out


def knn_join(vectors: DataFrame, is_query: Column, k: int = K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each query id.

    Null ids and vectors, and vectors that hold null, NaN or infinite components, take no part;
    shorter vectors end in zeros. Rows with the query's own id are no candidates. A repeated
    query id asks once, with its smallest vector; repeated candidates count each. Other columns
    are ignored. No rows give no rows.
    """
    spark = vectors.sparkSession
    raw = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("embedding")).where(F.col("vec_id").isNotNull() & _valid("embedding"))
    sample = raw.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).mapInArrow(_integers, "vec_id long, v binary").collect()
    matrix = _matrix([bytes(r.v) for r in sample])
    dim, few = matrix.shape[1], round(math.sqrt(raw.count()) / 4)
    pivots = place_pivots(matrix, max(PIVOTS[0], min(PIVOTS[1], few)))
    empty = "query_id long, rank int, vec_id long, score long"
    if not len(pivots):
        return spark.createDataFrame([], empty)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _integers(batches):
            x = _matrix([bytes(v) for v in b.column(1).to_pylist()], dim)
            p = np.zeros((len(pivots), x.shape[1]))
            p[:, :dim] = pivots
            near, d = _nearest(x, p)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(near.astype(np.int32)), pa.array(d)], names=["vec_id", "v", "g", "d"])

    placed = cut(raw.mapInArrow(assign, "vec_id long, v binary, g int, d double"))
    sizes = {r.g: (r.n, r.r) for r in placed.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("r")).collect()}  # a row a pivot
    # The smallest of each bucket first, so that a hot group isn't ranked in one task.
    close = placed.select("g", "d", "vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("bucket"))
    for over in (("g", "bucket"), ("g",)):
        close = close.withColumn("i", F.row_number().over(Window.partitionBy(*over).orderBy("d", "vec_id"))).where(F.col("i") <= k + 1)
    lower = np.array([[r.g, r.d] for r in close.select("g", "d").collect()])  # k + 1 a pivot
    queries = placed.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "g")).alias("q")).select("vec_id", "q.v", "q.g")
    asked = {r.g: r["count"] for r in queries.groupBy("g").count().collect()}  # a row a pivot
    if not asked:
        return spark.createDataFrame([], empty)
    first, before = {}, 0
    for g in sorted(asked, key=lambda g: tuple(pivots[g])):  # groups that are near in space are often near in this order
        first[g] = (before // BLOCK, math.ceil(asked[g] / BLOCK))
        before += asked[g]
    salts = {g: math.ceil(n / BLOCK) for g, (n, _) in sizes.items()}
    groups = np.array(sorted(sizes))
    radius = np.array([sizes[g][1] for g in groups])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids, blobs = part.column(0).to_pylist(), part.column(1)
                q = _matrix([bytes(v) for v in blobs.to_pylist()], dim)
                qp = q[:, :dim] @ pivots.T
                norm = np.sqrt((q**2).sum(axis=1))
                floor = qp[:, lower[:, 0].astype(int)] - norm[:, None] * lower[:, 1]
                floor = np.partition(floor, floor.shape[1] - k - 1, axis=1)[:, -(k + 1)] if floor.shape[1] > k else np.full(len(q), -np.inf)  # one may be the query itself
                slack = 1e-9 * (1 + np.abs(qp).max(initial=0) + norm * radius.max())
                who, which = np.nonzero(qp[:, groups] + norm[:, None] * radius + slack[:, None] >= (floor - slack)[:, None])
                g = groups[which]
                with np.errstate(divide="ignore", invalid="ignore"):  # members nearer than that to their pivot are out of reach
                    least = np.where(norm[who] > 0, (floor[who] - qp[who, g] - 2 * slack[who]) / norm[who], -np.inf)
                homes = part.column(2).to_pylist()
                block = np.array([first[h][0] + i % first[h][1] for i, h in zip(ids, homes, strict=True)], np.int32)
                yield pa.record_batch([pa.array(g.astype(np.int32)), pa.array(block[who]), pa.array(np.array(ids, np.int64)[who]), blobs.take(pa.array(who)), pa.array(least)], names=["g", "c", "vec_id", "v", "least"])

    def local(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        qb, cb = left["v"].to_pylist(), right["v"].to_pylist()
        q = _matrix(qb, max(len(x) // 8 for x in cb))
        a, b, c = solve(left["vec_id"].to_numpy(), q, right["vec_id"].to_numpy(), _matrix(cb, q.shape[1]), k)
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.int64())})

    sent = cut(queries.mapInArrow(send, "g int, c int, vec_id long, v binary, least double"))
    reach = cut(sent.groupBy("g", "c").agg(F.min("least").alias("least")))
    reach = F.broadcast(reach) if reach.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else reach
    salt = lambda g: F.element_at(F.create_map(*[F.lit(x) for pair in salts.items() for x in pair]), g)
    held = placed.join(reach, "g").where(F.col("d") >= F.col("least")).select("g", F.pmod(F.xxhash64("vec_id"), salt(F.col("g"))).cast("int").alias("s"), "c", "vec_id", "v")
    asks = sent.select("g", F.explode(F.sequence(F.lit(0), salt(F.col("g")) - 1)).alias("s"), "c", "vec_id", "v")
    blocks = asks.groupBy("g", "s", "c").cogroup(held.groupBy("g", "s", "c")).applyInArrow(local, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return blocks.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """knn_join() of the vectors whose vec_id is divisible by 50 against all others; cases as there."""
    return knn_join(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


SQL = {
    "op5_knn_join": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5"""
}
QUERIES = {"op5_knn_join": op5_knn_join}
