"""What the operators of this subpackage share: table reads, lineage cuts and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(column: pa.Array, step: int = 256) -> Iterator:
    """A column's values as Python objects, few of them at a time: a batch may hold many long texts."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def release() -> None:
    """Gives what a task has freed back to the system: Python workers live on beside other stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run() over batches, and release() after each batch and at the end."""

    def out(batches: Iterator) -> Iterator:
        for b in run(batches):
            yield b
            release()
        release()

    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` where it is set. Else the
    warehouse on a cluster, and a temporary folder in local mode alone."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if (master := spark.sparkContext.master).startswith("local") and not master.startswith("local-cluster"):
        return f"file://{_own()}"
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_varloom_checkpoints"


@cache
def _own() -> str:
    """One folder a process; the setting itself can't be changed in a running session."""
    return tempfile.mkdtemp(prefix="varloom-")


_OWNERS: list[list[str]] = []


@contextmanager
def owned() -> Iterator[list[str]]:
    """Collects the folders that cut() writes meanwhile, so that their owner can delete them."""
    made: list[str] = []
    _OWNERS.append(made)
    try:
        yield made
    finally:
        _OWNERS.remove(made)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: the lineage ends there, each
    row is computed once, and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    for made in _OWNERS:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Deletes what cut() wrote, once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of the undirected edges; component is the smallest node.

    Minimum-label propagation with pointer jumping. Each round is two joins and two partially
    aggregated minima, so a hub is combined before the shuffle and never meets in one task.
    Null ends are ignored. No edges: no rows.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    links = cut(pairs.union(pairs.select("v", "u")).distinct())
    labels = cut(links.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("component")))
    while True:
        heard = links.join(labels, links.u == labels.node).select(F.col("v").alias("node"), "component")
        low = heard.union(labels).groupBy("node").agg(F.min("component").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("top"))
        new = cut(low.join(up, "component").select("node", F.least("component", "top").alias("component")))
        moved = new.join(labels.withColumnRenamed("component", "old"), "node").where("component < old").limit(1).count()
        drop_cut(labels)
        labels = new
        if not moved:
            drop_cut(links)
            return labels
