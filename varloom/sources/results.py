"""Result trees: files found by name through the reader's own listing, settings of the nearest folder, NPZ archives,
and the outcomes of two classifiers side by side.

A table that Spark wrote as a folder of part files counts as one file of the folder's name. Archives and settings are
opened in tasks; the driver sees neither, and a listing is a DataFrame.
"""

from __future__ import annotations

import io
import pickle
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.functions.genome import normalise_chrom
from varloom.sources.blocks import _open as open_file

#: Places of a level's rankings below its folder, the first that is there wins. Fixed values.
RANKINGS = (
    "gene_rankings_with_significance.csv",
    "corrected_gene_rankings_with_significance.csv",
    "corrected_gene_rankings.csv",
    "results/attribution_comparison/gene_rankings_with_significance.csv",
    "corrected/corrected_gene_rankings_with_significance.csv",
    "corrected/corrected_gene_rankings.csv",
    "results/attribution_comparison_corrected/corrected_gene_rankings_with_significance.csv",
    "results/explainability/corrected/corrected_gene_rankings.csv",
)
ROWS = 1 << 16


def listing(spark: SparkSession, root: str, glob: str = "*", deep: bool = True) -> DataFrame:
    """(path, inner): files below root whose name fits, or whose folder's does for part files of a written table;
    inner is the path below root. No file is opened; empty files don't count, as no scan gives them."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    home = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", deep).load(root).select("path")
    whole = F.regexp_replace("path", r"/part-[^/]*$", "")
    plain = lambda c: F.regexp_replace(c, "^([a-z]+):/+", "$1:/")  # noqa: E731  file:/x and file:///x are one
    inner = F.substring(plain(whole), F.length(plain(F.lit(home))) + 2, F.lit(1 << 30))
    like = F.regexp_like(F.regexp_extract(inner, "[^/]*$", 0), F.lit("^" + glob.replace(".", r"\.").replace("*", ".*") + "$"))
    return found.select(whole.alias("path"), inner.alias("inner")).where(like & (F.col("inner") != "")).distinct()


def level_rankings(spark: SparkSession, root: str, levels: list[str]) -> DataFrame:
    """(level, path, found_by) of each level's corrected gene rankings: the first of RANKINGS below its folder
    (``place``), else the only corrected_gene_rankings*.csv anywhere below (``search``). A level with none or with several
    is an error."""
    all_files = listing(spark, root, "*.csv")
    f = all_files.select("path", F.split("inner", "/", 2)[0].alias("level"), F.get(F.split("inner", "/", 2), F.lit(1)).alias("rest")).where(F.col("level").isin(levels))
    place = F.array_position(F.array(*map(F.lit, RANKINGS)), F.col("rest"))
    f = f.withColumn("at", F.nullif(place, F.lit(0))).withColumn("like", F.regexp_like("rest", F.lit(r"(^|/)corrected_gene_rankings[^/]*\.csv$")))
    g = f.groupBy("level").agg(F.min_by("path", "at").alias("best"), F.min("at").alias("at"), F.count_if("like").alias("n"), F.min(F.when(F.col("like"), F.col("path"))).alias("only"))
    asked = spark.createDataFrame([(x,) for x in levels], "level string").join(g, "level", "left")
    several = F.raise_error(F.concat(F.lit("several rankings of level "), "level"))
    none = F.raise_error(F.concat(F.lit("no rankings of level "), "level"))
    path = F.when(F.col("at").isNotNull(), F.col("best")).when(F.col("n") == 1, F.col("only")).when(F.col("n") > 1, several.cast("string")).otherwise(none.cast("string"))
    return asked.select("level", path.alias("path"), F.when(F.col("at").isNotNull(), "place").otherwise("search").alias("found_by"))


def scalars(text: Column) -> Column:
    """Map of the top-level ``key: value`` lines of a YAML text: quotes and comments after a space are taken off,
    ``null`` and ``~`` are null, the last of repeated keys counts. Nested values and lists are not read."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.regexp_like(x, F.lit(r"^[A-Za-z_][A-Za-z0-9_.-]*:([ \t]|$)")))

    def value(x: Column) -> Column:
        raw = F.trim(F.regexp_replace(x, r"^[^:]*:", ""))
        quoted = F.regexp_extract(raw, r"""^(["'])(.*)\1""", 2)
        bare = F.trim(F.regexp_replace(raw, r"(^|\s)#.*$", ""))
        return F.when(F.regexp_like(raw, F.lit(r"""^(["']).*\1""")), quoted).when(bare.isin("", "~", "null", "Null", "NULL"), F.lit(None)).otherwise(bare)

    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, "^[^:]*", 0).alias("k"), value(x).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"].alias("value"))))


def settings(spark: SparkSession, root: str, glob: str, deep: bool = True) -> DataFrame:
    """(path, values) of YAML files by name; small files, one row each."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", deep).option("pathGlobFilter", glob).load(root)
    return read.select("path", scalars(F.decode("content", "UTF-8")).alias("values"))


def nearest_settings(files: DataFrame, found: DataFrame, up: int = 2) -> DataFrame:
    """files (path, ...) with the values of the settings file in the file's folder, or in the nearest of the ``up``
    folders from there on; an empty map where there is none."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    parts = F.split(folder, "/")
    above = F.transform(F.sequence(F.lit(0), F.lit(up - 1)), lambda i: F.struct(i.alias("up"), F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - i, F.lit(0))), "/").alias("dir")))
    own = found.select(folder.alias("dir"), "values")
    near = files.select("path").distinct().select("path", F.explode(above).alias("a")).select("path", "a.*").join(own, "dir").groupBy("path").agg(F.min_by("values", "up").alias("values"))
    return files.join(near, "path", "left").withColumn("values", F.coalesce("values", F.create_map().cast("map<string,string>")))


def _member(archive: zipfile.ZipFile, name: str, trusted: bool) -> Iterator:
    """A member's array in runs of ROWS entries; object arrays are pickles, so they come whole and only if trusted."""
    import numpy as np

    with archive.open(name + ".npy") as f:
        version = np.lib.format.read_magic(f)
        shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if dtype.hasobject:
            if not trusted:
                raise ValueError(f"{name} holds objects; they are read only from trusted archives")
            yield pickle.load(f).reshape(shape)  # noqa: S301  asked for by the caller
            return
        if len(shape) != 1 or fortran and len(shape) > 1:
            raise ValueError(f"{name} has {len(shape)} dimensions")
        for start in range(0, shape[0], ROWS):
            n = min(ROWS, shape[0] - start)
            yield np.frombuffer(f.read(n * dtype.itemsize), dtype)


def null_aucs(paths: DataFrame, member: str = "null_aucs") -> DataFrame:
    """(path, null_aucs) of archives (path); null where an archive lacks the member. A row holds one array."""

    def read(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with open_file(path) as file, zipfile.ZipFile(file) as z:
                    found = None
                    if member + ".npy" in z.namelist():
                        found = [float(v) for run in _member(z, member, False) for v in run]
                yield pa.RecordBatch.from_pydict({"path": [path], "null_aucs": [found]}, pa.schema([("path", pa.string()), ("null_aucs", pa.list_(pa.float64()))]))

    return paths.select("path").mapInArrow(read, "path string, null_aucs array<double>")


def npz_attributions(paths: DataFrame, trusted: bool = False) -> DataFrame:
    """(path, sample_index, chrom, pos, gene_id, score) of attribution archives (path): variant_scores, one array
    a sample, beside metadata, one dictionary of positions, chromosomes and gene_ids a sample. These are pickles: an
    archive must be trusted. Lengths that differ, missing members and archives without samples are errors."""
    kind = pa.schema([("path", pa.string()), ("sample_index", pa.int32()), ("chrom", pa.string()), ("pos", pa.int64()), ("gene_id", pa.string()), ("score", pa.float64())])

    def read(batches):  # noqa: ANN001, ANN202
        import numpy as np

        for batch in batches:
            for path in batch.column("path").to_pylist():
                with open_file(path) as file, zipfile.ZipFile(file) as z:
                    if not {"variant_scores.npy", "metadata.npy"} <= set(z.namelist()):
                        raise ValueError(f"{path} lacks variant_scores or metadata")
                    scores, facts = (list(next(_member(z, m, trusted))) for m in ("variant_scores", "metadata"))
                if len(scores) != len(facts) or not scores:
                    raise ValueError(f"{path} has {len(scores)} score arrays and {len(facts)} of metadata")
                for i, (s, m) in enumerate(zip(scores, facts, strict=True)):
                    s, columns = np.asarray(s, float).ravel(), [np.asarray(m[c]) for c in ("chromosomes", "positions", "gene_ids")]
                    if {len(c) for c in columns} != {len(s)}:
                        raise ValueError(f"sample {i} of {path} has arrays of different lengths")
                    n = len(s)
                    data = [pa.array([path] * n, pa.string()), pa.array(np.full(n, i, np.int32)), pa.array(columns[0].astype(str).tolist(), pa.string()), pa.array(columns[1].astype(np.int64)), pa.array(columns[2].astype(str).tolist(), pa.string()), pa.array(s)]
                    yield pa.RecordBatch.from_arrays(data, schema=kind)

    made = paths.select("path").mapInArrow(read, "path string, sample_index int, chrom string, pos long, gene_id string, score double")
    return made.withColumn("chrom", normalise_chrom(F.col("chrom")))


def archives(rows: DataFrame, name: str, members: list[str]) -> DataFrame:
    """(name, content) of one archive a row; members are number arrays."""

    def pack(batches):  # noqa: ANN001, ANN202
        import numpy as np

        for batch in batches:
            for r in batch.to_pylist():
                held = io.BytesIO()
                np.savez(held, **{m: np.asarray(r[m], float) for m in members})
                yield pa.RecordBatch.from_pydict({"name": [r[name]], "content": [held.getvalue()]}, pa.schema([("name", pa.string()), ("content", pa.binary())]))

    return rows.select(name, *members).mapInArrow(pack, "name string, content binary")


def write_files(rows: DataFrame, folder: str) -> int:
    """A file a row (name, content), in tasks. A file is written under a name of its own and moved, so that a
    repeated task leaves whole files only. Returns how many rows there were."""

    def write(batches):  # noqa: ANN001, ANN202
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                part = f"{base}/_{uuid.uuid4().hex}"
                if "/" in name:
                    where.create_dir(f"{base}/{name.rpartition('/')[0]}", recursive=True)
                with where.open_output_stream(part) as f:
                    f.write(content.as_buffer())
                where.move(part, f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]}, pa.schema([("n", pa.int64())]))

    return rows.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def classifier_results(spark: SparkSession, root: str) -> DataFrame:
    """(level, top_k, rf, lr, rf_null, lr_null, complete): results of both classifiers next to each other, an outer
    alignment: maps of their settings files nonlinear_validation_<level>_topK<k>[_lr].yaml in the folder, and their
    null AUCs of null_aucs_*.npz, null where there is no archive. A file without a suffix is rf's."""
    pattern = r"nonlinear_validation_(\w+)_topK(\d+?)(?:_(lr))?\.yaml$"
    part = lambda i: F.regexp_extract("path", pattern, i)
    found = settings(spark, root, "nonlinear_validation_*.yaml", False).where(F.regexp_like("path", F.lit(pattern)))
    stem = lambda p, e: F.regexp_extract("path", rf"{p}([^/]*)\.{e}$", 1)
    y = found.select(part(1).alias("level"), part(2).cast("int").alias("top_k"), F.when(part(3) == "lr", "lr").otherwise("rf").alias("clf"), stem("nonlinear_validation_", "yaml").alias("stem"), "values")
    archives = listing(spark, root, "null_aucs_*.npz", False).where(~F.col("inner").contains("/"))
    n = null_aucs(archives).select(stem("null_aucs_", "npz").alias("stem"), "null_aucs")
    both = y.join(n, "stem", "left")
    of = lambda clf, c: F.max_by(F.when(F.col("clf") == clf, F.col(c)), F.col("clf") == clf)
    have = lambda clf: F.count_if(F.col("clf") == clf) > 0
    return both.groupBy("level", "top_k").agg(of("rf", "values").alias("rf"), of("lr", "values").alias("lr"), of("rf", "null_aucs").alias("rf_null"), of("lr", "null_aucs").alias("lr_null"), (have("rf") & have("lr")).alias("complete"))
