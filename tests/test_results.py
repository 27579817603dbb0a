from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.sources import results


def put(path, text="gene\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def paths(spark, *names):
    return spark.createDataFrame([(str(n),) for n in names], "path string")


def test_level_rankings_by_place_and_search(spark, tmp_path):
    put(tmp_path / "L0/corrected_gene_rankings.csv")
    put(tmp_path / "L0/corrected/corrected_gene_rankings.csv")
    put(tmp_path / "L1/x/y/corrected_gene_rankings_v2.csv")
    put(tmp_path / "L2/corrected/corrected_gene_rankings.csv/part-0000.csv")
    put(tmp_path / "L2/corrected/corrected_gene_rankings.csv/part-0001.csv")
    put(tmp_path / "L3/a/corrected_gene_rankings_a.csv")
    put(tmp_path / "L3/b/corrected_gene_rankings_b.csv")
    put(tmp_path / "L4/other.csv")
    put(tmp_path / "L4/corrected_gene_rankings.csv", "")  # an empty file is none
    made = {r.level: (r.path.split(tmp_path.name + "/")[1], r.found_by) for r in results.level_rankings(spark, str(tmp_path), ["L0", "L1", "L2"]).collect()}
    assert made == {"L0": ("L0/corrected_gene_rankings.csv", "place"), "L1": ("L1/x/y/corrected_gene_rankings_v2.csv", "search"), "L2": ("L2/corrected/corrected_gene_rankings.csv", "place")}
    for level, message in (("L3", "several rankings of level L3"), ("L4", "no rankings of level L4"), ("L9", "no rankings of level L9")):
        with pytest.raises(Exception, match=message):
            results.level_rankings(spark, str(tmp_path), [level]).collect()


def test_settings_of_the_nearest_folder(spark, tmp_path):
    put(tmp_path / "a/analysis_metadata.yaml", "n_samples: 12  # all\ngenome_build: 'GRCh38'\nempty:\nlist:\n  - 1\nurl: http://x/#y\nn_samples: 13\n")
    put(tmp_path / "a/b/analysis_metadata.yaml", 'genome_build: "GRCh37"\n')
    for p in ("a/r.csv", "a/b/r.csv", "a/c/r.csv", "a/c/d/r.csv", "r.csv"):
        put(tmp_path / p)
    found = results.settings(spark, str(tmp_path), "analysis_metadata.yaml")
    files = results.listing(spark, str(tmp_path), "r.csv")
    made = {r.inner: r["values"] for r in results.nearest_settings(files, found).collect()}
    a = {"n_samples": "13", "genome_build": "GRCh38", "empty": None, "list": None, "url": "http://x/#y"}
    assert made == {"a/r.csv": a, "a/b/r.csv": {"genome_build": "GRCh37"}, "a/c/r.csv": a, "a/c/d/r.csv": {}, "r.csv": {}}


def test_classifiers_side_by_side(spark, tmp_path):
    for name, auc in (("L0_topK50", 0.7), ("L0_topK50_lr", 0.6), ("L1_topK5", 0.5), ("L2_topK5_lr", 0.4), ("odd", 0.1)):
        put(tmp_path / f"nonlinear_validation_{name}.yaml", f"observed_auc: {auc}\n")
    put(tmp_path / "below/nonlinear_validation_L7_topK5.yaml", "observed_auc: 1\n")
    np.savez(tmp_path / "null_aucs_L0_topK50.npz", null_aucs=np.arange(200000) / 4)
    np.savez_compressed(tmp_path / "null_aucs_L0_topK50_lr.npz", null_aucs=np.array([0.5], np.float32))
    np.savez(tmp_path / "null_aucs_L1_topK5.npz", other=np.array([0.5]))
    made = {(r.level, r.top_k): r for r in results.classifier_results(spark, str(tmp_path)).collect()}
    assert {k: ((r.rf or {}).get("observed_auc"), (r.lr or {}).get("observed_auc"), r.complete) for k, r in made.items()} == {("L0", 50): ("0.7", "0.6", True), ("L1", 5): ("0.5", None, False), ("L2", 5): (None, "0.4", False)}
    assert made["L0", 50].rf_null == [i / 4 for i in range(200000)] and made["L0", 50].lr_null == [0.5]
    assert made["L1", 5].rf_null is None and made["L2", 5].lr_null is None


def test_attribution_archives(spark, tmp_path):
    def save(name, scores, facts):
        s, m = np.empty(len(scores), object), np.empty(len(facts), object)
        s[:], m[:] = scores, facts
        np.savez(tmp_path / name, variant_scores=s, metadata=m)
        return tmp_path / name

    meta = lambda *rows: {"positions": [r[1] for r in rows], "chromosomes": [r[0] for r in rows], "gene_ids": [r[2] for r in rows]}
    good = save("a.npz", [np.array([0.5, 1.5]), np.array([])], [meta(("chr1", 10, 3), ("X", 20, 4)), meta()])
    made = results.npz_attributions(paths(spark, good), trusted=True).collect()
    assert [(r.sample_index, r.chrom, r.pos, r.gene_id, r.score) for r in made] == [(0, "1", 10, "3", 0.5), (0, "X", 20, "4", 1.5)]
    with pytest.raises(Exception, match="only from trusted archives"):
        results.npz_attributions(paths(spark, good)).collect()
    bad = save("b.npz", [np.array([0.5])], [meta()])
    with pytest.raises(Exception, match="different lengths"):
        results.npz_attributions(paths(spark, bad), trusted=True).collect()
    np.savez(tmp_path / "c.npz", variant_scores=np.array([1.0]))
    with pytest.raises(Exception, match="lacks variant_scores or metadata"):
        results.npz_attributions(paths(spark, tmp_path / "c.npz"), trusted=True).collect()


def test_archives_written_by_tasks(spark, tmp_path):
    rows = spark.range(6).select(F.concat(F.lit("x"), "id", F.lit(".npz")).alias("file"), F.transform(F.sequence(F.lit(0), F.col("id")), lambda i: i / 2).alias("null_aucs"))
    folder = str(tmp_path / "out")
    assert results.write_files(results.archives(rows, "file", ["null_aucs"]), folder) == 6
    files = results.listing(spark, folder, "*.npz")
    assert {r.path.split("/")[-1]: r.null_aucs for r in results.null_aucs(files).collect()} == {f"x{i}.npz": [j / 2 for j in range(i + 1)] for i in range(6)}
