"""The corpus pipeline: five stages over documents, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varloom.llm import decontaminate, language_id, line_dedup, near_dedup, sentencepiece_sampling
from varloom.llm.common import cut, delete, owned, table

#: (name, function of (spark, docs, sf_dir)). All but the last return the columns of documents.
STAGES = [
    ("language_id", language_id.stage),
    ("line_dedup", line_dedup.stage),
    ("simhash_dedup", near_dedup.stage),
    ("decontaminate", decontaminate.stage),
    ("sentencepiece", sentencepiece_sampling.stage),
]

#: Compression, SimHash and Gumbel sampling have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents: doc_id and the sampled segmentations of what is left.

    What a stage and its predecessor wrote on the way is deleted once the stage's own rows are written."""
    docs, old = table(spark, sf_dir, "documents"), []
    for i, (_, stage) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with owned() as made:
            docs = cut(stage(spark, docs, sf_dir))
        for folder in old + made[:-1]:
            delete(spark, folder)
        old = made[-1:]
    return docs
