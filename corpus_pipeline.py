"""The corpus pipeline: stages that each take the documents that the stage before kept."""

from __future__ import annotations

from matchlake.llm import stages
from matchlake.llm.shared import new_path, remove, scratch

STAGES = [
    ("quality classifier", stages.quality),
    ("language ID", stages.language),
    ("MinHash near-dedup", stages.near_duplicates),
    ("mixing sources to target weights", stages.mix),
    ("best-fit packing", stages.pack),
]

#: Trained classifiers and minimum hashes have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows. A stage's input and whatever it wrote on the way are deleted once its output is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"pipeline-{k}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        remove(spark, *before)
        docs, before = spark.read.parquet(path), [path]
    return docs
