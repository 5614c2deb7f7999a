"""The corpus pipeline: toxicity, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of their input. run() writes each stage's rows as
Parquet in the shared checkpoint folder and hands them, read again, to the
next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mycelia.llm import exact_dedup, packing, pii, simhash, toxicity
from mycelia.llm.common import documents, remove, scratch

STAGES = [
    ("toxicity", toxicity.stage),
    ("exact dedup", exact_dedup.stage),
    ("SimHash near-dedup", simhash.stage),
    ("PII", pii.stage),
    ("best-fit packing", packing.stage),
]

#: Trained models and tokenizers are not SQL; the tests hold run() against its parts and brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = scratch(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
