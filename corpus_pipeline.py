"""A corpus pipeline of five stages; each stage's result is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import materialize, table
from lodestone.llm.pipeline_stages import encoding_stage, mixing_stage, near_duplicate_stage, quality_stage, repeated_text_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_text", repeated_text_stage),
    ("source_mix", mixing_stage),
    ("byte_bpe", encoding_stage),
]

#: Learned rules, hashes and token ids have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
