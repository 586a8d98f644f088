"""From raw documents to token ids: language, repeated passages, near copies, mixture, encoding.

Each stage takes (spark, docs, sf_dir), reads all its predecessor kept and returns a
DataFrame; ``run`` writes every stage as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarterdeck.llm import stages
from quarterdeck.llm.common import read
from quarterdeck.session import save_stage

STAGES = [
    ("language_id", stages.known_language),
    ("line_dedup", stages.without_repeated_passages),
    ("ngram_jaccard_join", stages.one_of_near_copies),
    ("mixing", stages.mixed),
    ("byte_bpe", stages.encoded),
]

#: fitted classifiers are not SQL; tests/llm holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save_stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
