"""The corpus pipeline: quality rules, SimHash near-dedup, benchmark
decontamination, mixing to target weights, sharding.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor
kept and returns a DataFrame; ``run`` writes each stage's rows as Parquet to
the shared folder and reads them back as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxframe.llm import stages
from voxframe.llm.common import staged, table

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("simhash_dedup", stages.simhash_dedup),
    ("decontaminate", stages.decontaminate),
    ("mix_sources", stages.mix_sources),
    ("shard", stages.shard),
]

#: SQL has no way to write the XXH64 votes of the SimHash stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
