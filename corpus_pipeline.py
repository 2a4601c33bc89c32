"""A corpus pipeline over ``documents``: each stage's result is written as Parquet and read again as the next one's input."""

from pyspark.sql import DataFrame, SparkSession

from wardline.llm import decontaminate, line_dedup, near_dup, packing, toxicity
from wardline.llm.common import written

STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", line_dedup.stage),
    ("minhash_near_dedup", near_dup.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("best_fit_packing", packing.stage),
]

#: SQL can express neither the learnt toxicity score nor tokenization; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
