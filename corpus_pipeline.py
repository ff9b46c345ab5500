"""The corpus pipeline: quality rules, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.common import checkpoint_dir, remove, table
from lodestar.llm.decontaminate import stage_decontaminate
from lodestar.llm.jaccard import stage_near_duplicates
from lodestar.llm.lines import stage_line_dedup
from lodestar.llm.packing import stage_packing
from lodestar.llm.quality import stage_quality


STAGES = [
    ("quality rules", stage_quality),
    ("line dedup", stage_line_dedup),
    ("n-gram Jaccard join", stage_near_duplicates),
    ("benchmark decontamination", stage_decontaminate),
    ("best-fit packing", stage_packing),
]
#: The forest, the edit join, the trie join and the packing have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing plan of what the stages leave of documents; stages are handed on through the shared folder.

    Each stage's table is removed once the next one has read it; the last one is the result.
    """
    docs = table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark).rstrip('/')}/lodestar/{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            remove(spark, f"{base}/{k - 1}")
    return docs
