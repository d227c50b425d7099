"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark decontamination, tokens.

Each stage is ``(name, function)``; a function takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` applies
them to ``documents``, writing each result as Parquet to the shared folder and rereading it for the next stage; all
other tables that the stages write there are deleted as soon as nothing reads them.

Every stage takes null texts (they have no words; they stay null), empty and blank texts, texts of any length,
repeated rows and ids, null ids, and empty tables. Rows without an id are never near duplicates of others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import bpe, decontaminate, jaccard_join, suffix_dedup, toxicity
from weftgraph.llm.common import drop_tables, read, table, tables

STAGES = [
    ("toxicity", toxicity.stage),
    ("near_duplicates", jaccard_join.stage),
    ("repeated_passages", suffix_dedup.stage),
    ("decontamination", decontaminate.stage),
    ("tokens", bpe.stage),
]

#: SQL can express neither the classifier nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    older = tables()
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_tables(spark, docs, older=older)  # what the stage and its predecessor have written
    return docs
