"""Corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
reread as the next stage's docs. All but the last return the columns of documents.
Mixing may return a document more than once (whole copies), so later rows repeat ids.

Null texts and texts without words fail the quality rules; rows with a null id pass every
stage as documents of their own (one of each text after the join); very long texts are
taken whole; an empty table gives an empty table; columns beside those of documents ride
along up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.best_fit_packing import stage_packing
from tallyloom.llm.jaccard_join import stage_near_duplicates
from tallyloom.llm.pii import stage_pii
from tallyloom.llm.quality_rules import stage_quality
from tallyloom.llm.source_mixing import stage_mixing
from tallyloom.llm.store import materialize

STAGES = [
    ("quality rules", stage_quality),
    ("n-gram Jaccard join", stage_near_duplicates),
    ("personal data", stage_pii),
    ("mixing sources", stage_mixing),
    ("best-fit packing", stage_packing),
]

#: byte-pair ids and similarity classes have no SQL form; tests hold it against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs
