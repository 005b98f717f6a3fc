"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes what the one before kept. Between stages the documents are a
table in the shared folder, so a lost executor repeats one stage at the most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.decontaminate import find_leaks
from rollcall.llm.names import unused
from rollcall.llm.packing import pack
from rollcall.llm.repetition import with_verdict
from rollcall.llm.simhash import one_of_each
from rollcall.llm.toxicity import with_score
from rollcall.session import shared_table, ship


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score for toxicity is under one half."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = unused(docs, "_toxicity")
    return with_score(docs, labels, score).filter(F.col(score) < 0.5).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail the base rules nor repeat themselves."""
    ship(spark)
    rule = unused(docs, "_rule_")
    return with_verdict(docs, rule).filter(f"{rule}kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (four-word shingles, 4 bits), that of the smallest doc_id."""
    ship(spark)
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that is a benchmark item."""
    leaks = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaked = unused(docs, "_leaked")
    ids = leaks.select(F.col("doc_id").alias(leaked)).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col(leaked)), "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 1024 tokens."""
    ship(spark)
    return pack(docs)


STAGES = [("toxicity", toxicity), ("quality rules", quality_rules), ("near duplicates", near_duplicates),
          ("decontamination", decontamination), ("packing", packing)]

#: Trees, rolling hashes, fingerprints and tokens are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
