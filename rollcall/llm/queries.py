"""The numbered queries, one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.alignment import align
from rollcall.llm.byte_conv import quality
from rollcall.llm.decontaminate import SQL as LEAKS_SQL
from rollcall.llm.decontaminate import find_leaks
from rollcall.llm.importance import SQL as RESAMPLE_SQL
from rollcall.llm.importance import resample
from rollcall.llm.main_text import extract
from rollcall.llm.packing import pack
from rollcall.llm.registry import query, table
from rollcall.llm.repetition import repetition
from rollcall.llm.sharding import read_shards, text_bytes, write_shards
from rollcall.llm.simhash import hexadecimal, near_groups
from rollcall.llm.token_counts import count_tokens
from rollcall.llm.token_planes import read_ids, write_ids

from rollcall.llm.toxicity import toxicity
from rollcall.llm.url_rules import judge_urls, registered_rules
from rollcall.llm.url_rules import sql as url_sql


def held_out(modulus: int, rest: int) -> Column:
    """Whether a doc_id belongs to the fold that no model learns from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == rest, F.lit(False))


@query()
def op1_token_planes(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of all documents, written as byte planes and read back."""
    return read_ids(spark, write_ids(table(spark, sf, "documents")))


@query()
def op2_main_text(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf, "pages"))


@query(url_sql())
def op3_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return judge_urls(table(spark, sf, "pages"), registered_rules())


@query(LEAKS_SQL)
def op4_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold benchmark items, with the best window of each."""
    return find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("distance")


@query()
def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Score of every document for toxicity."""
    scored = toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


@query()
def op6_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes and tokens of every document."""
    counts = count_tokens(table(spark, sf, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


@query()
def op7_repetition(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, repetition coverage and verdict of every document."""
    return repetition(table(spark, sf, "documents"))


@query()
def op8_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and component of every document."""
    groups = near_groups(table(spark, sf, "documents"))
    return groups.select("doc_id", hexadecimal(F.col("print")).alias("fingerprint"), "component_id")


@query()
def op9_packing(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    return pack(table(spark, sf, "documents"))


@query()
def op10_byte_conv(spark: SparkSession, sf: str) -> DataFrame:
    """Score of every document for quality."""
    scored = quality(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query()
def op11_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """Shard and slot of every document, from the files of 40 shuffled shards."""
    docs = table(spark, sf, "documents")
    rows = read_shards(spark, write_shards(docs, shards=40), docs.schema)
    text = F.col("record.text")
    return rows.select("record.doc_id", (text_bytes(text) + 16).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
                       F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query(RESAMPLE_SQL)
def op12_resampling(spark: SparkSession, sf: str) -> DataFrame:
    """Weight, score and rank of every document for a draw that resembles the benchmark."""
    return resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query()
def op13_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Groups and links of the tokens of two tokenizers, per document."""
    return align(table(spark, sf, "documents"))
