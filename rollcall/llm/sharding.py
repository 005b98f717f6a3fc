"""Shuffled shards by an external shuffle in two passes, in DataFrame functions alone.

The first pass scatters the rows by a seeded hash over buckets of a size that
fits into memory; Spark's exchange keeps them on disk. The second takes one
bucket per task, shuffles it (``shuffle`` is a seeded Fisher-Yates shuffle) and
writes it where it belongs in the order of all buckets. Shards are equal cuts of
that order, so their numbers of rows are at most one apart.

A bucket is put in order before it is shuffled and its task's number is the
bucket's, so a task that runs again writes the same rows in the same places.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, MapType, StructType, VariantType

from rollcall.llm.names import unused
from rollcall.session import shared_folder, shared_table

#: Bytes of text in a bucket, about; buckets of more than ``OVERFULL`` times that are scattered anew.
BUCKET_BYTES, OVERFULL = 32 << 20, 4
#: Buckets whose sizes are added up in one task.
RUN = 1024


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; none if it is null."""
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long")


def running_totals(counts: DataFrame) -> DataFrame:
    """bucket and ``before``, the rows of all smaller buckets, from (bucket, n)."""
    counts = counts.withColumn("run", F.floor(F.col("bucket") / RUN))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy("run").agg(F.sum("n").alias("n"))
    runs = runs.select("run", F.coalesce(F.sum("n").over(earlier.orderBy("run")), F.lit(0)).alias("base"))
    inside = F.sum("n").over(earlier.partitionBy("run").orderBy("bucket"))
    return counts.withColumn("inside", F.coalesce(inside, F.lit(0))).join(runs, "run").select(
        "bucket", (F.col("base") + F.col("inside")).alias("before"))


def write_shards(docs: DataFrame, path: str | None = None, shards: int = 40, seed: int = 11,
                 bucket_bytes: int = BUCKET_BYTES) -> str:
    """Write all rows of ``docs`` (doc_id, text, any more) in random order; returns the path.

    Files lie in one folder per shard and hold slot (long, gapless from 0 in a
    shard) and record (a struct of all columns of ``docs``, so no name clashes).
    Numbers of rows differ by one at most between shards. The order depends on
    ``seed`` and the rows alone, not on how the table is split.

    A null or empty text is a row like others, and so is a null doc_id. Equal
    rows are kept, each for itself; only where these overfill a bucket is a
    numbered copy of the table written, and the numbers part them (the order
    then depends on the table's split too). A text longer than a bucket is a
    bucket's row all the same. An empty table gives no file.
    """
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    columns, more = docs.columns, []
    size = text_bytes(F.col("text")) + 16
    n, total, longest = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    buckets = max(1, -(-total // bucket_bytes))
    place = lambda: F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text", *more), F.lit(buckets)).cast("int")
    counted = lambda: docs.groupBy(place().alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
    counts = shared_table(counted())
    if (counts.agg(F.max("bytes")).first()[0] or 0) > OVERFULL * bucket_bytes + longest:
        more = [unused(docs, "_copy")]
        docs = shared_table(docs.withColumn(more[0], F.monotonically_increasing_id()))
        counts = shared_table(counted())

    hashed = [F.col(f.name) for f in docs.schema if not isinstance(f.dataType, (MapType, VariantType))]
    record = F.struct(*columns)
    rows = docs.select(place().alias("bucket"), F.xxhash64(F.lit(seed + 1), "doc_id", "text", *more).alias("first"),
                       F.xxhash64(*hashed).alias("second"), record.alias("record"), F.lit(None).cast("long").alias("before"))
    none = F.lit(None).cast("long")
    totals = running_totals(counts).select("bucket", none.alias("first"), none.alias("second"),
                                           F.lit(None).cast(StructType(docs.select(*columns).schema.fields)).alias("record"), "before")
    # the totals travel with the rows, so there is neither a join nor a broadcast
    scattered = rows.unionByName(totals).repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "first", "second")
    held = scattered.groupBy("bucket").agg(F.collect_list("record").alias("records"), F.max("before").alias("before"))
    mixed = held.select("before", F.shuffle("records", seed).alias("records")).select("before", F.posexplode("records").alias("at", "record"))
    shard = F.expr(f"((before + at) * {shards}) div {max(n, 1)}")
    out = (mixed.withColumn("shard", shard.cast("int"))
           .withColumn("slot", F.expr(f"before + at - (shard * {n}L + {shards - 1}) div {shards}")))
    out.select("shard", "slot", "record").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    if path.startswith(shared_folder(spark)):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def read_shards(spark: SparkSession, path: str, records: StructType) -> DataFrame:
    """shard, slot and record (of the schema ``records``) from the files."""
    schema = StructType().add("slot", LongType()).add("record", records).add("shard", IntegerType())
    return spark.read.schema(schema).parquet(path)
