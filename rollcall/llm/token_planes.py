"""Token ids in files of shuffled planes.

A file row is a segment: whole documents, ids of a fixed-size block after the
other. Each block is transposed, so that the first bytes (or bits) of all its
ids lie together, then the second ones, and each plane is compressed with
zstandard. The row's index holds the ids of every block and the length of
every plane, so a reader can find and decode any block alone.

The container of the rows is Parquet, uncompressed, written by Spark: commits
are atomic, a lost task is written again, and any store that Spark knows will do.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.pieces import encoder
from rollcall.session import shared_folder

#: Ids of a block and, about, of a segment.
BLOCK, SEGMENT = 1 << 16, 1 << 18
SCHEMA = ("shard long, segment long, first long, n_ids long, bits boolean, doc_ids array<long>, lengths array<long>, "
          "block_ids array<int>, plane_bytes array<int>, payload binary")
_TYPES = [pa.int64()] * 4 + [pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The 4 byte planes or 32 bit planes of a block of ids."""
    by = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        by = np.unpackbits(by, axis=1, bitorder="little")
        return [np.packbits(by[:, k], bitorder="little").tobytes() for k in range(32)]
    return [by[:, k].tobytes() for k in range(4)]


def ids_of(parts: list[bytes], n: int, bits: bool) -> np.ndarray:
    """The block that ``planes`` took apart."""
    if bits:
        by = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in parts], axis=1)
        return np.packbits(by, axis=1, bitorder="little").reshape(-1).view("<u4")
    return np.stack([np.frombuffer(p, np.uint8) for p in parts], axis=1).reshape(-1).view("<u4")


def pack_blocks(ids: np.ndarray, bits: bool, level: int = 1) -> tuple[list[int], list[int], bytes]:
    """(ids of each block, bytes of each plane, all planes)."""
    import zstandard

    z = zstandard.ZstdCompressor(level=level)
    blocks = [ids[i:i + BLOCK] for i in range(0, len(ids), BLOCK)]
    made = [z.compress(p) for b in blocks for p in planes(b, bits)]
    return [len(b) for b in blocks], [len(m) for m in made], b"".join(made)


def unpack_blocks(block_ids: list[int], plane_bytes: list[int], payload: bytes, bits: bool) -> np.ndarray:
    import zstandard

    z, width, at, out = zstandard.ZstdDecompressor(), 32 if bits else 4, 0, []
    for i, n in enumerate(block_ids):
        parts = []
        for size in plane_bytes[i * width:(i + 1) * width]:
            parts.append(z.decompress(payload[at:at + size]))
            at += size
        out.append(ids_of(parts, n, bits))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def _encode(vocabulary: str, end_id: int, bits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, enc, end = TaskContext.get().partitionId(), encoder(vocabulary), end_id.to_bytes(4, "little")
        segment, first, docs, lengths, held = 0, 0, [], [], []

        def out():
            ids = np.frombuffer(b"".join(held), "<u4")
            row = (shard, segment, first, len(ids), bits, docs, lengths, *pack_blocks(ids, bits))
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, _TYPES)], _NAMES)

        n = 0
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.ids(texts)):
                docs.append(doc)
                lengths.append(len(ids) // 4 + 1)
                held += (ids, end)
                n += lengths[-1]
                if n >= SEGMENT:
                    yield out()
                    segment, first, docs, lengths, held, n = segment + 1, first + n, [], [], [], 0
        if docs:
            yield out()

    return run


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ids = unpack_blocks(r["block_ids"], r["plane_bytes"], r["payload"], r["bits"])
            ends = np.cumsum(r["lengths"])
            starts = ends - r["lengths"]
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
            n = len(ends)
            yield pa.record_batch(
                [pa.array([r["shard"]] * n, pa.int64()), pa.array(r["doc_ids"], pa.int64()), pa.array(r["first"] + starts, pa.int64()),
                 pa.array(r["lengths"], pa.int64()), pa.array(crc, pa.int64())],
                ["shard", "doc_id", "start", "n_tokens", "ids_crc32"])


def write_ids(docs: DataFrame, path: str | None = None, vocabulary: str = "word_bpe_49k.json", end_id: int = 1,
              bits: bool = False) -> str:
    """Encode ``docs`` (doc_id, text) and write segments in ascending doc_id order.

    A shard is a range of doc_ids. Null text is empty, so each document has at
    least its end id; null doc_ids come first, repeated rows are written each
    for itself, and other columns are ignored. Returns the path (of its own in
    the shared folder, if none is given).
    """
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/planes-{uuid.uuid4().hex}"
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    shards = max(1, docs.rdd.getNumPartitions())
    ordered = docs.repartitionByRange(shards, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"))
    ordered.mapInArrow(_encode(vocabulary, end_id, bits), SCHEMA).write.option("compression", "uncompressed").parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if shared_folder(spark) in path:
        target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, decoded from the files."""
    files = spark.read.schema(SCHEMA).parquet(path)
    docs = files.mapInArrow(_decode, "shard long, doc_id long, start long, n_tokens long, ids_crc32 long")
    # one row per shard, a number that write_ids sets and no document adds to
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n_ids")).orderBy("shard").toPandas()
    before = shards["n_ids"].cumsum() - shards["n_ids"]
    base = spark.createDataFrame(list(zip(shards["shard"].tolist(), before.tolist())), "shard long, before long")
    return (docs.join(F.broadcast(base), "shard")
            .select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"))


def decode(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids of every document, for readers that want the ids themselves."""
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack_blocks(r["block_ids"], r["plane_bytes"], r["payload"], r["bits"])
                parts = np.split(ids.astype(np.int64), np.cumsum(r["lengths"])[:-1])
                yield pa.record_batch([pa.array(r["doc_ids"], pa.int64()), pa.array([p.tolist() for p in parts], pa.list_(pa.int64()))],
                                      ["doc_id", "ids"])

    return spark.read.schema(SCHEMA).parquet(path).mapInArrow(run, "doc_id long, ids array<long>")
