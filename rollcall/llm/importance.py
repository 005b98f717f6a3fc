"""Importance resampling of documents towards a target text.

Features are hashed runs of words. The texts of a batch are joined with a
sentinel between them; one pass of a regular expression finds all words and
sentinels, ``searchsorted`` on the sentinels' places gives every word its
document, and runs that would cross into another document are masked before the
features are counted by ``bincount``.

The counts of all buckets (a fixed number) give every bucket a gain, the mean
gain of a document is its weight, and a Gumbel number by a hash of its doc_id
makes the highest scores a random draw without replacement.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.session import shared_table

# What is no word, once A-Z are lower-cased. All bytes of a character beyond ASCII are word bytes.
_FIND = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|\x00")
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_SENTINEL = b"\0"
_SENTINEL_CRC = crc32(_SENTINEL)
#: Lower-cases A-Z, and makes room for the sentinel: zero bytes of a text part words just as blanks do.
_LOWER = bytes(32 if b == 0 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes that are joined at a time, about.
BATCH = 1 << 20


def _stretches(texts: Iterable[str | None], runs: int) -> Iterator[tuple[int, bytes, int]]:
    """(number of the text, bytes, words at the front that were seen before).

    A text longer than a batch comes in stretches, each with the last words of
    the one before, for the runs that reach across.
    """
    for number, text in enumerate(texts):
        data = (text or "").encode().translate(_LOWER)
        at, lead = 0, []
        while True:
            found = _BREAK.search(data, at + BATCH) if len(data) - at > BATCH else None
            part = data[at:found.start() if found else None]
            yield number, b" ".join([*lead, part]), len(lead)
            if not found:
                break
            if runs > 1:
                lead = [*lead, *_FIND.findall(part)][1 - runs:]
            at = found.start()


def _batches(texts: Iterable[str | None], runs: int) -> Iterator[tuple[list[int], list[bytes], list[int]]]:
    batch, size = ([], [], []), 0
    for stretch in _stretches(texts, runs):
        for held, value in zip(batch, stretch):
            held.append(value)
        size += len(stretch[1])
        if size >= BATCH:
            yield batch
            batch, size = ([], [], []), 0
    if batch[0]:
        yield batch


def features(texts: Iterable[str | None], runs: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the text, bucket) of every run of 1 to ``runs`` words, and the texts' numbers once per word, batch by batch."""
    for numbers, parts, seen in _batches(texts, runs):
        words = _FIND.findall(_SENTINEL.join(parts))
        crc = np.fromiter(map(crc32, words), np.int64, len(words))
        ends = np.array([i for i in np.flatnonzero(crc == _SENTINEL_CRC) if words[i] == _SENTINEL], np.int64)
        part = np.searchsorted(ends, np.arange(len(words)))  # a sentinel belongs to the text that it ends
        real = np.ones(len(words), bool)
        real[ends] = False
        new = np.arange(len(words)) - np.r_[0, ends + 1][part] >= np.array(seen)[part]
        numbers = np.array(numbers)
        owners, hashes, chained = [], [], crc
        for run in range(1, runs + 1):
            if run > 1:
                chained = np.fromiter(map(crc32, (b" " + w for w in words[run - 1:]), chained[:-1].tolist()), np.int64, max(0, len(words) - run + 1))
            last = len(words) - run + 1
            if last <= 0:
                break
            ok = (part[:last] == part[run - 1:]) & real[:last] & real[run - 1:] & new[run - 1:]
            owners.append(numbers[part[:last][ok]])
            hashes.append(chained[ok] % buckets)
        whole = numbers[part[real & new]]
        yield (np.concatenate(owners), np.concatenate(hashes), whole) if owners else (whole, whole, whole)


def _totals(runs: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, hashes, _ in features(batch.column("text").to_pylist(), runs, buckets):
                total += np.bincount(hashes, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, runs: int, buckets: int) -> np.ndarray:
    """How many features of all ``texts`` (text) fall into each bucket."""
    seen = texts.select(F.col("text").cast("string")).mapInArrow(_totals(runs, buckets), "bucket long, n long")
    held = seen.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # ``buckets`` rows at the most
    out = np.zeros(buckets, np.int64)
    out[held["bucket"].to_numpy(np.int64)] = held["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of smoothed frequencies in the target and the source, rounded down."""
    s, t, n = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _weights(runs: int, buckets: int, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = table.value.astype(float)
        for batch in batches:
            n, words, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for owners, hashes, whole in features(batch.column("text").to_pylist(), runs, buckets):
                n += np.bincount(owners, minlength=len(n))
                words += np.bincount(whole, minlength=len(n))
                total += np.bincount(owners, weights=gain[hashes], minlength=len(n)).astype(np.int64)  # whole numbers, exact
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            cols = [batch.column("doc_id"), batch.column("version"), *(pa.array(c, pa.int64()) for c in (n, words, weight))]
            yield pa.record_batch(cols, ["doc_id", "version", "n_features", "n_words", "weight"])

    return run


def numbered(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with ``place``, their number from 1 in that order, which must tell all rows apart.

    Ranges of the order are sorted each for itself; the numbers of rows of all
    ranges, of which there are as many as shuffle partitions, give the offsets.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = shared_table(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                         .withColumn("part", F.spark_partition_id()).withColumn("inside", inside))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return (dealt.join(F.broadcast(before), "part").withColumn("place", F.col("before") + F.col("inside") + 1)
            .drop("part", "before", "inside"))


def resample(docs: DataFrame, target: DataFrame, runs: int = 1, buckets: int = 10_000, seed: int = 2024,
             least_words: int = 20, percent: int = 10) -> DataFrame:
    """doc_id, n_features, weight, score, rank (all long) of every row of ``docs`` (doc_id, text).

    ``target`` (text) holds what the drawn documents should look like. A text
    that is null or has no word has no features and the weight 0; words at the
    end of very long texts count like others. Rows of equal doc_id have the same
    random number; a null doc_id takes that of an empty one. Repeated rows are
    scored and drawn each for itself. Of documents with ``least_words`` the
    ``percent`` of highest score get ranks from 1, ties to the smaller doc_id,
    null last; all others have none. Other columns are ignored; an empty table
    gives an empty one, and an empty target the same gain rule with counts of 0.
    """
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    gain = sc.broadcast(gains(bucket_counts(docs, runs, buckets), bucket_counts(target, runs, buckets)))
    found = docs.withColumn("version", F.xxhash64("text")).mapInArrow(
        _weights(runs, buckets, gain), "doc_id long, version long, n_features long, n_words long, weight long")
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = shared_table(found.withColumn("score", (F.col("weight") + gumbel).cast("long")).withColumn("row", F.monotonically_increasing_id()))
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    placed = numbered(able, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("version"), F.asc("row"))
    rank = F.when(F.col("place") <= drawn, F.col("place")).cast("long")
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    cols = ["doc_id", "n_features", "weight", "score", "rank"]
    return placed.withColumn("rank", rank).select(*cols).unionByName(rest.select(*cols))


#: crc32 by its table of 256 entries, made by its rule; then the contract's sums.
SQL = r"""
with recursive table_of(i, c, k) as (
  select i, i, 0 from range(256) r(i)
  union all
  select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from table_of where k < 8),
crc as (select list(c order by i) as t from table_of where k = 8),
w as (
  select 'd' as side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from documents
  union all
  select 't', null, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) from benchmark),
spelled as (
  select word, list_transform(range(0, length(hex(encode(word))) // 2),
    lambda p: ('0x' || substr(hex(encode(word)), 2 * p + 1, 2))::bigint) as bytes from (select distinct word from w)),
hashed as (
  select word, xor(list_reduce(list_prepend(4294967295::bigint, bytes),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket from spelled, crc),
f as (select side, doc_id, bucket from w join hashed using (word)),
n as (select bucket, count(*) filter (side = 'd') as s, count(*) filter (side = 't') as t from f group by bucket),
g as (
  select bucket, floor(1000 * ln((t + 1)::double * ((select sum(s) from n) + 10000)::double
    / ((s + 1)::double * ((select sum(t) from n) + 10000)::double)))::bigint as gain from n),
d as (
  select doc_id, count(bucket) as n_features, case when count(bucket) = 0 then 0 else floor(sum(gain) / count(bucket)) end::bigint as weight
  from documents left join (select doc_id, bucket, gain from f join g using (bucket) where side = 'd') using (doc_id) group by doc_id),
e as (
  select *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5)::double / 4294967296.0)))::bigint as score from d),
r as (select *, n_features >= 20 as able, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place,
  count(*) over (partition by n_features >= 20) as total from e)
select doc_id, n_features, weight, score, case when able and place <= total * 10 // 100 then place end as rank from r"""
