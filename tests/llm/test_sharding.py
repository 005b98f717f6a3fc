"""Shuffled shards: all rows once, equal shards, gapless slots, the same files for the same seed."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.llm import sharding
from rollcall.llm.queries import op11_sharding
from rollcall.llm.sharding import read_shards, running_totals, write_shards

SF = "/root/testdata/sf0.001"


def places(spark, df, **more):
    rows = read_shards(spark, write_shards(df, **more), df.schema).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for held in by.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
    sizes = [len(held) for held in by.values()] + [0] * (more.get("shards", 40) - len(by))
    assert max(sizes) - min(sizes) <= 1
    return [r for s in sorted(by) for r in sorted(by[s], key=lambda r: r.slot)]


@pytest.mark.parametrize("bucket", [1 << 25, 5000])
def test_rows_come_back_in_equal_shards(spark, docs, bucket):
    got = places(spark, docs, bucket_bytes=bucket)
    assert Counter(map(tuple, (r.record for r in got))) == Counter(map(tuple, docs.collect()))
    again = places(spark, docs.repartition(7), bucket_bytes=bucket)
    assert [r.record for r in got] == [r.record for r in again]
    other = places(spark, docs, bucket_bytes=bucket, seed=12)
    assert [r.record for r in got] != [r.record for r in other]


def test_files_hold_shards_in_slot_order(spark, docs):
    path = write_shards(docs, bucket_bytes=20_000, shards=3)
    spans = (spark.read.parquet(path).withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id())
             .orderBy("file", "at").collect())
    for a, b in zip(spans, spans[1:]):
        assert a.file != b.file or b.slot == a.slot + 1
    assert {r.file.split("shard=")[1].split("/")[0] for r in spans} == {"0", "1", "2"}


def test_the_order_is_random(spark):
    n, trials = 60, 120  # one bucket: any row is equally likely anywhere
    df = spark.createDataFrame([(i, f"t{i}") for i in range(n)], "doc_id long, text string").coalesce(1)
    first = np.zeros((trials, n), int)
    for t in range(trials):
        buckets = df.groupBy().agg(F.array_sort(F.collect_list("doc_id")).alias("a")).select(F.shuffle("a", t).alias("a"))
        first[t] = buckets.first().a
    mean = first.mean(axis=0)
    assert abs(mean - (n - 1) / 2).max() < 4.5 * np.sqrt((n * n - 1) / 12 / trials)
    got = [r.record.doc_id for r in places(spark, spark.range(4000).selectExpr("id doc_id", "concat('t', id) text"), bucket_bytes=9000)]
    assert abs(np.corrcoef(got, np.arange(4000))[0, 1]) < 0.08
    near = np.abs(np.diff(got))
    assert abs(near.mean() - 4000 / 3) < 120  # neighbours are far apart


def test_query_digests(spark, docs):
    got = {r.doc_id: r for r in op11_sharding(spark, SF).collect()}
    for r in docs.collect():
        raw = (r.text or "").encode()
        g = got[r.doc_id]
        assert (g["size"], g.text_crc32, g.law, g.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    assert len(got) == docs.count()


def test_running_totals_over_runs(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 4)
    got = running_totals(spark.createDataFrame([(b, b + 1) for b in range(19) if b != 6], "bucket int, n long")).collect()
    assert {r.bucket: r.before for r in got} == {b: sum(k + 1 for k in range(b) if k != 6) for b in range(19) if b != 6}


def test_many_equal_rows_are_parted(spark):
    rows = [(1, "the same text in every row")] * 3000 + [(i, f"text {i}") for i in range(2, 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = places(spark, df, bucket_bytes=4000, shards=7)
    assert Counter((r.record.doc_id, r.record.text) for r in got) == Counter(rows)


def test_odd_rows(spark, odd, none):
    clash = odd.withColumn("shard", F.lit("s")).withColumn("slot", F.lit("l")).withColumn("record", F.lit("r")).withColumn("bucket", F.lit("b"))
    clash = clash.withColumn("_copy", F.lit("c")).withColumn("before", F.create_map(F.lit("k"), F.lit(1)))
    for size in (1 << 25, 100):
        got = places(spark, clash, bucket_bytes=size, shards=4)
        assert Counter(str(r.record) for r in got) == Counter(map(str, clash.collect()))
    assert places(spark, none) == []
