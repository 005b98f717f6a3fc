"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.llm import importance
from rollcall.llm.importance import features, numbered, resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_features(text, runs, buckets):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i:i + n]) for n in range(1, runs + 1) for i in range(len(words) - n + 1)]
    return [zlib.crc32(g.encode()) % buckets for g in grams], len(words)


def plain(rows, target, runs, buckets, seed=2024, least=20, percent=10):
    s, t = [0] * buckets, [0] * buckets
    made = [(d, *plain_features(x, runs, buckets)) for d, x in rows]
    for _, f, _ in made:
        for b in f:
            s[b] += 1
    for x in target:
        for b in plain_features(x, runs, buckets)[0]:
            t[b] += 1
    big_s, big_t, out = sum(s), sum(t), []
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    for d, f, words in made:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = len(able) * percent // 100
    return sorted([str((*r[:4], i + 1 if i < drawn else None)) for i, r in enumerate(able)] + [str((*r[:4], None)) for r in out if r[4] < least])


def got(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


@pytest.mark.parametrize("runs,batch", [(1, 1 << 20), (2, 1 << 20), (3, 40), (1, 7), (3, 1)])
def test_features_of_batches_and_stretches(monkeypatch, runs, batch):
    monkeypatch.setattr(importance, "BATCH", batch)
    texts = ["One two three", None, "", "a\0b \0 c\x00d", "ends", "x" * 90, "Ähre Ñ 1two-three four" * 9, "!!", "one two"]
    found = [[] for _ in texts]
    words = [0] * len(texts)
    for owners, hashes, whole in features(texts, runs, 997):
        for o, h in zip(owners.tolist(), hashes.tolist()):
            found[o].append(h)
        for o in whole.tolist():
            words[o] += 1
    want = [plain_features(t, runs, 997) for t in texts]
    assert [sorted(f) for f in found] == [sorted(f) for f, _ in want] and words == [n for _, n in want]


@pytest.mark.parametrize("runs,buckets", [(1, 10_000), (2, 500)])
def test_against_plain_version(spark, docs, table, runs, buckets):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    target = [r.text for r in table("benchmark").collect()]
    assert got(resample(docs, table("benchmark"), runs, buckets)) == plain(rows, target, runs, buckets)


def test_odd_rows_and_ties(spark, odd, none, table):
    many = odd.unionByName(odd).unionByName(odd.filter("doc_id = 7 or doc_id is null")).withColumn("place", F.lit(1)).withColumn("version", F.lit(1))
    rows = [(r.doc_id, r.text) for r in many.collect()]
    target = [r.text for r in table("benchmark").collect()]
    assert got(resample(many, table("benchmark"), least_words=1, percent=50)) == plain(rows, target, 1, 10_000, least=1, percent=50)
    assert resample(none, table("benchmark")).count() == 0
    empty = resample(many, none)
    assert got(empty) == plain(rows, [], 1, 10_000)


def test_numbers_of_hot_ties(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 11).alias("score"), "id")
    rows = sorted(numbered(df, F.desc("score"), F.asc("id")).collect(), key=lambda r: r.place)
    assert [r.place for r in rows] == list(range(1, 20_001))
    assert [(r.score, r.id) for r in rows] == sorted(((r.score, r.id) for r in rows), key=lambda x: (-x[0], x[1]))


def test_the_draw_prefers_what_resembles_the_target(spark):
    rows = [(i, " ".join((["target", "words"] if i % 10 == 0 else ["other", "filler"]) * 15)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([("target words " * 40,)], "text string")
    drawn = [r.doc_id for r in resample(df, target).filter("rank is not null").collect()]
    assert len(drawn) == 200 and np.mean([d % 10 == 0 for d in drawn]) > 0.85
