"""SimHash, components, near duplicates and benchmark leaks against brute force."""

import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rollcall.llm import simhash
from rollcall.llm.components import components
from rollcall.llm.decontaminate import blocks_of, find_leaks, neighbours
from rollcall.llm.simhash import forest, near_groups, one_of_each, pairs_between, pairs_listed

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])


def plain_print(text, n=4):
    counts, parts = [0] * 64, shingles(text, n)
    for s in parts:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for k in range(64):
            counts[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * counts[k] > len(parts))


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("width,radius", [(1, 0), (1, 4), (1, 30), (8, 112)])
def test_bit_sliced_distances(width, radius):
    r = np.random.default_rng(width + radius)
    base = r.integers(0, 1 << 63, (40, width)).astype(np.uint64)
    rows = np.concatenate([base, base ^ (np.uint64(1) << r.integers(0, 64, (40, width)).astype(np.uint64)), base[:7]])
    want = np.bitwise_count(rows[:, None] ^ rows[None]).sum(2)
    a, b, d = pairs_between(rows, rows, radius)
    assert {(x, y): z for x, y, z in zip(a, b, d)} == {(x, y): want[x, y] for x, y in zip(*np.nonzero(want <= radius))}
    x, y = np.triu_indices(len(rows), 1)
    a, b, d = pairs_listed(rows, x, y, radius)
    assert (want[a, b] == d).all() and len(a) == (want[x, y] <= radius).sum()


def test_forest_prefers_short_links():
    a, b = forest(4, np.array([0, 0, 1, 2]), np.array([1, 2, 2, 3]), np.array([5, 1, 2, 9]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(0, 2), (1, 2), (2, 3)]


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (200, 150)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 200: 100, 150: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("block", [2048, 5])
def test_groups_of_near_fingerprints(spark, docs, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SHORT", 3)
    base = " ".join(f"w{i}" for i in range(400))
    near = [(10_000 + i, base.replace(f"w{i * 9} ", f"v{i} ")) for i in range(40)]  # one large group
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    rows = sorted(df.collect())
    prints = np.array([plain_print(r.text) for r in rows], np.uint64)
    links = [(i, int(j)) for i in range(len(rows)) for j in np.nonzero(np.bitwise_count(prints[:i] ^ prints[i]) <= 4)[0]]
    want = {r.doc_id: (f"{int(p):016x}", rows[k].doc_id) for r, p, k in zip(rows, prints, roots(len(rows), links))}
    got = near_groups(df).select("doc_id", simhash.hexadecimal(F.col("print")).alias("f"), "component_id").collect()
    assert {r.doc_id: (r.f, r.component_id) for r in got} == want


def test_groups_of_odd_rows(odd, none):
    got = {r.doc_id: r.component_id for r in near_groups(odd).collect()}
    assert got[1] == got[2] == got[3] == got[11] == 1 and got[5] == got[6] == 5 and len(got) == 13
    assert near_groups(none).count() == 0


def test_one_of_each_keeps_the_least_of_every_group(spark, docs):
    base = " ".join(f"w{i}" for i in range(400))
    near = [(10_000 + i, base.replace(f"w{i * 9} ", f"v{i} ")) for i in range(40)]
    df = docs.unionByName(spark.createDataFrame(near, "doc_id long, text string"), allowMissingColumns=True)
    rows = sorted((r.doc_id, r.text) for r in df.collect())
    prints = np.array([plain_print(t) for _, t in rows], np.uint64)
    links = [(i, int(j)) for i in range(len(rows)) for j in np.nonzero(np.bitwise_count(prints[:i] ^ prints[i]) <= 4)[0]]
    want = {rows[k][0] for k in roots(len(rows), links)}
    kept = one_of_each(df)
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == df.columns


def test_one_of_each_of_odd_rows(odd, none):
    rows = {(r.doc_id, r.text) for r in odd.filter("doc_id is null or doc_id <> 7").collect()}
    kept = one_of_each(odd)
    assert kept.columns == odd.columns
    prints = {d: plain_print(t) for d, t in rows}
    assert all((prints[a] ^ prints[b]).bit_count() > 4 for a in (1, 4, 5, 8, 9, 10, 12, None) for b in (1, 4, 5, 8, 9, 10, 12) if a != b)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 4, 5, 7, 8, 9, 10, 12, None]))
    assert one_of_each(none).count() == 0


ITEM = "The quick brown fox jumps over the lazy dog near a calm river bank at dawn today"


def test_leaks(spark, odd, none):
    filler = " ".join(f"filler{i}" for i in range(60))
    rows = [(1, f"{filler} {ITEM} {filler}"), (2, f"{filler} {ITEM.upper()}!!%%%"), (3, ITEM), (4, filler),
            (5, f"{filler} The quick brown fox jumps over {filler}"), (6, None), (7, ""), (None, ITEM), (3, ITEM),
            (8, " ".join([ITEM] * 50)), (9, f"{filler} {ITEM.replace('today', 'soon')} {filler}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit(1)).withColumn("item_id", F.lit("x"))
    items = spark.createDataFrame([(1, ITEM), (2, "not there"), (3, None), (4, "")], "item_id long, text string").withColumn("size", F.lit(2))
    got = {r.doc_id: r for r in find_leaks(docs, items).collect()}
    assert set(got) == {1, 2, 3, 8, 9, None} and len(got) == 6
    assert got[1].start == 60 and got[1].similarity == 1 and got[1].n_words == len(ITEM.split()) and got[8].start == 0
    assert 0.8 <= got[9].similarity < 1
    assert find_leaks(none, items).count() == 0 and find_leaks(docs, items.filter("false")).count() == 0
    assert find_leaks(odd, items).count() == 0


def test_leaks_at_the_bound(spark):
    items, docs = [], []
    for i in range(1600):  # edits that leave 8 of 10, 40 of 50 shingles
        n, at = ((13, 12), (49, 20))[i % 2]
        words = [f"i{i}w{k}" for k in range(n)]
        items.append((i, " ".join(words)))
        words[at] = "edited"
        docs.append((i, " ".join([f"before{i}"] * 3 + words + [f"after{i}"] * 9)))
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id, r.start, r.similarity) for r in got.collect()) == [(i, i, 3, 0.8) for i in range(1600)]


def test_items_shorter_than_a_shingle(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "x one, TWO y two"), (3, "two one"), (4, None), (2, "x one, TWO y two")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two"), (2, "Two"), (3, "one two three four five"), (4, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.n_words, r.similarity, r.distance) for r in find_leaks(docs, items).collect()}
    assert got == {(1, 1): (0, 2, 1.0, 0), (2, 1): (1, 2, 1.0, 0), (1, 2): (1, 1, 1.0, 0), (2, 2): (2, 1, 1.0, 0), (3, 2): (0, 1, 1.0, 0)}


def test_every_block_index_finds_its_radius(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        a = int(rng.integers(0, 1 << 63))
        flips = rng.choice(64, size=int(rng.integers(0, 23)), replace=False)
        b = a ^ sum(1 << int(k) for k in flips)
        rows.append((i, a - (a >> 63 << 64), b - (b >> 63 << 64)))
    df = spark.createDataFrame(rows, "i long, a long, b long")
    kinds = df.select(F.col("i").alias("kind"), F.lit(1).alias("size"), F.col("a").alias("item_print"))
    probes = df.select("i", F.explode(blocks_of(F.col("b"))).alias("p")).select("i", "p.block", "p.value")
    met = probes.join(neighbours(kinds, 22), ["block", "value"]).filter("i = kind").select("i").distinct()
    assert met.count() == 400


def test_leaks_from_the_bound_up(spark):
    """Edited windows of similarity 0.80 to 0.83, weighted, against the shingles' own counts."""
    rng, items, docs, want = np.random.default_rng(6), [], [], []
    for i in range(1200):
        n = int(rng.integers(24, 90))
        words = [f"i{i}w{k % (n - 6)}" for k in range(n)]  # some shingles twice
        edited = list(words)
        for at in rng.choice(n, size=int(rng.integers(1, 3)), replace=False):
            edited[at] = f"e{at}"
        grams = lambda w: Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        a, b = grams(words), grams(edited)
        similarity = sum((a & b).values()) / sum((a | b).values())
        items.append((i, " ".join(words)))
        docs.append((i, " ".join([f"before{i}"] * 9 + edited + [f"after{i}"] * 9)))
        if similarity >= 0.8:
            want.append((i, round(similarity, 6)))
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {r.doc_id: r.similarity for r in got.collect() if r.doc_id == r.item_id}
    assert all(found.get(i, 0) >= s - 1e-6 for i, s in want) and sum(0.8 <= s <= 0.83 for _, s in want) > 60
