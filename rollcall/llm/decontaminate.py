"""Benchmark decontamination, in DataFrame functions alone.

A window is as long as a benchmark item and starts at a shingle that an item of
that length holds: moving a window on to its first such shingle never lowers
its similarity, so no other start is needed. Windows that hold too few of the
items' shingles to reach the similarity are left out; equal windows count once
however many documents bear them.

Windows and items of one length meet by their SimHash fingerprints, through a
multi-index: 64 bits are cut into blocks, and two fingerprints within the radius
have a block in which they differ by no more than the radius over the number of
blocks. The items' side lists all such neighbours of each of its blocks, so an
equal block is enough. Exact similarity of weighted shingles then decides.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.session import shared_table

#: Shingles of the benchmark up to which they, and rows of its index up to which that, are broadcast.
BROADCAST_SHINGLES = 1_000_000
#: Bits by which fingerprints may differ. Pairs of similarity 0.8 differ by 9 bits, give or take 3.
RADIUS = 22
# Widths of the blocks of a fingerprint.
BLOCKS = (11, 11, 11, 11, 10, 10)


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, not once per element."""
    return F.transform(F.array(value), body)[0]


def shingles(text: Column, size: int) -> Column:
    """Hashes of the runs of ``size`` words (letters and digits, lower-cased)."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size)))
    return _bound(words, lambda w: F.when(F.size(w) >= size, runs(w)).otherwise(F.array().cast("array<bigint>")))


def simhash(hashes: Column) -> Column:
    """64 bits; one is set if more than half of the hashes have it."""
    def bit(h: Column, k: Column) -> Column:
        count = F.aggregate(h, F.lit(0).cast("bigint"), lambda c, x: c + F.call_function("shiftrightunsigned", x, k).bitwiseAND(F.lit(1).cast("bigint")))
        return F.when(2 * count > F.size(h), F.call_function("shiftleft", F.lit(1).cast("bigint"), k)).otherwise(F.lit(0).cast("bigint"))

    return _bound(hashes, lambda h: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda acc, k: acc.bitwiseOR(bit(h, k))))


def overlap(a: Column, b: Column) -> Column:
    """Sum of the smaller weight of every shingle; a weight is its number of occurrences."""
    times = lambda h, v: F.size(F.filter(h, lambda x: x == v))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, v: n + F.least(times(a, v), times(b, v)))


def blocks_of(print_: Column) -> Column:
    """Array of (block, bits, value), the blocks of a fingerprint."""
    at, out = 0, []
    for n, bits in enumerate(BLOCKS):
        value = F.call_function("shiftrightunsigned", print_, F.lit(at)).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
        out.append(F.struct(F.lit(n).alias("block"), F.lit(bits).alias("bits"), value.alias("value")))
        at += bits
    return F.array(*out)


def neighbours(kinds: DataFrame, radius: int) -> DataFrame:
    """kind, size, block, value: every value of a block within its share of the radius of the kind's own."""
    few = radius // len(BLOCKS)
    widths = sorted(set(BLOCKS))
    masks = kinds.sparkSession.range(1 << widths[-1]).select(
        F.col("id").cast("int").alias("mask"), F.explode(F.array(*[F.lit(b) for b in widths])).alias("bits"))
    masks = masks.filter((F.bit_count("mask") <= few) & (F.col("mask") < F.call_function("shiftleft", F.lit(1), F.col("bits"))))
    own = kinds.select("kind", "size", F.explode(blocks_of(F.col("item_print"))).alias("b")).select("kind", "size", "b.*")
    return own.join(F.broadcast(masks), "bits").select("kind", "size", "block", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))


def short_leaks(docs: DataFrame, items: DataFrame, words: int) -> DataFrame:
    """Leaks of the items of exactly ``words`` words: the same words in a row, first place."""
    wanted = items.select("item_id", F.explode(shingles(F.col("text"), words)).alias("hash"))
    places = docs.select("doc_id", F.posexplode(shingles(F.col("text"), words)).alias("start", "hash"))
    return places.join(wanted, "hash").groupBy("doc_id", "item_id").agg(F.min("start").cast("long").alias("start")).select(
        "doc_id", "item_id", "start", F.lit(words).cast("long").alias("n_words"), F.lit(1.0).alias("similarity"), F.lit(0).cast("long").alias("distance"))


def find_leaks(docs: DataFrame, items: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, start, n_words, similarity, distance: the best window of each item in each document.

    ``docs`` (doc_id, text) against ``items`` (item_id, text). Words are runs of
    letters and digits, lower-cased; a window has as many as the item, or fewer
    at the end of a document; ties go to the first start. A pair is found if the
    fingerprints differ by ``radius`` bits of 64 at most (distance) and the
    weighted Jaccard similarity of the shingles is at least ``similarity``. An
    item of fewer words than a shingle is one shingle of all its words, and is
    found where these stand in a row. Null and empty texts never match; equal
    rows of ``docs`` are one, and long texts are searched whole; a null doc_id
    or item_id is kept; other columns are ignored; an empty table on either side
    gives an empty result.
    """
    m = shingle - 1
    words = F.size(F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), ""))
    counted = items.select("item_id", "text", words.alias("_words"))
    lengths = [r[0] for r in counted.filter(F.col("_words").between(1, m)).select("_words").distinct().collect()]  # ``m`` at the most
    short = [short_leaks(docs, counted.filter(F.col("_words") == n), n) for n in sorted(lengths)]
    known = (items.select("item_id", shingles(F.col("text"), shingle).alias("hashes")).filter(F.size("hashes") > 0).distinct()
             .withColumn("size", F.size("hashes")).withColumn("kind", F.xxhash64("size", "hashes")))
    known = shared_table(known)
    wanted = known.select(F.explode("hashes").alias("hash"), "size").groupBy("hash").agg(F.collect_set("size").alias("sizes"))
    small = known.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] <= BROADCAST_SHINGLES
    wanted = F.broadcast(wanted) if small else wanted

    need = F.ceil(F.lit(similarity) * F.col("size") - 1e-9).cast("int")
    kinds = known.groupBy("kind", "size").agg(F.first("hashes").alias("item_hashes"))
    kinds = shared_table(kinds.withColumn("item_print", simhash(F.col("item_hashes"))))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("version"))
    places = texts.select("doc_id", "version", F.posexplode(shingles(F.col("text"), shingle)).alias("start", "hash"))
    hits = places.join(wanted, "hash").select("doc_id", "version", "start", F.explode("sizes").alias("size"))
    # the need-th hit from a start on must lie within the window
    full = lambda at, i: F.get(at, i + F.col("need") - 1) - F.get(at, i) < F.col("size")
    starts = (hits.groupBy("doc_id", "version", "size").agg(F.array_sort(F.collect_set("start")).alias("at"))
              .withColumn("need", need).filter(F.size("at") >= F.col("need"))
              .withColumn("at", F.filter("at", lambda x, i: F.coalesce(full(F.col("at"), i), F.lit(False))))
              .filter(F.size("at") > 0))
    listed = (starts.groupBy("doc_id", "version").agg(F.collect_list(F.struct("size", "at")).alias("places"))
              .select(F.col("doc_id").alias("of_doc"), F.col("version").alias("of_version"), "places"))
    cut = lambda h: F.flatten(F.transform("places", lambda p: F.transform(p["at"], lambda s: F.struct(
        p["size"].alias("size"), s.alias("start"), F.slice(h, s + 1, p["size"]).alias("hashes")))))
    same = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("version") == F.col("of_version"))
    windows = (texts.dropna(subset=["text"]).join(listed, same).select("doc_id", "text", "places")
               .select("doc_id", F.explode(_bound(shingles(F.col("text"), shingle), cut)).alias("w")).select("doc_id", "w.*")
               .withColumn("content", F.xxhash64("size", "hashes")))
    windows = shared_table(windows.distinct())

    unique = windows.groupBy("content", "size").agg(F.first("hashes").alias("hashes")).withColumn("print", simhash(F.col("hashes")))
    unique = shared_table(unique)
    index = neighbours(kinds, radius)
    per_kind = sum(comb(b, k) for b in BLOCKS for k in range(radius // len(BLOCKS) + 1))
    if small and kinds.count() * per_kind <= BROADCAST_SHINGLES:
        index = F.broadcast(index)
    probes = unique.select("content", "size", F.explode(blocks_of(F.col("print"))).alias("b")).select("content", "size", "b.block", "b.value")
    met = probes.join(index, ["size", "block", "value"]).select("content", "kind").distinct()
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    near = (met.join(unique, "content").join(kinds.drop("size"), "kind").withColumn("distance", distance.cast("long"))
            .filter(F.col("distance") <= radius))
    shared = overlap(F.col("hashes"), F.col("item_hashes"))
    whole = F.size("hashes") + F.size("item_hashes") - F.col("shared")
    found = (near.withColumn("shared", shared).withColumn("similarity", F.col("shared") / whole)
             .filter(F.col("similarity") >= similarity - 1e-12).select("content", "kind", "similarity", "distance")
             .join(known.select("kind", "item_id"), "kind").drop("kind"))
    best = F.max_by(F.struct("start", (F.size("hashes") + m).alias("n_words"), "similarity", "distance"), F.struct("similarity", -F.col("start")))
    out = (windows.join(found, "content").groupBy("doc_id", "item_id").agg(best.alias("b"))
           .select("doc_id", "item_id", F.col("b.start").cast("long").alias("start"), F.col("b.n_words").cast("long").alias("n_words"),
                   F.round("b.similarity", 6).alias("similarity"), F.col("b.distance").alias("distance")))
    for part in short:
        out = out.unionByName(part)
    return out


#: The pairs by similarity alone.
SQL = r"""
with d as (
  select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents),
i as (
  select item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from benchmark),
ds as (
  select doc_id, p as start, array_to_string(w[p + 1 : p + 5], ' ') as s, len(w) - 4 as total
  from (select doc_id, w, unnest(range(0, len(w) - 4)) as p from d where len(w) >= 5)),
shi as (
  select item_id, len(w) - 4 as size, array_to_string(w[p + 1 : p + 5], ' ') as s
  from (select item_id, w, unnest(range(0, len(w) - 4)) as p from i where len(w) >= 5)),
ic as (select item_id, size, s, count(*) as n from shi group by all),
st as (select distinct doc_id, start, total, size from ds join (select distinct s, size from ic) using (s)),
ws as (
  select st.doc_id, st.start, st.size, least(st.size, st.total - st.start) as held, ds.s, count(*) as n
  from st join ds on ds.doc_id = st.doc_id and ds.start between st.start and st.start + st.size - 1 group by all),
sim as (
  select doc_id, item_id, ws.start, held, sum(least(ws.n, ic.n)) / (held + ws.size - sum(least(ws.n, ic.n))) as similarity
  from ws join ic on ic.size = ws.size and ic.s = ws.s group by doc_id, item_id, ws.start, held, ws.size)
select doc_id, item_id, start, held + 4 as n_words, round(similarity, 6) as similarity
from sim where similarity >= 0.8 - 1e-12
qualify row_number() over (partition by doc_id, item_id order by similarity desc, start) = 1
union all
select doc_id, item_id, min(p), k, 1.0 from (
  select doc_id, k, p, array_to_string(w[p + 1 : p + k], ' ') as s
  from (select doc_id, w, k, unnest(range(0, len(w) - k + 1)) as p from d, (values (1), (2), (3), (4)) n(k) where len(w) >= k)) x
join (select item_id, len(w) as k, array_to_string(w, ' ') as s from i where len(w) between 1 and 4) y using (k, s)
group by doc_id, item_id, k"""
