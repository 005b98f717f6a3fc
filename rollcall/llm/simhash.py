"""Near duplicates by SimHash.

Fingerprints are compared bit-sliced: the fingerprints of a bucket are stored
as vertical bit planes, 64 of them to a machine word. Differences to many
fingerprints are added plane by plane into carry-save counters that start so
high that a carry out of the top means "beyond the radius", and a block is
abandoned once that holds for all of it.

Which fingerprints meet in a bucket is exact: of m blocks of bits, two
fingerprints within the radius have at least m - radius alike (``block_keys``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.components import components
from rollcall.llm.names import unused
from rollcall.session import shared_table

#: Fingerprints of a bucket that one task compares with each other.
BLOCK = 2048
#: Runs up to this length are compared as lists of pairs.
SHORT = 24


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``size`` words, A-Z lower-cased."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[:-1]]
    size = min(size, len(words))
    return np.array([xxh64_intdigest(line[a:b - 1], 42) for a, b in zip(starts, ends[size - 1:])], np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; a signed long."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):  # bounded however long the text
        part = h[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.int64)[0])


def _prints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(shingle_hashes(t, size)) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("version"), pa.array(prints, pa.int64())], ["doc_id", "version", "print"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, version (hash of the text), print (a long)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("version"))
    return docs.mapInArrow(_prints(shingle), "doc_id long, version long, print long")


def block_keys(word: Column, radius: int, equal: int = 2) -> Column:
    """Keys of a 64-bit word: two words within ``radius`` bits share at least one.

    The word is cut into radius + equal blocks, of which at least ``equal``
    agree; there is one key for every choice of ``equal`` blocks. A larger
    ``equal`` makes smaller buckets of more keys.
    """
    m = radius + equal
    cuts = [round(64 * i / m) for i in range(m + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    keys = []
    for n, chosen in enumerate(combinations(range(m), equal)):
        mask = sum(masks[i] for i in chosen)
        mask -= (mask >> 63) << 64  # as a signed long
        keys.append(F.xxhash64(F.lit(n), word.bitwiseAND(F.lit(mask).cast("long"))))
    return F.array(*keys)


# --- bit-sliced comparison ---------------------------------------------------------------------------

def _near(planes: Iterator[np.ndarray], shape: tuple, radius: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(lanes whose difference planes have at most ``radius`` ones, counter planes less their start)."""
    depth = max(1, radius.bit_length())
    start = (1 << depth) - 1 - radius
    full = ~np.uint64(0)
    counter = [np.full(shape, full if start >> b & 1 else 0, np.uint64) for b in range(depth)]
    over = np.zeros(shape, np.uint64)
    for n, carry in enumerate(planes):
        for b in range(depth):
            counter[b], carry = counter[b] ^ carry, counter[b] & carry
        over |= carry
        if n % 8 == 7 and (over == full).all():
            break
    return ~over, counter


def _distances(mask: np.ndarray, counter: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, lane, distance) of the lanes in the mask; both are (rows, words)."""
    row, lane = np.nonzero(np.unpackbits(mask.view(np.uint8), axis=1, bitorder="little"))
    value = np.zeros(len(row), np.int32)
    for b, plane in enumerate(counter):
        value |= (plane[row, lane >> 6] >> (lane & 63).astype(np.uint64) & np.uint64(1)).astype(np.int32) << b
    start = (1 << len(counter)) - 1 - radius
    return row.astype(np.int32), lane.astype(np.int32), value - start


def _vertical(prints: np.ndarray) -> np.ndarray:
    """(bits, words of 64 lanes) from (rows, words of 64 bits)."""
    n = -(-len(prints) // 64) * 64
    by = np.zeros((n, prints.shape[1] * 8), np.uint8)
    by[:len(prints)] = np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), -1)
    bits = np.unpackbits(by, axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def pairs_listed(prints: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, distance) of the listed pairs within the radius."""
    out = []
    for i in range(0, len(a), 1 << 15):
        x, y = a[i:i + (1 << 15)], b[i:i + (1 << 15)]
        planes = _vertical(prints[x] ^ prints[y])[:, None, :]
        _, lane, d = _distances(*_near(iter(planes), planes.shape[1:], radius), radius)
        real = lane < len(x)
        out.append((x[lane[real]], y[lane[real]], d[real]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (a, b, a)


def pairs_between(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of left, row of right, distance) within the radius, left in small blocks."""
    planes, out = _vertical(right), []
    for i in range(0, len(left), 128):
        some = left[i:i + 128]
        bits = np.unpackbits(np.ascontiguousarray(some).view(np.uint8).reshape(len(some), -1), axis=1, bitorder="little")
        flip = (np.where(b[:, None], ~np.uint64(0), np.uint64(0)) for b in bits.T)
        row, lane, d = _distances(*_near((p[None, :] ^ f for p, f in zip(planes, flip)), (len(some), planes.shape[1]), radius), radius)
        real = lane < len(right)
        out.append((row[real] + i, lane[real], d[real]))
    return tuple(np.concatenate(c) for c in zip(*out))


def forest(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a spanning forest of least distance: what they connect, shorter pairs first."""
    labels, left, right = np.arange(n), [], []
    for level in np.unique(d):
        x, y = a[d == level], b[d == level]
        while len(x):
            p, q = labels[x], labels[y]
            apart = p != q
            x, y, p, q = x[apart], y[apart], p[apart], q[apart]
            high, first = np.unique(np.maximum(p, q), return_index=True)
            left.append(x[first])
            right.append(y[first])
            parent = np.arange(n)
            parent[high] = np.minimum(p, q)[first]
            while (parent[parent] != parent).any():
                parent = parent[parent]
            labels = parent[labels]
    return (np.concatenate(left), np.concatenate(right)) if left else (labels[:0], labels[:0])


def _links(radius: int):
    def chosen(t, a, b, d):
        """Nodes of the links that stand for the pairs (a, b)."""
        a, b = forest(len(t["node"]), a, b, d)
        return t["node"][a], t["node"][b]

    def long_run(t, cross: bool):
        at = np.nonzero(t["side"] == 0)[0] if cross else np.arange(len(t["node"]))
        to = np.nonzero(t["side"] == 1)[0] if cross else at
        if not len(at) or not len(to):
            return t["node"][:0], t["node"][:0]
        a, b, d = pairs_between(t["print"][at], t["print"][to], radius)
        a, b = at[a], to[b]
        if not cross:
            a, b, d = a[a < b], b[a < b], d[a < b]
        return chosen(t, a, b, d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(u, v):
            return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        def done(t):
            if not len(t["node"]):
                return
            change = np.nonzero((np.diff(t["key"]) != 0) | (np.diff(t["i"]) != 0) | (np.diff(t["j"]) != 0))[0] + 1
            starts, ends = np.r_[0, change], np.r_[change, len(t["node"])]
            short, left, right = ends - starts <= SHORT, [], []
            for s, e in zip(starts[~short], ends[~short]):
                u, v = long_run({c: x[s:e] for c, x in t.items()}, t["i"][s] != t["j"][s])
                left.append(u)
                right.append(v)
            by = {}
            for s, e in zip(starts[short], ends[short]):
                by.setdefault(e - s, []).append(s)
            for n, at in by.items():
                if n > 1:
                    x, y = np.triu_indices(n, 1)
                    a, b = (np.array(at)[:, None] + x).ravel(), (np.array(at)[:, None] + y).ravel()
                    new = (t["i"][a] == t["j"][a]) | (t["side"][a] != t["side"][b])
                    a, b = a[new], b[new]
                    u, v = chosen(t, *pairs_listed(t["print"], a, b, radius))
                    left.append(u)
                    right.append(v)
            if left:
                yield out(np.concatenate(left), np.concatenate(right))

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j", "side", "node")}
            t["print"] = t["node"].view(np.uint64).reshape(-1, 1)
            if held is not None:
                t = {c: np.concatenate([held[c], t[c]]) for c in t}
            same = (t["key"] == t["key"][-1]) & (t["i"] == t["i"][-1]) & (t["j"] == t["j"][-1])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            yield from done({c: x[:cut] for c, x in t.items()})
            held = {c: x[cut:] for c, x in t.items()}
        if held is not None:
            yield from done(held)

    return run


def links_within(prints: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) that connect what fingerprints within ``radius`` bits connect.

    ``prints``: node (long), distinct fingerprints. Those that share a key are
    compared. A bucket of more than ``BLOCK`` is dealt into blocks and each pair
    of blocks is a group of its own, so no task grows with a bucket; each group
    returns a spanning forest of its links of least distance, never all pairs.
    """
    keyed = prints.select("node", F.explode(F.array_distinct(block_keys(F.col("node"), radius))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    dealt = (keyed.join(shared, "key").withColumn("nb", F.ceil(F.col("n") / BLOCK).cast("int"))
             .withColumn("own", F.pmod(F.hash("node"), F.col("nb")))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    rows = dealt.select("key", i.alias("i"), j.alias("j"), (F.col("own") == j).cast("int").alias("side"), "node")
    return (rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
            .mapInArrow(_links(radius), "u long, v long")
            .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())


def near_groups(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, version, print, component_id, label of every row of ``docs`` (doc_id, text).

    The links are exactly the pairs of fingerprints within ``radius`` bits.
    component_id is the smallest doc_id of the component, label its own name.
    Null and blank texts have the fingerprint zero, and are linked like others;
    fewer words than ``shingle`` are one shingle. Repeated rows and ties share
    a component; very long texts are hashed whole. A null doc_id is a member
    that never names its component; other columns are ignored; an empty table
    gives an empty one.
    """
    prints = shared_table(fingerprints(docs, shingle))
    distinct = shared_table(prints.groupBy(F.col("print").alias("node")).agg(F.min("doc_id").alias("least")))
    labels = components(links_within(distinct.select("node"), radius))
    named = shared_table(distinct.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    names = named.groupBy("label").agg(F.min("least").alias("component_id"))
    found = named.join(names, "label").select(F.col("node").alias("print"), "label", "component_id")
    return prints.join(found, "print").select("doc_id", "version", "print", "component_id", "label")


def one_of_each(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """The row of ``docs`` with the smallest doc_id of each group of near duplicates, all columns.

    Groups are those of ``near_groups``: what pairs of fingerprints within
    ``radius`` bits connect, and nothing beside the bits is compared. Of
    repeated rows one stays; a null doc_id stays if its group has no other.
    """
    groups = near_groups(docs, shingle, radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "version")).alias("f")
    v, of_id, of_v = (unused(docs, n) for n in ("_near_version", "_kept_id", "_kept_version"))
    chosen = groups.groupBy("label").agg(first).select(F.col("f.doc_id").alias(of_id), F.col("f.version").alias(of_v)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(v) == F.col(of_v))
    rows = docs.withColumn(v, F.xxhash64(F.col("text").cast("string")))
    return rows.join(chosen, same, "left_semi").dropDuplicates(["doc_id", v]).select(*docs.columns)


def hexadecimal(word: Column) -> Column:
    """16 lower-case digits of a long."""
    return F.lower(F.lpad(F.hex(word), 16, "0"))
