"""Packing of documents into token sequences of a fixed size.

Bounded-space online packing: each partition keeps a fixed number of windows
open. A document's full windows stand alone; its rest goes to the open window
that it fills best. When none has room, the fullest is emitted, topped up with
a cut of the rest if its gap is worth one. Windows still open at the end of a
partition are leftovers; they carry their ids and are packed again in groups
of partitions until one group is left, whose own rest is filled in a row.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.pieces import encoder
from rollcall.session import shared_table

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "part long, open boolean, ids binary")
_TYPES = [pa.int64()] * 8 + [pa.bool_(), pa.binary()]
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
#: Partitions whose leftovers one task packs together.
GROUP = 64
ROWS = 1 << 14


class Packer:
    """Open windows of one partition. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, part: int, level: int, size: int, keep: int, least_cut: int):
        self.part, self.size, self.keep, self.least_cut = part, size, keep, least_cut
        self.next = (level << 56) | (part << 28)
        self.gaps: list[tuple[int, int]] = []  # (gap, window), in order
        self.held: dict[int, list[tuple]] = {}
        self.count = 0
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple], open_: bool = False) -> None:
        seq, at = self.next, 0
        self.next += 1
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, seq, at, self.part, open_, bytes(ids) if open_ else None))
            at += n

    def add(self, doc, ids, total: int, start: int = 0) -> None:
        """Place the ids of a document (or of one of its pieces)."""
        view, size = memoryview(ids), self.size
        whole = len(view) // 4 // size
        for i in range(whole):
            self.close([(doc, start + i * size, view[i * size * 4:(i + 1) * size * 4], total)])
        at, rest = whole * size, view[whole * size * 4:]
        while n := len(rest) // 4:
            k = bisect_left(self.gaps, (n, -1))
            if k < len(self.gaps):
                self._put(k, (doc, start + at, rest, total), n)
                return
            if len(self.gaps) < self.keep:
                self.held[self.count] = [(doc, start + at, bytes(rest), total)]
                insort(self.gaps, (size - n, self.count))
                self.count += 1
                return
            gap = self.gaps[0][0]
            if gap >= self.least_cut:  # the rest is longer than any gap
                self._put(0, (doc, start + at, rest[:gap * 4], total), gap)
                at, rest = at + gap, rest[gap * 4:]
            else:
                self.close(self.held.pop(self.gaps.pop(0)[1]))

    def _put(self, k: int, piece: tuple, n: int) -> None:
        gap, window = self.gaps.pop(k)
        doc, start, ids, total = piece
        self.held[window].append((doc, start, bytes(ids), total))
        if gap == n:
            self.close(self.held.pop(window))
        else:
            insort(self.gaps, (gap - n, window))

    def leave(self) -> None:
        """Hand on the open windows as leftovers."""
        for _, window in self.gaps:
            self.close(self.held.pop(window), open_=True)
        self.gaps = []

    def fill(self) -> None:
        """Fill what is open in a row, so that one sequence at most has a gap."""
        pieces = [p for _, window in self.gaps for p in self.held.pop(window)]
        self.gaps, now, room = [], [], self.size
        for doc, start, ids, total in pieces:
            while ids:
                n = min(room, len(ids) // 4)
                now.append((doc, start, ids[:n * 4], total))
                start, ids, room = start + n, ids[n * 4:], room - n
                if not room:
                    self.close(now)
                    now, room = [], self.size
        if now:
            self.close(now)

    def out(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*self.rows), _TYPES)], _NAMES)
            self.rows = []


def _first(vocabulary: str, end_id: int, size: int, keep: int, least_cut: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end = encoder(vocabulary), end_id.to_bytes(4, "little")
        packer = Packer(TaskContext.get().partitionId(), 0, size, keep, least_cut)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.ids(texts)):
                packer.add(doc, ids + end, len(ids) // 4 + 1)
                yield from packer.out(ROWS)
        packer.leave()
        yield from packer.out()

    return run


def _again(level: int, last: bool, size: int, keep: int, least_cut: int):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(key[0].as_py(), level, size, keep, least_cut)
        rows = pa.Table.from_batches(list(batches)).sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        for r in rows.select(["doc_id", "ids", "doc_tokens", "start"]).to_batches(max_chunksize=1024):
            for doc, ids, total, start in zip(*(c.to_pylist() for c in r.columns)):
                packer.add(doc, ids, total, start)
        packer.fill() if last else packer.leave()
        yield from packer.out()

    return run


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, size: int = 1024, keep: int = 64,
         least_cut: int = 16) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and ``end_id``; null text is empty, so every row has
    a token. Repeated rows are packed each for itself, null doc_ids are kept,
    and other columns are ignored. Sequences hold at most ``size`` ids, lie
    gapless from offset 0, and all but one of the last group have fewer than
    ``least_cut`` ids of padding. An empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    made = shared_table(docs.mapInArrow(_first(vocabulary, end_id, size, keep, least_cut), SCHEMA))
    parts, level = docs.rdd.getNumPartitions(), 0
    done = made.filter("not open")
    while True:
        parts, level = -(-parts // GROUP), level + 1
        rest = made.filter("open").withColumn("part", F.floor(F.col("part") / GROUP).cast("long"))
        step = _again(level, parts <= 1, size, keep, least_cut)
        made = shared_table(rest.groupBy("part").applyInArrow(step, SCHEMA))
        done = done.unionByName(made.filter("not open"))
        if parts <= 1:
            return done.drop("part", "open", "ids")
