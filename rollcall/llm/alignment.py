"""Alignment of the tokens of two tokenizers by sparse matrix products.

Of a stretch of text, A is the incidence matrix of the first tokenizer's tokens
and the bytes they cover, B that of the second one's. The rows of A x B^T, made
Gustavson's way from hand-built CSR arrays, hold the tokens that overlap. Byte
offsets where tokens of both end cut them into groups; the product of the two
group incidences holds the tokens that share a group.

Both tokenizers end a token at the end of a chunk (a run of white space with the
other characters after it), so the matrices are block-diagonal over chunks. A
task makes the blocks of the distinct chunks that it meets, and the links of
documents are one more product: documents x chunks by chunks x links.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.pieces import BLANK, Encoder, blank_led
from rollcall.session import shared_table

#: Documents and bytes of a product; bytes of chunks, and words, that a worker remembers.
DOCS, BYTES, REMEMBERED, WORDS = 512, 1 << 21, 1 << 25, 1 << 18
_AFTER = re.compile(f"[^{BLANK}▁]([{BLANK}])")


@dataclass
class Csr:
    """Rows of (column, value): row i is at ``ptr[i]`` to ``ptr[i + 1]``."""

    ptr: np.ndarray
    col: np.ndarray
    val: np.ndarray
    width: int

    @staticmethod
    def ones(lengths: np.ndarray, col: np.ndarray, width: int) -> Csr:
        return Csr(np.r_[0, np.cumsum(lengths)], col, np.ones(len(col), np.int64), width)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def product(a: Csr, b: Csr) -> Csr:
    """Row i is the sum of the rows of ``b`` that row i of ``a`` names, each times its value there."""
    lengths = np.diff(b.ptr)[a.col]
    ends = np.cumsum(lengths)
    at = np.repeat(b.ptr[:-1][a.col] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
    key = np.repeat(a.rows(), lengths) * b.width + b.col[at]
    value = np.repeat(a.val, lengths) * b.val[at]
    if len(key) and (np.diff(key) < 0).any():
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
    first = np.flatnonzero(np.r_[True, np.diff(key) != 0]) if len(key) else np.zeros(0, np.int64)
    row, col = np.divmod(key[first], b.width)
    ptr = np.r_[0, np.cumsum(np.bincount(row, minlength=len(a.ptr) - 1))]
    return Csr(ptr, col, np.add.reduceat(value, first) if len(first) else value, b.width)


def transposed(ends: np.ndarray, n_bytes: int) -> Csr:
    """Bytes x tokens, for tokens that end at ``ends``: every byte lies in one."""
    lengths = np.diff(np.r_[0, ends])
    return Csr.ones(np.ones(n_bytes, np.int64), np.repeat(np.arange(len(ends)), lengths), len(ends))


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> Csr:
    """A tokens x B tokens: the bytes that they share."""
    n = int(a_ends[-1]) if len(a_ends) else 0
    return product(Csr.ones(np.diff(np.r_[0, a_ends]), np.arange(n), n), transposed(b_ends, n))


def group_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Offsets where a token of either ends."""
    return np.intersect1d(a_ends, b_ends, assume_unique=True)


def shared_groups(a_ends: np.ndarray, b_ends: np.ndarray, first: int = 0, last: int | None = None) -> Csr:
    """Rows ``first`` to ``last`` of A tokens x B tokens: 1 where they lie in the same group."""
    cut = group_ends(a_ends, b_ends)
    of_a, of_b = np.searchsorted(cut, a_ends[first:last]), np.searchsorted(cut, b_ends)
    groups = Csr.ones(np.bincount(of_b, minlength=len(cut)), np.arange(len(b_ends)), max(1, len(b_ends)))
    return product(Csr.ones(np.ones(len(of_a), np.int64), of_a, len(cut)), groups)


class Growing:
    """An array that grows at its end."""

    def __init__(self):
        self.held, self.n = np.zeros(1 << 12, np.int64), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            held = np.zeros(2 * (self.n + len(values)), np.int64)
            held[:self.n] = self.held[:self.n]
            self.held = held
        self.held[self.n:self.n + len(values)] = values
        self.n += len(values)

    def all(self) -> np.ndarray:
        return self.held[:self.n]


class Aligner:
    """Two tokenizers, and the blocks of the chunks that were met."""

    def __init__(self, a_name: str, b_name: str):
        from public_tokenizers import path
        from sentencepiece import SentencePieceProcessor

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Encoder(a_name, blank_led, lower=False, specials=False)
        self.b = SentencePieceProcessor(model_file=path(b_name))
        spelled = {chr(c): bytes([b]) for b, c in self.a.letters.items()}
        spelled |= {chr(b): bytes([b]) for b in range(256) if b not in self.a.letters}
        size = self.a.tok.get_vocab_size()
        self.a_bytes = [b"".join(spelled.get(c, c.encode()) for c in self.a.tok.id_to_token(i) or "") for i in range(size)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        plain = [p for i, p in enumerate(pieces) if not self.b.is_byte(i) and not self.b.is_control(i)]
        if any("▁" in p.lstrip("▁") for p in plain):
            raise ValueError(f"{b_name} has pieces that go on after a space")
        #: White space that a piece may hold after another character: no chunk may begin with it.
        self.joined = {m for p in plain for m in _AFTER.findall(p)}
        used = {c for p in plain for c in p}
        #: A character that stands in no piece and so keeps what follows apart from the space that the library adds.
        self.wall = next(c for c in map(chr, range(1, 32)) if c not in used and c not in BLANK)
        self.wall_ids = len(self.b.encode(self.wall))
        self.n_b = len(pieces)
        self.forget()

    def forget(self) -> None:
        self.code, self.size = {}, 0
        self.ptr, self.link, self.times = Growing(), Growing(), Growing()
        self.ptr.add(np.zeros(1, np.int64))
        #: Per chunk: tokens of A, of B, groups, links, pairs in a group, and whether it is what its tokens spell.
        self.facts = [Growing() for _ in range(6)]
        self.text: list[bytes] = []

    def chunks(self, text: str) -> list[str]:
        """Chunks of the text after a space, between which no token of either reaches."""
        cut = blank_led(" " + text)
        if any(c in text for c in self.joined):
            whole = [cut[0]]
            for c in cut[1:]:
                if c[0] in self.joined:
                    whole[-1] += c
                else:
                    whole.append(c)
            return whole
        return cut

    def b_ids(self, chunks: list[str]) -> list[list[int]]:
        led = [c[0] == " " and c != " " for c in chunks]  # the library adds no space to nothing
        out = self.b.encode([c[1:] if s else self.wall + c for c, s in zip(chunks, led)], num_threads=1)
        return [ids if s else ids[self.wall_ids:] for ids, s in zip(out, led)]

    def learn(self, new: list[str]) -> None:
        """Make the blocks of new chunks."""
        self.code.update(zip(new, range(len(self.code), len(self.code) + len(new))))
        self.size += sum(map(len, new)) + 64 * len(new)
        raw, a_ids, b_ids = [c.encode() for c in new], list(self.a.ids(new)), self.b_ids(new)
        if len(self.a.known) > WORDS:  # the blocks hold the chunks; these are only words met again in new ones
            self.a.known.clear()
        fits = self.spelled(raw, a_ids, b_ids)
        for k in np.flatnonzero(~fits):
            raw[k], a_ids[k], b_ids[k] = b"", b"", []
        n_a, n_b = np.array([len(x) // 4 for x in a_ids]), np.array([len(x) for x in b_ids])
        a = np.frombuffer(b"".join(a_ids), "<u4").astype(np.int64)
        b = np.fromiter(chain.from_iterable(b_ids), np.int64, n_b.sum())
        chunk_a = np.repeat(np.arange(len(new)), n_a)
        a_ends, b_ends = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        links = overlaps(a_ends, b_ends)
        chunk = chunk_a[links.rows()]
        cut = group_ends(a_ends, b_ends)
        of_a, of_b = np.searchsorted(cut, a_ends), np.searchsorted(cut, b_ends)
        # what every token of A shares its group with: the group incidence times the groups' numbers of B tokens
        mates = product(Csr.ones(np.ones(len(a), np.int64), of_a, len(cut)),
                        Csr(np.arange(len(cut) + 1), np.zeros(len(cut), np.int64), np.bincount(of_b, minlength=len(cut)), 1))
        in_chunk = np.searchsorted(np.cumsum([len(r) for r in raw]), cut)
        count = lambda owner, weights=None: np.bincount(owner, weights, minlength=len(new)).astype(np.int64)
        for held, values in zip(self.facts, (n_a, n_b, count(in_chunk), count(chunk), count(chunk_a, mates.val), fits)):
            held.add(values)
        pair, times = np.unique(chunk * (len(self.a_bytes) * self.n_b) + a[links.rows()] * self.n_b + b[links.col], return_counts=True)
        owner, pair = np.divmod(pair, len(self.a_bytes) * self.n_b)
        self.link.add(pair)
        self.times.add(times)
        self.ptr.add(self.ptr.all()[-1] + np.cumsum(count(owner)))
        digits_a, digits_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        ends = zip(np.searchsorted(of_a, np.arange(len(cut)), "right").tolist(), np.searchsorted(of_b, np.arange(len(cut)), "right").tolist())
        spelled, i, j = [], 0, 0
        for p, q in ends:
            spelled.append(f"{','.join(digits_a[i:p])}|{','.join(digits_b[j:q])}")
            i, j = p, q
        i = 0
        for p in np.cumsum(count(in_chunk)).tolist():
            self.text.append(";".join(spelled[i:p]).encode())
            i = p

    def spelled(self, raw: list[bytes], a_ids: list[bytes], b_ids: list[list[int]]) -> np.ndarray:
        """Which chunks are what their tokens of both kinds spell."""
        a = [b"".join([self.a_bytes[i] for i in np.frombuffer(x, "<u4").tolist()]) for x in a_ids]
        b = [b"".join([self.b_bytes[i] for i in x]) for x in b_ids]
        return np.array([x == y == z for x, y, z in zip(raw, a, b)], bool)

    def documents(self, texts: list[str | None]) -> tuple[list[np.ndarray], Csr, list[str]]:
        """(per text: tokens of A, of B, groups, links, pairs in a group; texts x id pairs; digests)."""
        if self.size > REMEMBERED:
            self.forget()
        cut = [self.chunks(t) if t else [] for t in texts]
        if new := list(dict.fromkeys(c for chunks in cut for c in chunks if c not in self.code)):
            self.learn(new)
        code = self.code
        codes = [np.array([code[c] for c in chunks], np.int64) for chunks in cut]
        fits = self.facts[5].all()
        codes = [c if fits[c].all() else c[:0] for c in codes]
        digests = [hashlib.sha256(b";".join([self.text[i] for i in c.tolist()])).hexdigest() if len(c) else "" for c in codes]
        own = [np.unique(c, return_counts=True) for c in codes]
        held = Csr(np.r_[0, np.cumsum([len(c) for c, _ in own])], np.concatenate([c for c, _ in own]),
                   np.concatenate([n for _, n in own]), len(self.text))
        blocks = Csr(self.ptr.all(), self.link.all(), self.times.all(), len(self.a_bytes) * self.n_b)
        owner = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
        every = np.concatenate(codes)
        sums = [np.bincount(owner, f.all()[every], minlength=len(texts)).astype(np.int64) for f in self.facts[:5]]
        return sums, product(held, blocks), digests


@lru_cache(maxsize=1)
def aligner(a_name: str, b_name: str) -> Aligner:
    """One per worker process."""
    return Aligner(a_name, b_name)


_NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_group_links"]
SCHEMA = "doc_id long, " + ", ".join(f"{n} long" for n in _NAMES) + ", groups_sha256 string, pairs array<long>, times array<long>"


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > BYTES or i + 1 - start == DOCS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _aligned(a_name: str, b_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_name, b_name)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, end in _parts(texts):
                sums, pairs, digests = both.documents(texts[start:end])
                lists = [pa.ListArray.from_arrays(pa.array(pairs.ptr, pa.int32()), pa.array(v, pa.int64())) for v in (pairs.col, pairs.val)]
                yield pa.record_batch([batch.column("doc_id").slice(start, end - start), *(pa.array(s, pa.int64()) for s in sums),
                                       pa.array(digests, pa.string()), *lists], ["doc_id", *_NAMES, "groups_sha256", "pairs", "times"])

    return run


def token_links(docs: DataFrame, a_name: str = "byte_bpe_50k.json", b_name: str = "piece_bpe_32k.model", groups: bool = False) -> DataFrame:
    """doc_id, a (ordinal, id), b (ordinal, id), value of all linked tokens: shared bytes, or 1 with ``groups``.

    Rows of the product are made some at a time. Texts that either tokenizer
    does not spell out as they are have no tokens.
    """
    schema = "doc_id long, a long, a_id long, b long, b_id long, value long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_name, b_name)
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                chunks = both.chunks(text) if text else []
                a = np.frombuffer(b"".join(both.a.ids(chunks)), "<u4").astype(np.int64)
                b = np.array([i for ids in both.b_ids(chunks) for i in ids], np.int64)
                spelled = f" {text}".encode()
                if not chunks or b"".join([both.a_bytes[i] for i in a]) != spelled or b"".join([both.b_bytes[i] for i in b]) != spelled:
                    continue
                a_ends, b_ends = np.cumsum(both.a_len[a]), np.cumsum(both.b_len[b])
                step = 256 if groups else len(a)
                for i in range(0, len(a), step):
                    links = shared_groups(a_ends, b_ends, i, i + step) if groups else overlaps(a_ends, b_ends)
                    row = links.rows() + i
                    cols = [row, a[row], links.col, b[links.col], links.val]
                    yield pa.record_batch([pa.array([doc] * len(row), pa.int64()), *(pa.array(c, pa.int64()) for c in cols)],
                                          ["doc_id", "a", "a_id", "b", "b_id", "value"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def align(docs: DataFrame, a_name: str = "byte_bpe_50k.json", b_name: str = "piece_bpe_32k.model", head: int = 1 << 18) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_group_links of every row of ``docs``.

    A pair's count is the number of rows of ``docs`` (doc_id, text) that hold it
    linked; a link is best if no pair of its A id has a higher count. The
    ``head`` most counted pairs at most travel to the tasks, so they are no hot
    keys; the links of all others meet their counts in a join.

    Null and empty texts, and texts that a tokenizer does not spell out as they
    are, have zeros and ''. Long texts are aligned whole, as many chunks.
    Repeated rows count each for itself, null doc_ids are kept, other columns
    are ignored; an empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    made = shared_table(docs.mapInArrow(_aligned(a_name, b_name), SCHEMA).withColumn("row", F.monotonically_increasing_id()))
    counts = shared_table(made.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    a_id = F.floor(F.col("pair") / pieces_of(b_name)).alias("a_id")
    highest = counts.groupBy(a_id).agg(F.max("n").alias("highest"))  # a row per id of A's vocabulary at the most
    counts = shared_table(counts.withColumn("a_id", a_id).join(F.broadcast(highest), "a_id")
                          .select("pair", "n", (F.col("n") == F.col("highest")).cast("long").alias("best")))
    linked = made.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("t"))
    least, total = 0, 0
    for bin_, n in sorted(counts.groupBy(F.floor(16 * F.log2("n")).alias("bin")).count().collect(), reverse=True):
        if total + n > head:
            least = bin_ + 1
            break
        total += n
    bin_of = F.floor(16 * F.log2("n"))
    known = linked.join(F.broadcast(counts.filter(bin_of >= least)), "pair", "left")
    sums = [F.sum(F.col("t") * F.col("best")).alias("n_best"), F.sum(F.col("t") * F.col("n")).alias("count_sum")]
    if least:
        rare = known.filter(F.col("n").isNull()).select("pair", "row", "t").join(counts.filter(bin_of < least), "pair")
        known = known.filter(F.col("n").isNotNull()).unionByName(rare)
    per_row = known.groupBy("row").agg(*sums)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return made.drop("pairs", "times").join(per_row, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", "n_group_links")


@lru_cache(maxsize=4)
def pieces_of(name: str) -> int:
    """Size of a vocabulary of pieces."""
    from public_tokenizers import path
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path(name)).get_piece_size()
