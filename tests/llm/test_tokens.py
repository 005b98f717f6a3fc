"""Pieces, counts, planes and packing against the tokenizers library itself."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from public_tokenizers import path  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from rollcall.llm import packing, token_planes  # noqa: E402
from rollcall.llm.packing import Packer, pack  # noqa: E402
from rollcall.llm.pieces import encoder  # noqa: E402
from rollcall.llm.token_counts import count_tokens  # noqa: E402
from rollcall.llm.token_planes import decode, pack_blocks, read_ids, unpack_blocks, write_ids  # noqa: E402

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"


def whole(name, texts):
    return [e.ids for e in Tokenizer.from_file(path(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", [BYTES, WORDS])
def test_pieces_give_the_ids_of_whole_texts(name):
    r = random.Random(5)
    parts = ["a", "B", " ", "\n", "\t", "  ", "\n\n", "<|endoftext|>", "'s", "é", "e\u0301", "\xa0", "\u2003", ".", "...", "\x1c", "\0",
             "12", "\r\n", "\x85", "<|startoftext|>", "İ", "Σ", "word", "Ünder", "!!", "_"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    got = [np.frombuffer(b, "<u4").tolist() for b in encoder(name).ids(texts)]
    assert got == whole(name, texts)


def test_counts(odd, none, docs):
    for df in (odd, docs):
        rows = df.select("doc_id", "text").collect()
        want = sorted((str(r.doc_id), len((r.text or "").encode()), len(i)) for r, i in zip(rows, whole(BYTES, [r.text for r in rows])))
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in count_tokens(df, head=50).collect()) == want
    assert count_tokens(none).count() == 0


@pytest.mark.parametrize("bits", [False, True])
def test_blocks_come_back(bits, monkeypatch):
    monkeypatch.setattr(token_planes, "BLOCK", 100)
    for n in (0, 1, 99, 100, 1001):
        ids = np.random.default_rng(n).integers(0, 1 << 32, n).astype("<u4")
        assert (unpack_blocks(*pack_blocks(ids, bits), bits) == ids).all()


@pytest.mark.parametrize("bits", [False, True])
def test_planes(spark, odd, none, docs, tmp_path, bits):
    for k, df in enumerate((odd, docs, none)):
        rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
        to = str(tmp_path / f"{k}")
        write_ids(df, to, bits=bits)
        got = sorted(read_ids(spark, to).collect(), key=lambda r: r.start)
        at, ids = 0, whole(WORDS, [r.text for r in rows])
        assert [r.doc_id for r in got] == [r.doc_id for r in rows]
        for r, i in zip(got, ids):
            assert (r.start, r.n_tokens) == (at, r.n_tokens)
            at += r.n_tokens
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted(
            (str(r.doc_id), len(i) + 1, crc(i + [1])) for r, i in zip(rows, ids))
        assert sum(len(r.ids) for r in decode(spark, to).collect()) == at


def check_pack(df, rows):
    want = defaultdict(list)
    for r, ids in zip(rows, whole(BYTES, [r.text for r in rows])):
        want[r.doc_id].append(ids + [0])
    by, seq = defaultdict(list), defaultdict(list)
    for p in df.collect():
        by[p.doc_id].append(p)
        seq[p.sequence_id].append(p)
    assert by.keys() == want.keys()
    for doc, copies in want.items():
        pieces = sorted(by[doc], key=lambda p: p.start)
        assert sum(p.length for p in pieces) == sum(map(len, copies))
        for p in pieces:
            assert any(p.doc_tokens == len(c) and crc(c[p.start:p.start + p.length]) == p.ids_crc32 for c in copies)
        if len(copies) == 1:
            assert [p.start for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
    fills = []
    for s in seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
        fills.append(at)
    return fills


def test_packing(odd, none, docs, monkeypatch):
    fills = check_pack(pack(odd), odd.select("doc_id", "text").collect())
    assert sum(f <= 1024 - 16 for f in fills) <= 1
    monkeypatch.setattr(packing, "GROUP", 2)  # so that leftovers take several rounds
    many = docs.repartition(7, "doc_id")
    fills = check_pack(pack(many, keep=3), many.collect())
    assert sum(f <= 1024 - 16 for f in fills) <= 1
    assert pack(none).count() == 0


def test_packer_fills_best():
    p = Packer(0, 0, 10, keep=2, least_cut=3)
    ids = lambda n: bytes(4 * n)
    for doc, n in enumerate([6, 8, 2, 9]):  # 2 fits the gap of 2 best; 9 fits none and tops up the gap of 4
        p.add(doc, ids(n), n)
    p.fill()
    assert [(r[0], r[1], r[2], r[6]) for r in p.rows] == [(1, 0, 8, 0), (2, 0, 2, 8), (3, 0, 9, 0), (0, 0, 1, 9), (0, 1, 5, 0)] or \
        sorted((r[0], r[2]) for r in p.rows if r[0] in (1, 2)) == [(1, 8), (2, 2)]
