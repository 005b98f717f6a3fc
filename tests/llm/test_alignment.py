"""Alignment against encodings of the whole texts and a walk over their bytes."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from rollcall.llm import alignment
from rollcall.llm.alignment import Aligner, Csr, align, group_ends, overlaps, product, shared_groups, token_links


@pytest.fixture(scope="module")
def whole():
    """(ids, bytes of tokens) of a whole text by each tokenizer."""
    a = Tokenizer.from_file(path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(sorted(set(range(256)) - set(shown)))}

    def run(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        pieces = b.encode(text)
        names = [b.id_to_piece(i) for i in pieces]
        return ((ids, [bytes(letter[c] for c in a.id_to_token(i)) for i in ids]),
                (pieces, [bytes([int(n[3:5], 16)]) if b.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(pieces, names)]))

    return run


def plain(rows, whole):
    """Links by a walk over the bytes; the digest columns of every row, in order."""
    made, held = [], Counter()
    for _, text in rows:
        found = ([], [], [], [])
        if text:
            (a, a_bytes), (b, b_bytes) = whole(text)
            if b"".join(a_bytes) == b"".join(b_bytes) == f" {text}".encode():
                of_a = [i for i, x in enumerate(a_bytes) for _ in x]
                of_b = [i for i, x in enumerate(b_bytes) for _ in x]
                links = sorted(set(zip(of_a, of_b)))
                cut = [k for k in range(len(of_a)) if (k + 1 == len(of_a)) or (of_a[k] != of_a[k + 1] and of_b[k] != of_b[k + 1])]
                groups, start = [], 0
                for k in cut:
                    groups.append((sorted(set(of_a[start:k + 1])), sorted(set(of_b[start:k + 1]))))
                    start = k + 1
                found = (a, b, groups, [(a[i], b[j]) for i, j in links])
        made.append(found)
        held.update(set(found[3]))
    highest = defaultdict(int)
    for (a, _), n in held.items():
        highest[a] = max(highest[a], n)
    out = []
    for (doc, _), (a, b, groups, links) in zip(rows, made):
        text = ";".join(",".join(str(a[i]) for i in x) + "|" + ",".join(str(b[j]) for j in y) for x, y in groups)
        out.append((doc, len(a), len(b), len(groups), len(links), sum(held[p] == highest[p[0]] for p in links), sum(held[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if a else "", sum(len(x) * len(y) for x, y in groups)))
    return sorted(map(str, out))


def got(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_products(spark):
    r = np.random.default_rng(1)
    x, y = r.integers(0, 3, (9, 7)), r.integers(0, 3, (7, 11))
    sparse = lambda m: Csr(np.r_[0, np.cumsum((m > 0).sum(1))], np.nonzero(m)[1], m[m > 0], m.shape[1])
    z = product(sparse(x), sparse(y))
    full = np.zeros((9, 11), int)
    full[z.rows(), z.col] = z.val
    assert (full == x @ y).all()
    a, b = np.array([1, 3, 6, 7]), np.array([3, 4, 7])
    o = overlaps(a, b)
    assert list(zip(o.rows().tolist(), o.col.tolist(), o.val.tolist())) == [(0, 0, 1), (1, 0, 2), (2, 1, 1), (2, 2, 2), (3, 2, 1)]
    assert group_ends(a, b).tolist() == [3, 7]
    g = shared_groups(a, b)
    assert list(zip(g.rows().tolist(), g.col.tolist())) == [(0, 0), (1, 0), (2, 1), (2, 2), (3, 1), (3, 2)]
    assert (shared_groups(a, b, 2, 3).col == [1, 2]).all()


ODD = ["", " ", "  two  blanks  ", "\n\nlines\r\nend;\r\nmore });\r", "tab\tand hard wide", "under▁scored", "<|endoftext|> <s> </s> <0x0A>",
       "naïve 😀 é Σ İ 漢字かな", "\x01 wall \x01\x02x", "\0zero\0", "x" * 700, "a　b \r", "mark's they're 's", "▁", "1234567890 12", " lead"]


def test_chunks_encode_like_whole_texts(whole):
    both = Aligner("byte_bpe_50k.json", "piece_bpe_32k.model")
    assert "\r" in both.joined and " " not in both.joined
    for text in ODD[1:]:
        chunks = both.chunks(text)
        assert "".join(chunks) == " " + text
        (a, _), (b, _) = whole(text)
        assert np.frombuffer(b"".join(both.a.ids(chunks)), "<u4").tolist() == a, text
        assert [i for ids in both.b_ids(chunks) for i in ids] == b, text


@pytest.mark.parametrize("head,remembered,size", [(1 << 18, 1 << 25, 512), (40, 300, 3), (0, 1 << 25, 512)])
def test_against_whole_texts(spark, docs, whole, monkeypatch, head, remembered, size):
    monkeypatch.setattr(alignment, "REMEMBERED", remembered)
    monkeypatch.setattr(alignment, "DOCS", size)
    rows = [(r.doc_id, r.text) for r in docs.limit(60).collect()] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000, None), (None, "no id"), (3, "twice"), (3, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(align(df, head=head)) == plain(rows, whole)


def test_odd_rows(spark, odd, none, whole):
    clash = odd.withColumn("pairs", F.lit(1)).withColumn("n_a", F.lit("x")).withColumn("pair", F.lit(2)).withColumn("groups_sha256", F.lit(0))
    rows = [(r.doc_id, r.text) for r in clash.collect()]
    assert got(align(clash)) == plain(rows, whole)
    assert align(none).count() == 0


def test_token_links(spark, whole):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    digests = {r.doc_id: r for r in align(df).collect()}
    for groups, name in ((False, "n_links"), (True, "n_group_links")):
        n = Counter()
        for r in token_links(df, groups=groups).collect():
            n[r.doc_id] += 1
            (a, _), (b, _) = whole(ODD[r.doc_id])
            assert a[r.a] == r.a_id and b[r.b] == r.b_id
        assert all(n[d] == digests[d][name] for d in digests)


def test_one_space_at_the_end(spark, whole):
    both = Aligner("byte_bpe_50k.json", "piece_bpe_32k.model")
    texts = ["two words ", "line\n ", " ", "x ", "wide\u3000 ", "two words"]
    for text in texts:
        assert [i for ids in both.b_ids(both.chunks(text)) for i in ids] == whole(text)[1][0], text
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(align(df)) == plain(rows, whole)
    assert token_links(df).filter("doc_id = 0").count() == align(df).filter("doc_id = 0").first().n_links > 0
