"""Quality by repetition coverage.

Rolling hashes of several n-gram lengths mark the n-grams that a text repeats;
the share of a text's characters that lie inside them, and inside repeated
lines, decides. A longer n-gram repeats only where the shorter one at the same
place does, so each length looks only at what the one before has left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.pieces import bare

_WORD = re.compile(r"[^\x20\x09-\x0D]")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_MIX = np.uint64(0x9E3779B97F4A7C15)

# Largest share of characters inside repeated n-grams, by length,
# and inside repeated lines, as published quality rules for web text give them.
SHARES = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_SHARE = 0.30

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in SHARES)]


def _repeated(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which values occur twice or more, which have occurred before)."""
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    again = np.zeros(len(codes), bool)
    again[order[1:][same]] = True
    both = again.copy()
    both[order[:-1][same]] = True
    return both, again


def _covered(starts: np.ndarray, n: int, length: int) -> np.ndarray:
    """Words inside windows of n words at the given places."""
    edge = np.zeros(length + 1, np.int32)
    edge[starts] += 1
    np.subtract.at(edge, starts + n, 1)
    return np.cumsum(edge[:-1]) > 0


def measures(text: str | None) -> tuple:
    """The counts of one text, in the order of ``COUNTS``."""
    text = text or ""
    words = bare(text)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    first: dict[str, int] = {}
    ids = np.fromiter((first.setdefault(w, len(first)) for w in words), np.uint64, len(words))

    lines, dup_lines, line_chars = set(), 0, 0
    for line in text.split("\n"):
        if _WORD.search(line):
            if line in lines:
                dup_lines += 1
                line_chars += len(line) - len(re.findall(r"[\x20\x09-\x0D]", line))
            lines.add(line)

    n, repeat_words, inside = len(words), 0, dict.fromkeys(SHARES, 0)
    if n >= 3 and len(first) < n:
        if len(first) < 1 << 21:
            threes = ids[:-2] | ids[1:-1] << np.uint64(21) | ids[2:] << np.uint64(42)
        else:  # rank pairs first; ranks and ids fit 32 bits
            _, two = np.unique(ids[:-1] << np.uint64(32) | ids[1:], return_inverse=True)
            threes = two[:-1].astype(np.uint64) << np.uint64(32) | ids[2:]
        at = np.nonzero(_repeated(threes)[0])[0]
        repeat_words = int(_covered(at, 3, n).sum())
        values = (ids + np.uint64(1)) * _MIX
        values ^= values >> np.uint64(31)
        for size in SHARES:
            if not len(at):
                break
            at = at[at <= n - size]
            rolling = values[at]
            for k in range(1, size):
                rolling = rolling * _MIX + values[at + k]
                rolling ^= rolling >> np.uint64(29)
            both, again = _repeated(rolling)
            if again.any():
                inside[size] = int(sizes[_covered(at[again], size, n)].sum())
            at = at[both]
    return (n, int(sizes.sum()), len(_SYMBOL.findall(text)), dup_lines, repeat_words, line_chars, *inside.values())


def _measure(prefix: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [prefix + c for c in COUNTS]
        for batch in batches:
            rows = [measures(t) for t in batch.column("text").to_pylist()]
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, *names])

    return run


def with_verdict(docs: DataFrame, prefix: str = "") -> DataFrame:
    """All columns of ``docs``, the counts, base_failed and kept; ``prefix`` starts the names of the new ones."""
    schema = T.StructType([*docs.schema, *(T.StructField(prefix + c, T.LongType()) for c in COUNTS)])
    rows, at = docs.mapInArrow(_measure(prefix), schema), lambda c: F.col(prefix + c)
    failed = (at("n_words") < 50) | (100 * at("n_repeat_words") > 50 * at("n_words"))
    within = at("dup_line_chars") <= LINE_SHARE * at("word_chars")
    for n, share in SHARES.items():
        within &= at(f"dup_chars_{n}") <= share * at("word_chars")
    return rows.withColumn(prefix + "base_failed", failed).withColumn(prefix + "kept", ~failed & within)


def repetition(docs: DataFrame) -> DataFrame:
    """Counts of ``docs`` (doc_id, text) and the verdict.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words are plain
    counts; dup_chars_N and dup_line_chars are the word characters inside
    N-word runs that have occurred before in the text, and inside lines equal
    to an earlier one. base_failed: fewer than 50 words, or over half of them in repeated
    three-word runs. kept: not so, and every share within ``SHARES`` and
    ``LINE_SHARE``. A null text is empty and fails; repeated rows are judged
    each for itself; a null doc_id is kept; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return with_verdict(docs).drop("text")
