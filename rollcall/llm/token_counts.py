"""Token counts from distinct pre-tokens.

Every distinct pre-token of the corpus is counted once by the tokenizer. The
counts meet the per-document frequencies in a join and are summed; no list of
ids is ever kept. The most frequent pre-tokens, which would be hot keys of that
join, travel to the tasks as a table of at most ``head`` entries instead.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.pieces import LONGEST, encoder
from rollcall.session import shared_table

#: Distinct pre-tokens that a task holds before it hands them on.
HELD = 1 << 19
ROWS = 1 << 16


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def _frequencies(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen = encoder(vocabulary).chunks, Counter()

        def out():
            names, counts = list(seen), list(seen.values())
            for i in range(0, len(names), ROWS):
                yield pa.record_batch([pa.array(names[i:i + ROWS], pa.string()), pa.array(counts[i:i + ROWS], pa.int64())],
                                      ["piece", "freq"])
            seen.clear()

        for batch in batches:
            for text in _texts(batch):
                seen.update(cut(text))
                if len(seen) > HELD:
                    yield from out()
        yield from out()

    return run


def _counted(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            names = batch.column("piece").to_pylist()
            yield pa.record_batch([batch.column("piece"), batch.column("freq"), pa.array(enc.counts(names), pa.int64())],
                                  ["piece", "freq", "tokens"])

    return run


def _documents(vocabulary: str, head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cut, known = encoder(vocabulary).chunks, head.value
        row = TaskContext.get().partitionId() << 40

        def out():
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()))]
            return pa.record_batch(arrays, ["row", "doc_id", "n_bytes", "base", "piece", "n"])

        cols: list[list] = [[] for _ in range(6)]
        for batch in batches:
            for doc, size, text in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), _texts(batch)):
                base, rare = 0, []
                for piece, n in Counter(cut(text)).items():
                    tokens = known.get(piece)
                    if tokens is None:
                        rare.append((piece, n))
                    else:
                        base += n * tokens
                # one row for the document itself, of no weight in the join
                rare.append((f"\0{row & 1023}", 0))
                k = len(rare)
                cols[0] += [row] * k
                cols[1] += [doc] * k
                cols[2] += [size] * k
                cols[3] += [0] * (k - 1) + [base]
                cols[4] += [p for p, _ in rare]
                cols[5] += [n for _, n in rare]
                row += 1
                if len(cols[0]) >= ROWS:
                    yield out()
                    cols = [[] for _ in range(6)]
        if cols[0]:
            yield out()

    return run


def _head(counted: DataFrame, most: int) -> dict[str, int]:
    """The tokens of the most frequent pre-tokens, ``most`` at the most.

    The least frequency comes from a histogram of fixed bins, so only these
    entries reach the driver.
    """
    fit = counted.filter(F.length("piece") <= LONGEST).withColumn("bin", F.floor(16 * F.log2("freq")))
    least, total = None, 0
    for row in sorted(fit.groupBy("bin").count().collect(), reverse=True):
        total += row["count"]
        if total > most:
            break
        least = row["bin"]
    if least is None:
        return {}
    top = fit.filter(F.col("bin") >= least).select("piece", "tokens").toPandas()
    return dict(zip(top["piece"].tolist(), top["tokens"].tolist()))


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", head: int = 1 << 17) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of ``docs`` (doc_id, text).

    The counts equal the lengths of the library's own encodings of the whole
    texts. A null text is empty: no bytes, no tokens. Repeated rows are counted
    each for itself, and a null doc_id is kept; other columns are ignored. An
    empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    seen = docs.select("text").mapInArrow(_frequencies(vocabulary), "piece string, freq long")
    seen = seen.groupBy("piece").agg(F.sum("freq").alias("freq"))
    counted = shared_table(seen.mapInArrow(_counted(vocabulary), "piece string, freq long, tokens long"))
    table = docs.sparkSession.sparkContext.broadcast(_head(counted, head))
    sized = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    parts = sized.mapInArrow(_documents(vocabulary, table),
                             "row long, doc_id long, n_bytes long, base long, piece string, n long")
    tokens = F.sum(F.col("base") + F.col("n") * F.coalesce("tokens", F.lit(0)))
    return (parts.join(counted.select("piece", "tokens"), "piece", "left")
            .groupBy("row", "doc_id", "n_bytes").agg(tokens.alias("n_tokens")).drop("row"))
