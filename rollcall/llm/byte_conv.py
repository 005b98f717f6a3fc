"""Quality by a small convolutional network over bytes, in numpy.

Bytes are embedded; filters slide over windows of them; the largest response
of each filter in a chunk is kept. Chunks overlap and cover the whole text,
and the largest and the mean of their responses give one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.toxicity import sample_labelled
from rollcall.llm.trees import sigmoid
from rollcall.session import shared_table

#: Bytes of a window and of its step; windows of a segment; segments of a chunk and of its step.
WIDTH, STEP, SEGMENT, CHUNK, STRIDE = 8, 4, 16, 4, 3
DIM, FILTERS = 8, 16
#: Windows computed at once, a multiple of SEGMENT.
PIECE = 1 << 14
#: Byte value that fills up short texts; it is in no UTF-8 text.
PAD = 255


@dataclass
class Net:
    embed: np.ndarray    # (256, DIM)
    filters: np.ndarray  # (WIDTH * DIM, FILTERS)
    bias: np.ndarray     # (FILTERS,)
    out: np.ndarray      # (2 * FILTERS,)
    base: np.ndarray     # (1,)

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.base]


def new_net(seed: int = 7) -> Net:
    r = np.random.default_rng(seed)
    f4 = np.float32
    return Net(r.normal(0, 0.5, (256, DIM)).astype(f4), r.normal(0, 0.15, (WIDTH * DIM, FILTERS)).astype(f4),
               np.zeros(FILTERS, f4), r.normal(0, 0.1, 2 * FILTERS).astype(f4), np.zeros(1, f4))


def bytes_of(text: str | None) -> np.ndarray:
    """The UTF-8 bytes, filled up to whole windows."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    windows = max(1, -(-(len(raw) - WIDTH) // STEP) + 1)
    return np.concatenate([raw, np.full((windows - 1) * STEP + WIDTH - len(raw), PAD, np.uint8)])


def _windows(x: np.ndarray) -> np.ndarray:
    """(windows, WIDTH) byte values."""
    return np.lib.stride_tricks.sliding_window_view(x, WIDTH)[::STEP]


def segments(net: Net, x: np.ndarray, places: bool = False):
    """Largest response of each filter per segment, and the windows where."""
    w, best, where = _windows(x), [], []
    for i in range(0, len(w), PIECE):
        part = w[i:i + PIECE]
        y = net.embed[part].reshape(len(part), WIDTH * DIM) @ net.filters
        starts = np.arange(0, len(part), SEGMENT)
        best.append(np.maximum.reduceat(y, starts, axis=0))
        if places:
            full = np.full((len(starts) * SEGMENT, FILTERS), -np.inf, np.float32)
            full[:len(y)] = y
            where.append(full.reshape(len(starts), SEGMENT, FILTERS).argmax(1) + starts[:, None] + i)
    top = np.maximum(np.concatenate(best) + net.bias, 0)
    return (top, np.concatenate(where)) if places else top


def _chunk_rows(n: int) -> np.ndarray:
    """(chunks, CHUNK) segments; the last chunk may repeat the last segment."""
    count = max(1, -(-(n - CHUNK) // STRIDE) + 1)
    return np.minimum(np.arange(count)[:, None] * STRIDE + np.arange(CHUNK), n - 1)


def logit(net: Net, x: np.ndarray) -> float:
    top = segments(net, x)
    chunks = top[_chunk_rows(len(top))].max(1)
    return float(np.concatenate([chunks.max(0), chunks.mean(0)]) @ net.out + net.base[0])


def _gradients(net: Net, x: np.ndarray, label: float) -> list[np.ndarray]:
    """Gradients of the log loss; only windows that won a pool have any."""
    top, where = segments(net, x, places=True)
    rows = _chunk_rows(len(top))
    view = top[rows]
    pick = view.argmax(1)
    f = np.arange(FILTERS)
    chunks = view.max(1)
    won = where[rows[np.arange(len(rows))[:, None], pick], f]
    best = chunks.argmax(0)
    pooled = np.concatenate([chunks[best, f], chunks.mean(0)])
    err = float(sigmoid(np.array(pooled @ net.out + net.base[0])) - label)
    g = np.tile(err * net.out[FILTERS:] / len(chunks), (len(chunks), 1))
    g[best, f] += err * net.out[:FILTERS]
    g = np.where(chunks > 0, g, 0).astype(np.float32)
    c, k = np.nonzero(g)
    gv, seen = g[c, k], _windows(x)[won[c, k]]
    d_filters = np.zeros_like(net.filters)
    embedded = net.embed[seen].reshape(len(c), WIDTH * DIM) * gv[:, None]
    for j in range(FILTERS):
        d_filters[:, j] = embedded[k == j].sum(0)
    d_embed = np.zeros_like(net.embed)
    np.add.at(d_embed, seen.ravel(), (net.filters.T[k] * gv[:, None]).reshape(-1, DIM))
    return [d_embed, d_filters, g.sum(0), (err * pooled).astype(np.float32), np.array([err], np.float32)]


def train(texts: list[str | None], labels: np.ndarray, epochs: int | None = None, batch: int = 16, rate: float = 0.02, seed: int = 7) -> Net:
    """Adam on whole texts; by default 6 to 20 passes, more over fewer texts."""
    epochs = epochs or max(6, min(20, 24_000 // len(texts)))
    net, order = new_net(seed), np.random.default_rng(seed)
    share = np.clip(labels.mean(), 0.01, 0.99)
    net.base[0] = np.log(share / (1 - share))
    data = [bytes_of(t) for t in texts]
    m, v, step = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    for epoch in range(epochs):
        rows = order.permutation(len(data))
        for i in range(0, len(rows), batch):
            some = rows[i:i + batch]
            total = None
            for r in some:
                g = _gradients(net, data[r], labels[r])
                total = g if total is None else [a + b for a, b in zip(total, g)]
            step += 1
            now = rate * (1 - epoch / epochs) + 1e-4
            for p, a, b, g in zip(net.parts(), m, v, total):
                g = g / len(some)
                a *= 0.9
                a += 0.1 * g
                b *= 0.99
                b += 0.01 * g * g
                p -= (now * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return net


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, prior = model.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if net is None:
                p = np.full(len(texts), prior)
            else:
                p = sigmoid(np.array([logit(net, bytes_of(t)) for t in texts]))
            yield pa.record_batch([batch.column("doc_id"), pa.array(p, pa.float64())], ["doc_id", "score"])

    return run


def training_rows(docs: DataFrame, labels: DataFrame, most: int, most_bytes: int, modulus: int, held: int):
    """Labelled rows as a pandas frame: in the order of a hash of doc_id, while their texts hold ``most_bytes`` together."""
    rows = shared_table(sample_labelled(docs, labels, "quality", most, modulus, held))
    sizes = rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.xxhash64("doc_id").alias("place")).toPandas()
    sizes = sizes.sort_values(["place", "doc_id"])
    chosen = sizes.loc[sizes["size"].cumsum() <= most_bytes, "doc_id"].tolist()
    wanted = docs.sparkSession.createDataFrame([(int(v),) for v in chosen], "doc_id long")
    return rows.join(F.broadcast(wanted), "doc_id").toPandas().sort_values("doc_id")  # ``most`` ids


def quality(docs: DataFrame, labels: DataFrame, most: int = 4000, modulus: int = 4, held: int = 2, most_bytes: int = 64 << 20) -> DataFrame:
    """doc_id and score (0 to 1; higher: label 1 likelier) of every row of ``docs``.

    The network learns from at most ``most`` rows of ``labels`` (doc_id,
    quality) whose crc32(doc_id) mod ``modulus`` is not ``held``, of
    ``most_bytes`` together, and reads nothing but the bytes of whole texts. A null or empty text is one window of
    filling; repeated rows get equal scores; a null doc_id is kept; other
    columns are ignored. With fewer than five training rows of either label
    every score is their share of label 1.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = training_rows(docs, labels, most, most_bytes, modulus, held)
    y = rows["label"].to_numpy(float)
    if min(y.sum(), (1 - y).sum()) < 5:
        model = (None, (y.sum() + 0.5) / (len(y) + 1))
    else:
        model = (train(rows["text"].tolist(), y), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_scores(shared), "doc_id long, score double")
