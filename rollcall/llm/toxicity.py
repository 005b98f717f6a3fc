"""Toxicity by boosted trees over dense features.

The features are densities of a lexicon (stated words, and words and word
beginnings that training rows tie to the label), how near the second person
stands to them, capitals, punctuation and obfuscation. Isotonic regression on
rows that neither the lexicon nor the trees have seen turns the trees' output
into a probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.trees import boost, isotonic
from rollcall.session import shared_table

# Words that insult, and words of the second person.
INSULTS = ("bastard clown coward cretin disgusting dumb fool freak garbage idiot imbecile jerk loser moron pathetic pig "
           "retard scum stupid trash ugly vermin worthless arschloch dumm idiotin trottel connard débile imbécile crétin "
           "basura estúpido imbécil tonto").split()
SECOND = set("you your yours you're ur u du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos "
             "tú ti tus usted ustedes vosotros".split())
_LEET = str.maketrans("0134578@$!|+", "oieastbasiit")
_WORDS = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"(?<![^\W\d_])[^\W\d_]++[\d@$!|+*._-]++[^\W\d_][^\s,;:?]*|[\d@$]++[^\W\d_][^\s,;:?]*")
#: Marks that may follow a plain word.
_AFTER = ".,!?;:%&$#*|)]\"'"
_LETTERS = re.compile(r"[\W\d_]+")
_LONG = re.compile(r"([^\W\d_])\1\1")
_CAPITAL, _SHOUTED, _MARK, _DIGIT = (re.compile(p) for p in ("[A-ZÀ-ÖØ-Þ]", r"\b[A-Z]{3,}\b", r"[^\w\s]", r"\d"))
NEAR = 3
#: What a learnt term needs: toxic training rows, log-odds, and letters at most.
LEAST_BAD, LEAST_ODDS, LONGEST_TERM = 3, 2.5, 64
FEATURES = ("log_words word_density word_hits start_density start_hits stated_density weight near_second second capitals "
            "shouted exclaim question marks digits mixed mixed_hits long_runs").split()


def words_of(text: str) -> tuple[list[str], list[str]]:
    """(plain words, words read from obfuscated spellings), lower-cased."""
    low = text.lower()
    read = []
    doubtful = [t for t in low.split() if not t.isalpha() and not t.rstrip(_AFTER).isalpha()]
    for m in _MIXED.findall(" ".join(doubtful)):
        w = _LETTERS.sub("", m.translate(_LEET))
        if len(w) > 2:
            read.append(w)
    return _WORDS.findall(low), read


def terms_of(text: str) -> set[str]:
    """What the lexicon may learn: words, and beginnings of 4 and 5 letters."""
    plain, read = words_of(text)
    words = {*plain, *read}
    return words | {f"{w[:4]}-" for w in words if len(w) > 4} | {f"{w[:5]}-" for w in words if len(w) > 5}


def split_lexicon(lexicon: dict[str, float]) -> tuple[dict[str, float], dict[str, float]]:
    """(words, word beginnings) with their weights."""
    return ({t: w for t, w in lexicon.items() if t[-1] != "-"}, {t[:-1]: w for t, w in lexicon.items() if t[-1] == "-"})


def features(text: str | None, lexicon: tuple[dict[str, float], dict[str, float]]) -> list[float]:
    """The dense features of a whole text, in the order of ``FEATURES``."""
    text, (words, starts) = text or "", lexicon
    plain, read = words_of(text)
    n, chars, found = max(1, len(plain)), max(1, len(text)), {}
    once = set(plain)
    for w in once:
        start = max(starts.get(w[:5], 0.0) if len(w) > 5 else 0.0, starts.get(w[:4], 0.0) if len(w) > 4 else 0.0)
        if start or w in words:
            found[w] = (w in words, start > 0, max(words.get(w, 0.0), start))
    hits = [i for i, w in enumerate(plain) if w in found] if found else []
    n_word, n_start = sum(found[plain[i]][0] for i in hits), sum(found[plain[i]][1] for i in hits)
    weight = sum(found[plain[i]][2] for i in hits)
    near = sum(not SECOND.isdisjoint(plain[max(0, i - NEAR):i + NEAR + 1]) for i in hits)
    stated = sum(plain[i] in _STATED for i in hits)
    second = 0 if SECOND.isdisjoint(once) else sum(map(SECOND.__contains__, plain))
    return [np.log1p(len(plain)), n_word / n, np.log1p(n_word), n_start / n, np.log1p(n_start), stated / n, weight / n, near / n,
            second / n, len(_CAPITAL.findall(text)) / chars, len(_SHOUTED.findall(text)) / n,
            text.count("!") / n, text.count("?") / n, len(_MARK.findall(text)) / chars, len(_DIGIT.findall(text)) / chars,
            len(read) / n, sum(w in words for w in read) / n, len(_LONG.findall(text)) / n]


_STATED = frozenset(INSULTS)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter

    bad, good = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            (bad if label else good).update(terms_of(text or ""))
    terms = list({*bad, *good})
    for i in range(0, len(terms), 1 << 16):
        part = terms[i:i + (1 << 16)]
        yield pa.record_batch([pa.array(part, pa.string()), pa.array([bad[t] for t in part], pa.int64()),
                               pa.array([good[t] for t in part], pa.int64())], ["term", "bad", "good"])


def _rows(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t, lexicon.value) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "label", "aside")), pa.array(x, pa.list_(pa.float64()))],
                                  ["doc_id", "label", "aside", "x"])

    return run


def _scores(model, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, trees, curve, prior = model.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if trees is None:
                p = np.full(len(texts), prior)
            else:
                x = np.array([features(t, lexicon) for t in texts]).reshape(-1, len(FEATURES))
                p = curve.predict(trees.predict(x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*batch.schema.names, column])

    return run


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, modulus: int, held: int) -> DataFrame:
    """doc_id, text, label of at most ``most`` labelled rows outside the held-out fold.

    Rows are chosen by a hash of doc_id; of a doc_id with several labels the
    largest counts, of one with several texts that of the smallest hash. Null
    labels and doc_ids don't train.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % modulus
    chosen = (labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).dropna()
              .filter(fold != held).groupBy("doc_id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    # at most ``most`` rows of 12 bytes
    found = docs.join(F.broadcast(chosen), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one")
    return found.groupBy("doc_id", "label").agg(one).select("doc_id", F.col("one.text").alias("text"), "label")


def fit(docs: DataFrame, labels: DataFrame, most: int = 20000, lexicon_size: int = 4096, modulus: int = 5, held: int = 0):
    """(lexicon, trees, curve, prior) from at most ``most`` labelled rows.

    Every fourth row, by a hash of its doc_id, is set aside for the curve before
    anything is learnt. The lexicon has the ``lexicon_size`` terms of highest
    odds, of ``LEAST_BAD`` toxic rows and ``LEAST_ODDS`` at least.
    """
    spark = docs.sparkSession
    train = sample_labelled(docs, labels, "toxic", most, modulus, held)
    train = shared_table(train.withColumn("aside", F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(4)) == 3))
    total = {bool(r["label"]): r["count"] for r in train.groupBy("label").count().collect()}
    bad, good = total.get(True, 0), total.get(False, 0)
    if min(bad, good) < 5:  # too few to learn from
        return ({}, {}), None, None, (bad + 0.5) / (bad + good + 1)
    seen = {bool(r["label"]): r["count"] for r in train.filter("not aside").groupBy("label").count().collect()}
    odds = F.log((F.col("bad") + 0.5) / (seen.get(True, 0) + 1)) - F.log((F.col("good") + 0.5) / (seen.get(False, 0) + 1))
    learnt = (train.filter("not aside").mapInArrow(_terms, "term string, bad long, good long").groupBy("term")
              .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).withColumn("weight", odds)
              .filter((F.col("bad") >= LEAST_BAD) & (F.col("weight") >= LEAST_ODDS) & (F.length("term") <= LONGEST_TERM))
              .orderBy(F.desc(F.col("weight") * F.sqrt("bad")), "term").limit(lexicon_size).select("term", "weight").collect())
    lexicon = split_lexicon({**dict.fromkeys(INSULTS, 2.5), **{r["term"]: r["weight"] for r in learnt}})
    rows = train.mapInArrow(_rows(spark.sparkContext.broadcast(lexicon)), "doc_id long, label int, aside boolean, x array<double>").toPandas()
    rows = rows.sort_values("doc_id")
    x, y = np.array(rows["x"].tolist()).reshape(-1, len(FEATURES)), rows["label"].to_numpy(float)
    part = rows["aside"].to_numpy(bool)
    if min(y[part].sum(), (1 - y[part]).sum(), y[~part].sum(), (1 - y[~part]).sum()) < 1:
        part = np.zeros(len(y), bool)
    trees = boost(x[~part], y[~part])
    at = part if part.any() else ~part
    return lexicon, trees, isotonic(trees.predict(x[at]), y[at]), y.mean()


def toxicity(docs: DataFrame, labels: DataFrame, most: int = 20000, modulus: int = 5, held: int = 0) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5 on) of every row of ``docs``.

    Fitted on at most ``most`` rows of ``labels`` (doc_id, toxic) whose
    crc32(doc_id) mod ``modulus`` is not ``held``; scores come from the whole
    texts, however long, alone. Null and empty texts get the score of a text
    without words; repeated rows get equal scores; a null doc_id is kept; other columns are
    ignored. With fewer than five training rows of either label the score is
    their share of toxic rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = with_score(docs, labels, "score", most, modulus, held).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def with_score(docs: DataFrame, labels: DataFrame, column: str, most: int = 20000, modulus: int = 5, held: int = 0) -> DataFrame:
    """All columns of ``docs`` and the score, as ``toxicity`` gives it, in a further one."""
    found = fit(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), labels, most, modulus=modulus, held=held)
    model = docs.sparkSession.sparkContext.broadcast(found)
    return docs.mapInArrow(_scores(model, column), T.StructType([*docs.schema, T.StructField(column, T.DoubleType())]))
