"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier over hashed words learns from texts confirmed as toxic and from texts without a
label, some of which are toxic too. With the class prior p, the risk of calling a clean text toxic is
that of the unlabelled texts less p times that of the toxic ones; where this estimate falls below
zero, which only overfitting explains, the step goes the other way.

Labels count only where crc32(doc_id) mod 4 is not 2; those rows are held out, and their texts are in
no training set. The training set is bounded: ``POSITIVES`` toxic and ``UNLABELLED`` other texts, the
least by a hash of doc_id. The other texts are drawn from the rows of ``labels`` without looking at
their labels, so that the prior, the toxic share of those rows, is theirs. Only the text enters a score. Null and empty texts get the score of no
words. Without any toxic label all scores are 0. Repeated rows get equal scores; extra columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recfuse.llm.bpe import Remembered
from recfuse.llm.common import pairs_of, texts
from recfuse.llm.linear import SPACE, Rows, descend, sigmoid

POSITIVES = 3000
UNLABELLED = 7000
THRESHOLD = 0.3
#: Features get a weight if so many toxic texts have them, and so many times the estimated share of clean texts.
LEAST_TOXIC = 5
LEAST_LIFT = 4.0
_WORD = re.compile(r"\w+")


def features_of(word: str) -> tuple[int, ...]:
    """Hashes of a lower-case word and of its beginnings, which inflected forms share."""
    parts = [word] + [f"{word[:k]}*" for k in (4, 5) if len(word) > k]
    return tuple(zlib.crc32(p.encode()) % SPACE for p in parts)


def features(text: str, known: Remembered) -> list[int]:
    return [f for w in set(_WORD.findall(text.lower())) for f in known[w]]


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string")) % 4 == 2


def fit(positive: list, unlabelled: list, prior: float, rounds: int = 300, beta: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias from the feature lists of toxic and of unlabelled texts."""
    p, u = len(positive), max(len(unlabelled), 1)
    toxic, other = np.zeros(SPACE), np.zeros(SPACE)
    for rows, found in ((positive, toxic), (unlabelled, other)):
        for row in rows:
            found[np.unique(row)] += 1
    # The unlabelled texts hold the toxic share too: what it explains is no sign that clean texts have a feature.
    clean = np.maximum(other / u - prior * toxic / p, 0) / (1 - prior)
    rows = Rows(positive + unlabelled).only((toxic >= LEAST_TOXIC) & (toxic / p >= LEAST_LIFT * clean))

    def slopes(score: np.ndarray) -> np.ndarray:
        yes = sigmoid(score)
        called = np.logaddexp(0, score)  # loss of calling a text toxic that isn't
        negative = called[p:].sum() / u - prior * called[:p].mean()
        out = np.empty_like(score)
        if negative >= -beta:
            out[:p] = prior * (yes[:p] - 1) / p - prior * yes[:p] / p
            out[p:] = yes[p:] / u
        else:
            out[:p], out[p:] = prior * yes[:p] / p, -yes[p:] / u
        return out

    return descend(rows, slopes, rounds=rounds, rate=0.6)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, float] | None:
    """Weights and bias; None without toxic labels. The sample's features come to the driver, bounded by its rows."""
    known = labels.where(~held_out()).where(F.col("doc_id").isNotNull())
    prior = known.agg(F.avg("toxic")).first()[0]
    toxic = known.where("toxic = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives).withColumn("kind", F.lit(1))
    others = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(unlabelled).withColumn("kind", F.lit(0))

    def run(batches) -> Iterator[pa.RecordBatch]:
        memo = Remembered(features_of)
        for kinds, rows in pairs_of(batches, "kind", "text"):
            found = [np.array(features(t, memo), np.int32) for t in rows]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(found, pa.list_(pa.int32()))], ["kind", "f"])

    sample = texts(docs).join(F.broadcast(toxic.union(others)), "doc_id").select("kind", "text")
    frame = sample.mapInArrow(run, "kind int, f array<int>").toPandas()
    positive, rest = list(frame.f[frame.kind == 1]), list(frame.f[frame.kind == 0])
    return fit(positive, rest, min(max(float(prior), 0.001), 0.999)) if positive else None


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    weights, bias = (model[0].astype(np.float32), model[1]) if model else (np.zeros(SPACE, np.float32), -100.0)

    def run(batches) -> Iterator[pa.RecordBatch]:
        by_word = Remembered(lambda w: float(sum(weights[f] for f in features_of(w))))
        for keys, rows in pairs_of(batches, "doc_id", "text"):
            sums = [sum(map(by_word.__getitem__, set(_WORD.findall(t.lower())))) for t in rows]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sigmoid(np.array(sums, float) + bias))], ["doc_id", "score"])

    out = texts(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
