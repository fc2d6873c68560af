"""Quality scores by co-training of a text view and a page view.

The text view sees hashed words; the page view sees where a page comes from and how it is laid out:
source, language, and steps of its length, lines, capitals, digits and signs. Both start from the
same labelled texts. In each round each view labels the unlabelled texts that it is surest of, as
many of each class as ``ADDED`` times the class's share, for the other view. At last each view is
calibrated by a logistic fit on labelled texts it wasn't trained on, and the score adds their logits.

Labels count only where crc32(doc_id) mod 4 is not 2. The training sets are bounded: ``LABELLED`` and
``UNLABELLED`` texts, the least by a hash of doc_id. Null and empty texts are scored by their page
view and no words. Without labels of both classes all scores are 0.5. Repeated rows get equal scores.
Missing source, lang are features of their own; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recfuse.llm.bpe import Remembered
from recfuse.llm.common import pairs_of, texts
from recfuse.llm.linear import SPACE, Rows, logistic, sigmoid
from recfuse.llm.toxicity import held_out

LABELLED = 4000
UNLABELLED = 6000
ROUNDS = 3
ADDED = 600
THRESHOLD = 0.5
_LETTERS_OUT = str.maketrans("", "", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CAPITALS_OUT = str.maketrans("", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")

View = tuple[np.ndarray, float, float, float]


def _hash(s: str) -> int:
    return zlib.crc32(s.encode()) % SPACE


def word_features(word: str) -> tuple[int, ...]:
    """A word as it is, and its signs if it ends in some."""
    tail = word.lstrip("".join(c for c in word if c.isalnum())) if not word.isalnum() else ""
    return (_hash(word), _hash(f"~{tail}"), _hash("^")) if tail else (_hash(word), _hash("^")) if word.isupper() else (_hash(word),)


def page_features(source, lang, text: str) -> list[int]:
    n, lines = len(text) + 1, text.count("\n") + 1
    kept = len(text.translate(_LETTERS_OUT)) - text.count(" ")
    capitals = len(text) - len(text.translate(_CAPITALS_OUT))
    step = lambda share: int(12 * math.sqrt(max(share, 0)))
    parts = {"s": source, "l": lang, "n": int(2 * math.log2(n)), "li": int(2 * math.log2(n / lines)), "k": step(kept / n), "c": step(capitals / n)}
    return [_hash(f"{k}={v}") for k, v in parts.items()] + [_hash(f"{lang}:k={parts['k']}:c={parts['c']}")]


def _views(frame: DataFrame, *also: str) -> DataFrame:
    """The named columns with the features (words, page) of each row."""
    kinds = {n: t for n, t in frame.dtypes}

    def run(batches) -> Iterator[pa.RecordBatch]:
        known = Remembered(word_features)
        for batch in batches:
            out: list[list] = [[], []]
            for text, source, lang in zip(*(batch.column(c).to_pylist() for c in ("text", "source", "lang")), strict=True):
                out[0].append(list({f for w in set(text.split()) for f in known[w]}))
                out[1].append(page_features(source, lang, text))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in also), *(pa.array(o, pa.list_(pa.int32())) for o in out)], [*also, "words", "page"])

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in also), "words array<int>, page array<int>"])
    return frame.mapInArrow(run, schema)


def _surest(score: np.ndarray, free: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the surest free rows of both classes and their labels."""
    order = np.flatnonzero(free)[np.argsort(score[free], kind="stable")]
    low, high = max(1, round(ADDED * (1 - share))), max(1, round(ADDED * share))
    low, high = order[: min(low, len(order) // 2)], order[len(order) - min(high, len(order) // 2) :]
    return np.concatenate([low, high]), np.concatenate([np.zeros(len(low)), np.ones(len(high))])


def co_train(labelled: dict[str, list], labels: np.ndarray, unlabelled: dict[str, list], rounds: int = ROUNDS) -> dict[str, View]:
    """For each view: weights, bias, and slope and shift of its calibration."""
    fold = np.arange(len(labels)) % 4 == 3
    share, names = labels.mean(), list(labelled)
    own = {v: ([x for x, f in zip(labelled[v], fold, strict=True) if not f], labels[~fold]) for v in names}
    added = {v: (np.zeros(0, int), np.zeros(0)) for v in names}
    fitted: dict[str, tuple[np.ndarray, float]] = {}
    for turn in range(rounds + 1):
        for v in names:
            at, what = added[v]
            fitted[v] = logistic(Rows(own[v][0] + [unlabelled[v][i] for i in at]), np.concatenate([own[v][1], what]))
        if turn < rounds:
            for v, w in (names, names[::-1]):
                free = np.ones(len(unlabelled[v]), bool)
                free[added[w][0]] = False
                at, what = _surest(Rows(unlabelled[v]).scores(*fitted[v]), free, share)
                added[w] = np.concatenate([added[w][0], at]), np.concatenate([added[w][1], what])
    out = {}
    for v in names:
        score = Rows([x for x, f in zip(labelled[v], fold, strict=True) if f]).scores(*fitted[v])
        slope, shift = 1.0, 0.0
        for _ in range(200):  # a logistic fit of two numbers
            error = sigmoid(slope * score + shift) - labels[fold]
            slope, shift = slope - 0.2 * ((error * score).mean() + 0.01 * (slope - 1)), shift - 0.2 * error.mean()
        out[v] = (*fitted[v], slope, shift)
    return out


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> dict[str, View] | None:
    """The calibrated views; None without both classes. The sample's features come to the driver, bounded by its rows."""
    known = labels.where(~held_out()).where("quality IS NOT NULL").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    marked = known.select("doc_id", F.col("quality").cast("int").alias("y"))
    others = docs.where(~held_out()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(unlabelled)
    picked = marked.union(others.select("doc_id", F.lit(-1).alias("y")))
    frame = _views(texts(docs, "source", "lang").join(F.broadcast(picked), "doc_id"), "doc_id", "y").toPandas().sort_values(["y", "doc_id"])
    split = {known: {v: list(frame[v][(frame.y >= 0) == known]) for v in ("words", "page")} for known in (True, False)}
    y = frame.y[frame.y >= 0].to_numpy(float)
    if len(set(y)) < 2:
        return None
    mixed = np.random.default_rng(0).permutation(len(y))
    return co_train({v: [x[i] for i in mixed] for v, x in split[True].items()}, y[mixed], split[False])


def score(docs: DataFrame, model: dict[str, View] | None) -> DataFrame:
    """doc_id, held_out, text_score, page_score, score, predicted, kept of every whole text."""
    views = {v: (m[0].astype(np.float32), *m[1:]) for v, m in (model or {}).items()}

    def run(batches) -> Iterator[pa.RecordBatch]:
        known = Remembered(word_features)
        for keys, rows, sources, langs in pairs_of(batches, "doc_id", "text", "source", "lang"):
            logits = []
            for text, source, lang in zip(rows, sources, langs, strict=True):
                found = {"words": list({f for w in set(text.split()) for f in known[w]}), "page": page_features(source, lang, text)}
                one = []
                for v in ("words", "page"):
                    weights, bias, slope, shift = views.get(v, (np.zeros(SPACE, np.float32), 0.0, 0.0, 0.0))
                    one.append(slope * (float(weights[found[v]].sum()) + bias) + shift)
                logits.append(one)
            a = np.array(logits).reshape(-1, 2)
            columns = [sigmoid(a[:, 0]), sigmoid(a[:, 1]), sigmoid(a.sum(axis=1))]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *map(pa.array, columns)], ["doc_id", "text_score", "page_score", "score"])

    out = texts(docs, "source", "lang").mapInArrow(run, "doc_id long, text_score double, page_score double, score double")
    good = F.col("score") >= THRESHOLD
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text_score", "page_score", "score", good.cast("int").alias("predicted"), good.alias("kept"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
