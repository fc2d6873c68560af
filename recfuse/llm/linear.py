"""Linear classifiers over hashed sparse features, trained with numpy on a bounded sample."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Size of the hashed feature space; the weights, 4 bytes each, are what tasks are sent.
SPACE = 1 << 18


class Rows:
    """Sparse rows of features that are there once each."""

    def __init__(self, lists: list):
        self.sizes = np.array([len(x) for x in lists], np.int64)
        self.index = np.concatenate([np.asarray(x, np.int64) for x in lists]) if len(lists) else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(lists)), self.sizes)

    def __len__(self) -> int:
        return len(self.sizes)

    def only(self, keep: np.ndarray) -> Rows:
        """The same rows with the features for which ``keep`` holds."""
        out = object.__new__(Rows)
        at = keep[self.index]
        out.index, out.row = self.index[at], self.row[at]
        out.sizes = np.bincount(out.row, minlength=len(self.sizes))
        return out

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.row, weights=weights[self.index], minlength=len(self)) + bias

    def back(self, slopes: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, weights=slopes[self.row], minlength=SPACE)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def descend(rows: Rows, slopes: Callable[[np.ndarray], np.ndarray], rounds: int = 60, rate: float = 0.3, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by adaptive full-batch steps. slopes: of the risk by each row's score."""
    weights, bias = np.zeros(SPACE), 0.0
    seen, seen_bias = np.full(SPACE, 1e-8), 1e-8
    for _ in range(rounds):
        slope = slopes(rows.scores(weights, bias))
        step, step_bias = rows.back(slope) + decay * weights, slope.sum()
        seen, seen_bias = seen + step**2, seen_bias + step_bias**2
        weights, bias = weights - rate * step / np.sqrt(seen), bias - rate * step_bias / np.sqrt(seen_bias)
    return weights, bias


def logistic(rows: Rows, labels: np.ndarray, **options) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression in which both classes count alike."""
    ones = max(labels.sum(), 1)
    share = np.where(labels == 1, 0.5 / ones, 0.5 / max(len(labels) - ones, 1))
    return descend(rows, lambda s: share * (sigmoid(s) - labels), **options)
