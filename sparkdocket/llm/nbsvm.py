"""Linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's feature is the number of its distinct words that hold an n-gram, so a
word repeated many times speaks once.  Each feature is multiplied by its
log-count ratio between the two labels; a logistic regression with an L2 penalty
is then fitted over the scaled features by full-batch gradient steps (Adam).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from sparkdocket.llm.textfeat import FeatureSpace, WordSums, linear_values


@dataclass
class RatioModel:
    space: FeatureSpace
    weights: np.ndarray
    bias: float

    def scorer(self) -> WordSums:
        return WordSums(self.space, linear_values(self.space, self.weights[:, None]), 2)

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(sums[:, 0] + self.bias, -40, 40)))


def train_ratio_model(
    rows: Sequence[tuple[np.ndarray, np.ndarray]], labels: list, space: FeatureSpace, *, alpha: float = 1.0, l2: float = 5e-3, steps: int = 150, rate: float = 0.05
) -> RatioModel:
    """Fit on sparse rows with labels 0 and 1.

    With one label only, or none, every score is that label's share (0.0 without
    labels, kept away from certainty).
    """
    y = np.array(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
        return RatioModel(space, np.zeros(space.buckets), float(np.log(p / (1 - p))))
    sizes = np.array([len(i) for i, _ in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    idx = np.concatenate([i for i, _ in rows])
    counts = np.concatenate([c for _, c in rows])
    up = alpha + np.bincount(idx, weights=np.minimum(counts, 1) * y[owner], minlength=space.buckets)
    down = alpha + np.bincount(idx, weights=np.minimum(counts, 1) * (1 - y[owner]), minlength=space.buckets)
    ratio = np.log(up / up.sum()) - np.log(down / down.sum())
    x = ratio[idx] * counts
    w, bias = np.zeros(space.buckets), float(np.log(y.mean() / (1 - y.mean())))
    m = v = np.zeros(space.buckets)
    mb = vb = 0.0
    for t in range(1, steps + 1):
        z = np.bincount(owner, weights=x * w[idx], minlength=len(y)) + bias
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        grad = np.bincount(idx, weights=x * err[owner], minlength=space.buckets) + l2 * w
        gb = err.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        fix1, fix2 = 1 - 0.9**t, 1 - 0.99**t
        w = w - rate * (m / fix1) / (np.sqrt(v / fix2) + 1e-6) * min(1.0, 2 * (1 - t / (steps + 1)))
        bias -= rate * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-6)
    return RatioModel(space, w * ratio, bias)
