"""Supervised subword embeddings: averaged hashed vectors with a softmax on top.

Each feature (word, pair of words or character n-gram) has a learned vector; a text is the mean
of its features' vectors and a linear softmax gives the classes.  Training is
plain stochastic gradient descent in numpy on a bounded sample.  For scoring,
vectors and output layer fold into one table of logits per feature.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from sparkdocket.llm.textfeat import FeatureSpace, WordSums, linear_values


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class SubwordModel:
    """Folded model: logits per feature, bias, temperature and class names."""

    space: FeatureSpace
    classes: list
    logits: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def scorer(self) -> WordSums:
        repeat = np.append(self.logits[0], 1.0) if self.space.repeats else None
        return WordSums(self.space, linear_values(self.space, self.logits), self.logits.shape[1] + 1, repeat, self.logits if self.space.bigrams else None)

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        """Class probabilities from a text's sums; without features, the bias alone speaks."""
        mean = sums[:, :-1] / np.maximum(sums[:, -1:], 1)
        return softmax((mean + self.bias) / self.temperature)

    def of_rows(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        z = np.array([(self.logits[i] * (c / c.sum())[:, None]).sum(0) if len(i) else np.zeros(len(self.classes)) for i, c in rows])
        return softmax((z + self.bias) / self.temperature)


def train_subword(
    rows: Sequence[tuple[np.ndarray, np.ndarray]],
    labels: list,
    space: FeatureSpace,
    *,
    dim: int = 16,
    epochs: int = 12,
    rate: float = 0.5,
    seed: int = 11,
    balance: float = 0.5,
    held: np.ndarray | None = None,
) -> SubwordModel:
    """Stochastic gradient descent, one text at a time, with a linearly falling rate.

    ``balance`` weighs classes by (their share) ** -balance.  The rows ``held`` back
    (a fifth where not given) fit the softmax temperature.  Without labels the model
    has one class ``None`` and says nothing.
    """
    classes = sorted(set(labels), key=str)
    if not classes:
        return SubwordModel(space, [None], np.zeros((space.buckets, 1)), np.zeros(1))
    rng = np.random.default_rng(seed)
    y = np.array([classes.index(v) for v in labels])
    share = np.bincount(y, minlength=len(classes)) / len(y)
    weight = share ** -balance
    weight /= (weight * share).sum()
    vectors = rng.uniform(-1 / dim, 1 / dim, (space.buckets, dim))
    out, bias = np.zeros((dim, len(classes))), np.zeros(len(classes))
    held = np.arange(len(rows)) % 5 == 4 if held is None else held
    enough = len(rows) >= 50 and held.any()
    train = np.nonzero(~held)[0] if enough else np.arange(len(rows))
    total, done = epochs * len(train), 0
    for _ in range(epochs):
        for k in rng.permutation(train):
            idx, cnt = rows[k]
            lr = rate * (1 - done / total)
            done += 1
            if not len(idx):
                continue
            share_of = cnt / cnt.sum()
            hidden = share_of @ vectors[idx]
            grad = softmax(hidden @ out + bias)
            grad[y[k]] -= 1
            grad *= weight[y[k]]
            back = out @ grad
            out -= lr * np.outer(hidden, grad)
            bias -= lr * 0.1 * grad
            # The mean spreads the gradient over very many features; scale it back by their spread.
            vectors[idx] -= (lr / np.sqrt((share_of**2).sum())) * np.outer(share_of, back)
    model = SubwordModel(space, classes, vectors @ out, bias)
    check = np.nonzero(held)[0] if enough else train
    p = np.log(np.maximum(model.of_rows([rows[k] for k in check]), 1e-12))
    losses = {t: -np.log(np.maximum(softmax(p / t)[np.arange(len(check)), y[check]], 1e-12)).mean() for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0)}
    model.temperature = min(losses, key=losses.get)
    return model
