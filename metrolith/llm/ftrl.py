"""Follow-the-regularised-leader (proximal) with elastic-net penalties."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Weights of shape (features, outputs) learned one sparse row at a time.

    ``l1`` keeps weights at exactly zero until their evidence exceeds it, ``l2``
    shrinks the rest; each coordinate has its own learning rate.
    """

    def __init__(self, features: int, outputs: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.05):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((features, outputs))
        self.n = np.zeros((features, outputs))

    def at(self, rows) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, rows: np.ndarray, w: np.ndarray, gradient: np.ndarray) -> None:
        n = self.n[rows]
        more = n + gradient * gradient
        self.z[rows] += gradient - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[rows] = more

    def weights(self) -> np.ndarray:
        return self.at(slice(None))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def multinomial(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, features: int, outputs: int, epochs: int = 3, seed: int = 7, **options) -> np.ndarray:
    """Multinomial logistic regression; the last feature row is the intercept."""
    model, order = Ftrl(features + 1, outputs, **options), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, features), np.append(x, 1.0)
            w = model.at(at)
            p = softmax(x @ w)
            p[labels[i]] -= 1
            model.update(at, w, x[:, None] * p)
    return model.weights()


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least negative log-likelihood.

    Targets are smoothed by one part in n + 2, so that a sample without an error
    doesn't ask for certainty."""
    n, k = logits.shape
    if not n or k < 2:
        return 1.0
    grid, loose = np.geomspace(0.05, 50, 141), 1 / (n + 2)
    target = np.full((n, k), loose / (k - 1))
    target[np.arange(n), labels] = 1 - loose
    loss = [-np.mean((target * np.log(np.maximum(softmax(logits / t), 1e-12))).sum(axis=1)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def cumulative_link(rows: list[np.ndarray], grades: np.ndarray, levels: int, features: int, weight: np.ndarray, epochs: int = 3, rate: float = 0.2, seed: int = 7, **options) -> tuple[np.ndarray, np.ndarray]:
    """Proportional odds: P(grade <= k) = sigmoid(threshold[k] - w.x) with one
    weight vector for all thresholds; binary features. Returns (w, thresholds)."""
    model, order = Ftrl(features, 1, **options), np.random.default_rng(seed)
    share = np.cumsum([weight[grades == k].sum() for k in range(levels)])[:-1] / weight.sum()
    cut = np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4)))
    cut = np.maximum.accumulate(cut + 1e-3 * np.arange(levels - 1))
    moved = np.ones(levels - 1)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, y = rows[i], grades[i]
            w = model.at(at)
            s = w.sum()
            hi = _sigmoid(cut[y] - s) if y < levels - 1 else 1.0
            lo = _sigmoid(cut[y - 1] - s) if y else 0.0
            p = max(hi - lo, 1e-9)
            up, down = hi * (1 - hi), lo * (1 - lo)
            model.update(at, w, np.full((at.size, 1), weight[i] * (up - down) / p))
            for k, g in ((y, -up / p), (y - 1, down / p)):
                if 0 <= k < levels - 1:
                    g *= weight[i]
                    moved[k] += g * g
                    cut[k] -= rate * g / np.sqrt(moved[k])
            cut = np.maximum.accumulate(cut)
    return model.weights()[:, 0], cut


def grade_probabilities(score: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """P(grade = k) for each score, one column per grade."""
    below = _sigmoid(cut[None, :] - score[:, None])
    full = np.concatenate([np.zeros((score.size, 1)), below, np.ones((score.size, 1))], axis=1)
    return np.diff(full, axis=1)
