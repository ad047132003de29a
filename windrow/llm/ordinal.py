"""Cumulative-link ordinal regression on sparse rows, by L-BFGS.

P(grade >= k) = logistic(score - cut k); one weight a feature is shared by both thresholds. The loss is the weighted
negative log likelihood plus the sum of precision * weight^2 / 2: a prior about zero.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def severity(scores: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Expected grade: the sum of the probabilities to reach each threshold."""
    return logistic(scores[:, None] - cuts[None, :]).sum(axis=1)


def minimize(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 120, memory: int = 8, tolerance: float = 1e-4) -> np.ndarray:
    """The minimum of a smooth function that returns its value and gradient."""
    value, grad = loss(x)
    pairs: deque[tuple[np.ndarray, np.ndarray, float]] = deque(maxlen=memory)
    for _ in range(steps):
        if np.abs(grad).max(initial=0) < tolerance * max(1.0, abs(value)):
            break
        way, used = grad.copy(), []
        for s, y, r in reversed(pairs):
            a = r * (s @ way)
            used.append(a)
            way -= a * y
        if pairs:
            s, y, _ = pairs[-1]
            way *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(pairs, reversed(used), strict=True):
            way += s * (a - r * (y @ way))
        slope = grad @ way
        if slope <= 0:
            way, slope = grad.copy(), grad @ grad
            pairs.clear()
        pace = 1.0 if pairs else 1.0 / max(1.0, np.sqrt(slope))
        for _ in range(30):
            there, (value_there, grad_there) = x - pace * way, loss(x - pace * way)
            if value_there <= value - 1e-4 * pace * slope:
                break
            pace /= 2
        else:
            break
        s, y = there - x, grad_there - grad
        if s @ y > 1e-12:
            pairs.append((s, y, 1 / (s @ y)))
        x, value, grad = there, value_there, grad_there
    return x


def fit_ordinal(places: np.ndarray, ends: np.ndarray, grades: np.ndarray, weights: np.ndarray, precision: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Weights of the features 0..n-1, then the two cuts.

    Row i has the features places[ends[i]:ends[i + 1]], each counted as often as it is there; grades are 0, 1 or 2; precision is that of each feature's prior.
    """
    n = len(precision)
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, cut, gap = x[:n], x[n], np.exp(np.clip(x[n + 1], -6, 6))
        s = np.bincount(row, w[places], len(ends) - 1)
        p1, p2 = logistic(s - cut), logistic(s - cut - gap)
        at = [1 - p1, p1 - p2, p2]
        value = -(weights * np.log(np.maximum(np.choose(grades, at), 1e-12))).sum() + (precision * w * w).sum() / 2 + (x[n] - 2.0) ** 2 / 50 + x[n + 1] ** 2 / 8
        between = np.maximum(p1 - p2, 1e-12)
        d1 = np.choose(grades, [-p1, p1 * (1 - p1) / between, 0 * p1]) * weights
        d2 = np.choose(grades, [0 * p1, -p2 * (1 - p2) / between, 1 - p2]) * weights
        grad = np.empty_like(x)
        grad[:n] = precision * w - np.bincount(places, (d1 + d2)[row], n)
        grad[n] = (d1 + d2).sum() + (x[n] - 2.0) / 25
        grad[n + 1] = d2.sum() * gap + x[n + 1] / 4
        return value, grad

    x = minimize(loss, np.concatenate([np.zeros(n), [2.0, 0.0]]) if start is None else start)
    return np.concatenate([x[:n], [x[n], x[n] + np.exp(np.clip(x[n + 1], -6, 6))]])
