"""Small logistic fits on the driver, over samples of a stated bound or over counts."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def ridge(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 60, counts: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic model; the first is the intercept. Columns are scaled inside; steps are damped.

    With ``counts``, each row stands for so many.
    """
    if counts is None:
        mean, spread, counts = x.mean(axis=0), x.std(axis=0), 1.0
    else:
        mean = np.average(x, axis=0, weights=counts)
        spread = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=counts))
    scale = np.maximum(spread, 1e-9)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    hold = np.full(len(w), penalty)
    hold[0] = 1e-3
    for _ in range(rounds):
        p = sigmoid(z @ w)
        step = np.linalg.solve((z * (counts * p * (1 - p))[:, None]).T @ z + np.diag(hold), z.T @ (counts * (p - y)) + hold * w)
        w = w - step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    out = w.copy()
    out[1:] = w[1:] / scale
    out[0] = w[0] - (w[1:] / scale) @ mean
    return out


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 800) -> np.ndarray:
    """As ``ridge`` with an absolute penalty, by accelerated proximal gradient steps; many weights become zero."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    rate = 4 * len(x) / max(np.linalg.norm(z.T @ z, 2), 1e-9) / len(x)
    w = v = np.zeros(z.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = v - rate * (z.T @ (sigmoid(z @ v) - y))
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    out = w.copy()
    out[1:] = w[1:] / scale
    out[0] = w[0] - (w[1:] / scale) @ mean
    return out
