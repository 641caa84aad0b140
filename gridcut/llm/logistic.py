"""Logistic regression for calibrating a handful of features, by Newton's method."""

from __future__ import annotations

import numpy as np


def fit(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights, the constant first. With one class or no rows the constant alone tells the share."""
    x = np.column_stack([np.ones(len(labels)), features]) if len(labels) else np.zeros((0, features.shape[1] + 1))
    w = np.zeros(x.shape[1])
    if not len(labels) or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        w[0] = np.log(share / (1 - share))
        return w
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (labels - p) - ridge * w
        bend = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def chance(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = weights[0] + features @ weights[1:] if len(features) else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))
