"""Logistic regression on bounded samples, for operators 3 and 4."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(z, float)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 25, rows: int = 4096) -> np.ndarray:
    """Coefficients, the constant last, by Newton steps with an L2 penalty (none on the constant). `rows` at a time are taken up, so that no copy of all is made."""
    weight = np.ones(len(x)) if weight is None else weight
    size = x.shape[1] + 1
    penalty = np.diag([ridge] * (size - 1) + [1e-6])
    beta = np.zeros(size)
    for _ in range(steps):
        gradient, curve = penalty @ beta, penalty.copy()
        for s in range(0, len(x), rows):
            part = np.column_stack([x[s : s + rows].astype(float), np.ones(len(x[s : s + rows]))])
            w, p = weight[s : s + rows], sigmoid(part @ beta)
            gradient += part.T @ (w * (p - y[s : s + rows]))
            curve += (part * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ part
        step = np.linalg.solve(curve, gradient)
        scale = min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        beta = beta - scale * step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def predict(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return sigmoid(x @ beta[:-1] + beta[-1])
