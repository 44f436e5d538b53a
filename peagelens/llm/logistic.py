"""Penalised logistic regression on a bounded sample, fitted in the driver with numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40.0, 40.0)))


def minimise(
    loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int = 200, memory: int = 8
) -> np.ndarray:
    """Limited-memory quasi-Newton descent of a smooth convex loss (value and gradient)."""
    x, (value, slope) = start, loss(start)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        way, used = slope.copy(), []
        for s, g, r in reversed(moves):
            a = r * (s @ way)
            used.append(a)
            way -= a * g
        if moves:
            s, g, _ = moves[-1]
            way *= (s @ g) / (g @ g)
        for (s, g, r), a in zip(moves, reversed(used)):
            way += (a - r * (g @ way)) * s
        step, drop = 1.0, slope @ way
        while step > 1e-10:
            nx = x - step * way
            nvalue, nslope = loss(nx)
            if nvalue <= value - 1e-4 * step * drop:
                break
            step /= 2
        else:
            return x
        s, g = nx - x, nslope - slope
        if s @ g > 1e-12:
            moves = [*moves[1 - memory :], (s, g, 1.0 / (s @ g))]
        done = value - nvalue < 1e-9 * max(1.0, abs(value))
        x, value, slope = nx, nvalue, nslope
        if done:
            return x
    return x


def fit_sparse(
    rows: np.ndarray, cols: np.ndarray, values: np.ndarray, target: np.ndarray, weight: np.ndarray,
    n_features: int, penalty: float,
) -> tuple[np.ndarray, float]:
    """(weights, intercept) for entries (row, column, value); target lies in 0..1.

    The penalty is half the squared length of the weights, times ``penalty``; the
    intercept is free. No rows give zero weights.
    """
    n = len(target)
    if not n:
        return np.zeros(n_features), 0.0
    weight = weight / weight.sum()

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = x[:-1], x[-1]
        z = np.bincount(rows, weights=w[cols] * values, minlength=n) + b
        value = weight @ (np.logaddexp(0.0, z) - target * z) + 0.5 * penalty * (w @ w)
        miss = weight * (sigmoid(z) - target)
        grad = np.bincount(cols, weights=miss[rows] * values, minlength=n_features) + penalty * w
        return value, np.append(grad, miss.sum())

    x = minimise(loss, np.zeros(n_features + 1))
    return x[:-1], float(x[-1])


def fit_differences(better: np.ndarray, worse: np.ndarray, penalty: float) -> np.ndarray:
    """Bradley-Terry weights: the chance that a row of ``better`` wins is the logistic
    function of the weighted difference of the features."""
    gap = better - worse

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = gap @ w
        return (
            float(np.logaddexp(0.0, -z).mean() + 0.5 * penalty * (w @ w)),
            -(sigmoid(-z) @ gap) / len(gap) + penalty * w,
        )

    return minimise(loss, np.zeros(gap.shape[1])) if len(gap) else np.zeros(gap.shape[1])
