"""Least squares from centred cross-products: helpers that run on one row per model."""

from __future__ import annotations

import math

import numpy as np

TOLERANCE = 1e-9


def solve_centred(cross: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Coefficients, inverse and kept columns; a column explained by earlier ones is left out.

    Columns enter in order by sweeping, so collinear later columns drop, constant ones too.
    """
    p = len(xy)
    a = np.zeros((p + 1, p + 1))
    a[:p, :p], a[:p, p], a[p, :p] = cross, xy, xy
    start = np.diag(cross).copy()
    kept: list[int] = []
    for j in range(p):
        pivot = a[j, j]
        if start[j] <= 0 or pivot <= TOLERANCE * start[j]:
            continue
        row = a[j] / pivot
        column = a[:, j].copy()
        a = a - np.outer(column, row)
        a[j] = row
        a[:, j] = -column / pivot
        a[j, j] = 1 / pivot
        kept.append(j)
    beta, inverse = np.zeros(p), np.zeros((p, p))
    beta[kept] = a[kept, p]
    inverse[np.ix_(kept, kept)] = a[np.ix_(kept, kept)]
    return beta, inverse, kept


def two_sided_p(t: float, df: int) -> float:
    """Two-sided p-value of Student's t for whole degrees of freedom (finite trigonometric series)."""
    if df <= 0 or not math.isfinite(t):
        return 0.0 if df > 0 else float("nan")
    angle = math.atan(abs(t) / math.sqrt(df))
    cos2 = math.cos(angle) ** 2
    odd = df % 2
    if df == 1:
        inside = 2 * angle / math.pi
    else:
        term = math.cos(angle) if odd else 1.0
        series = term
        for i in range(3 if odd else 2, df - 1, 2):
            term *= cos2 * (i - 1) / i
            series += term
        inside = math.sin(angle) * series
        if odd:
            inside = 2 / math.pi * (angle + inside)
    return min(1.0, max(0.0, 1.0 - inside))
