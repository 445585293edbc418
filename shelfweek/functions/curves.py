"""Small numeric helpers used inside grouped tasks."""

from __future__ import annotations

import numpy as np


def _logistic(x, p):
    z = np.clip((p[1] - x) / p[2], -500, 500)
    return p[0] / (1 + np.exp(z))


def _start(x, y):
    """Start values: asymptote just above the data, then a straight line through the logit."""
    span = y.max() - y.min()
    if span <= 0:
        raise ValueError("constant response")
    z = (y - y.min() + 0.05 * span) / (1.1 * span)
    slope, intercept = np.polyfit(x, np.log(z / (1 - z)), 1)
    if slope == 0:
        raise ValueError("flat logit")
    return np.array([y.max() * 1.05, -intercept / slope, 1 / slope])


def fit_logistic(x: np.ndarray, y: np.ndarray, iterations: int = 200) -> dict:
    """Damped Gauss-Newton for y = phi1 / (1 + exp((phi2 - x) / phi3)) plus the inflection ages.

    infl1 is one before the first index with non-positive curvature, infl2 one after the index of the
    lowest curvature (1-based among curvature values); both are returned as the age at that index.
    """
    none = {"phi1": None, "phi2": None, "phi3": None, "infl1": None, "infl2": None}
    if len(x) < 5:
        return {**none, "status": "too few points"}
    try:
        p = _start(x, y)
        damping, cost = 1e-3, np.inf
        residual = y - _logistic(x, p)
        cost = residual @ residual
        settled = False
        for _ in range(iterations):
            e = np.exp(np.clip((p[1] - x) / p[2], -500, 500))
            base = 1 / (1 + e)
            shape = p[0] * e * base**2
            jac = np.column_stack([base, -shape / p[2], shape * (p[1] - x) / p[2] ** 2])
            normal, grad = jac.T @ jac, jac.T @ residual
            moved = False
            for _ in range(30):
                delta = np.linalg.solve(normal + damping * np.diag(np.diag(normal) + 1e-12), grad)
                trial = p + delta
                if trial[2] != 0 and np.all(np.isfinite(trial)):
                    new = y - _logistic(x, trial)
                    if new @ new < cost:
                        moved = True
                        break
                damping *= 4
            if not moved:
                settled = bool(np.max(np.abs(grad)) <= 1e-6 * max(1.0, cost))
                break
            gain = cost - new @ new
            p, residual, cost, damping = trial, new, new @ new, damping / 8
            if gain <= 1e-14 * max(cost, 1e-300) or np.max(np.abs(delta) / (np.abs(p) + 1e-9)) < 1e-10:
                settled = True
                break
    except (ValueError, np.linalg.LinAlgError, FloatingPointError) as failure:
        return {**none, "status": f"failed: {failure}"}
    fitted = _logistic(x, p)
    n, top = len(x), x.max()
    slope = np.diff(fitted) / (top / (n - 1))
    bend = np.diff(slope) / (top / (len(slope) - 1))
    falling = np.flatnonzero(bend <= 0)
    out = {"phi1": float(p[0]), "phi2": float(p[1]), "phi3": float(p[2]), "infl1": None, "infl2": None}
    if len(falling) == 0:
        return {**out, "status": "no inflection"}
    first = int(falling[0])
    second = int(np.argmin(np.where(bend <= 0, bend, np.inf))) + 2
    out["infl1"] = int(x[max(first, 1) - 1])
    out["infl2"] = int(x[min(second, n) - 1])
    return {**out, "status": "ok" if settled else "not converged"}
