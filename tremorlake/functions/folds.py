"""One left-out fold of a monitoring arm in numpy: what a task does with the reference matrix it was sent."""

from __future__ import annotations

import numpy as np

from . import dense

NEIGHBOURS, PCA_VARIANCE, GP_BIN, GP_LENGTHS = 10, 0.90, 0.5, (1.0, 2.0, 4.0, 8.0, 16.0)


def mahalanobis(train: np.ndarray, x: np.ndarray) -> np.ndarray:
    centre = train.mean(axis=0)
    z, d = train - centre, x - centre
    precision = np.linalg.inv(dense.shrunk_covariance(len(z), z.T @ z / len(z), ((z * z).sum(axis=1) ** 2).sum()))
    return np.sqrt(np.maximum(((d @ precision) * d).sum(axis=1), 0))


def linear_residuals(cov: np.ndarray, y: np.ndarray, keep: np.ndarray) -> np.ndarray | None:
    """Residuals of all rows from a least-squares fit on the kept ones; None where the covariates depend on each other there, so many fits are as good."""
    c, m = cov[keep].mean(axis=0), y[keep].mean(axis=0)
    z = cov[keep] - c
    if dense.dependent(z.T @ z / len(z)):
        return None
    slopes = np.linalg.lstsq(z, y[keep] - m, rcond=None)[0]
    return y - m - (cov - c) @ slopes


def curve_residuals(t: np.ndarray, y: np.ndarray, keep: np.ndarray) -> np.ndarray:
    _, place, count = np.unique(np.floor(t[keep] / GP_BIN), return_inverse=True, return_counts=True)
    mean_of = lambda v: np.bincount(place, v) / count
    x, out = mean_of(t[keep]), np.empty_like(y)
    for j in range(y.shape[1]):
        mean = mean_of(y[keep, j])
        within = ((y[keep, j] - mean[place]) ** 2).sum() / max(keep.sum() - len(count), 1)
        offset, length, weights = dense.gaussian_process(x, mean, count, within, GP_LENGTHS)
        out[:, j] = y[:, j] - offset - dense.rbf(t, x, length) @ weights
    return out


def standard(y: np.ndarray, keep: np.ndarray) -> np.ndarray:
    return (y - y[keep].mean(axis=0)) / y[keep].std(axis=0)


def fold_scores(arm: str, seconds: np.ndarray, temperature: np.ndarray, environment: np.ndarray, y: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Scores of the rows ``out`` from an arm fitted on the other rows, which are in time order; NaN where there is no fit."""
    keep = ~out
    if arm == "raw_frequencies":
        return mahalanobis(y[keep], y[out])
    if arm == "pca_residual":
        z = standard(y, keep)
        away, _ = dense.discarded_directions(z[keep].T @ z[keep] / keep.sum(), PCA_VARIANCE)
        return np.linalg.norm(z[out] @ away, axis=1)
    if arm == "knn":
        z = standard(y, keep)
        squares = ((z[out][:, None, :] - z[keep][None]) ** 2).sum(axis=2)
        k = min(NEIGHBOURS, squares.shape[1])
        return np.sqrt(np.partition(squares, k - 1, axis=1)[:, :k]).mean(axis=1)
    if arm == "cointegration":
        now = np.flatnonzero((np.diff(seconds) == 3600) & keep[1:] & keep[:-1]) + 1
        before, step = y[now - 1], y[now] - y[now - 1]
        b, s = before - before.mean(axis=0), step - step.mean(axis=0)
        vectors = dense.stationary_combinations(s.T @ s / len(s), s.T @ b / len(s), b.T @ b / len(s))
        return mahalanobis(y[now] @ vectors, y[out] @ vectors)
    if arm == "gp_normalized":
        r = curve_residuals(temperature, y, keep)
    else:
        columns = [temperature, np.minimum(temperature, 0), *(environment.T if arm == "environment_normalized" else [])]
        r = linear_residuals(np.column_stack(columns), y, keep)
    return np.full(int(out.sum()), np.nan) if r is None else mahalanobis(r[keep], r[out])
