"""Block jackknife on small arrays of block sums."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Jackknife:
    est: np.ndarray
    se: np.ndarray
    cov: np.ndarray
    delete: np.ndarray


def spread(est: np.ndarray, delete: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(se, cov) by pseudovalues of the delete-one estimates (blocks x parameters)."""
    b = delete.shape[0]
    pseudo = b * est - (b - 1) * delete
    centred = pseudo - pseudo.mean(0)
    cov = centred.T @ centred / max((b - 1) * b, 1)
    return np.sqrt(np.maximum(np.diag(cov), 0)), cov


def from_block_sums(xtx: np.ndarray, xty: np.ndarray) -> Jackknife:
    """Estimates of all rows and with each block left out, from sums by block."""
    total_xx, total_xy = xtx.sum(0), xty.sum(0)
    est = np.linalg.solve(total_xx, total_xy)
    delete = np.linalg.solve(total_xx[None] - xtx, (total_xy[None] - xty)[..., None])[..., 0]
    se, cov = spread(est, delete)
    return Jackknife(est, se, cov, delete)


def ratio(est: np.ndarray, numerator: np.ndarray, denominator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(se, cov) of ratios from their delete-one parts; a denominator of 0 gives NaN."""
    b = numerator.shape[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        pseudo = np.where(denominator == 0, np.nan, b * est - (b - 1) * (numerator / denominator))
    centred = pseudo - pseudo.mean(0)
    cov = centred.T @ centred / max((b - 1) * b, 1)
    return np.sqrt(np.maximum(np.diag(cov), 0)), cov


def two_step(first: Jackknife, second: Jackknife, c: float) -> Jackknife:
    """Slope of the second step with the intercept of the first."""
    k = second.est.size
    est = np.append(second.est, first.est[k])
    delete = np.hstack([second.delete - c * (first.delete[:, k : k + 1] - first.est[k]), first.delete[:, k : k + 1]])
    se, cov = spread(est, delete)
    return Jackknife(est, se, cov, delete)
