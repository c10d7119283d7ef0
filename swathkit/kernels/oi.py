"""Optimal interpolation: a Gaussian process conditioned on one group's observations."""

from __future__ import annotations

import numpy as np

from .covariance import Kernel


class Posterior:
    """Posterior of a zero-mean process given values with diagonal noise; factored once."""

    def __init__(self, kernel: Kernel, obs: np.ndarray, y: np.ndarray, noise: np.ndarray) -> None:
        self.kernel, self.obs = kernel, obs
        if len(obs):
            k = kernel(obs, obs)
            k[np.diag_indices(len(obs))] += noise
            self.low = np.linalg.cholesky(k)
            self.alpha = self.solve(y)

    def solve(self, b: np.ndarray) -> np.ndarray:
        return np.linalg.solve(self.low.T, np.linalg.solve(self.low, b))

    def mean(self, at: np.ndarray) -> np.ndarray:
        return self.kernel(at, self.obs) @ self.alpha if len(self.obs) else np.zeros(len(at))

    def _half(self, at: np.ndarray) -> np.ndarray:
        return np.linalg.solve(self.low, self.kernel(self.obs, at))

    def covariance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        prior = self.kernel(a, b)
        return prior - self._half(a).T @ self._half(b) if len(self.obs) else prior

    def variance(self, at: np.ndarray, prior: np.ndarray | None = None) -> np.ndarray:
        """Marginal variances; the prior's diagonal is taken in blocks, the matrix is never formed."""
        out = np.concatenate([np.diag(self.kernel(at[i : i + 256], at[i : i + 256])) for i in range(0, len(at), 256)]) if prior is None else prior
        return np.maximum(out - (self._half(at) ** 2).sum(0), 0) if len(self.obs) else out

    def sample(self, at: np.ndarray, z: np.ndarray, jitter: float = 1e-9) -> np.ndarray:
        """Draws for the columns of z."""
        c = self.covariance(at, at)
        c[np.diag_indices(len(at))] += jitter
        return self.mean(at)[:, None] + np.linalg.cholesky(c) @ z


def low_rank(posterior: Posterior, at: np.ndarray, rank: int, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Randomised range finder: factor rows (n, rank), exact residual diagonal, share of variance captured."""
    cov = posterior.covariance(at, at)
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(cov @ rng.standard_normal((len(at), min(len(at), rank + 5))))
    values, vectors = np.linalg.eigh(q.T @ cov @ q)
    keep = np.argsort(values)[::-1][:rank]
    factor = (q @ vectors[:, keep]) * np.sqrt(np.maximum(values[keep], 0))
    residual = np.maximum(np.diag(cov) - (factor**2).sum(1), 0)
    return factor, residual, float((factor**2).sum() / max(np.trace(cov), 1e-300))
