"""Covariance matrices between sets of points (lon, lat, t)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ..functions.geo import KM_PER_DEGREE

Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


def matern32(x: np.ndarray) -> np.ndarray:
    z = np.sqrt(3.0) * x
    return (1 + z) * np.exp(-z)


def matern_space_time(variance: float, length_km: float, time_days: float) -> Kernel:
    def k(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        dx = (a[:, None, 0] - b[None, :, 0]) * KM_PER_DEGREE * np.cos(np.radians((a[:, None, 1] + b[None, :, 1]) / 2))
        dy = (a[:, None, 1] - b[None, :, 1]) * KM_PER_DEGREE
        return variance * matern32(np.hypot(dx, dy) / length_km) * matern32(np.abs(a[:, None, 2] - b[None, :, 2]) / time_days)

    return k


def gaussian_degrees(variance: float, lx: float, ly: float, lt: float) -> Kernel:
    def k(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = (a[:, None, :3] - b[None, :, :3]) / np.array([lx, ly, lt])
        return variance * np.exp(-(d * d).sum(2))

    return k


def paciorek_degrees(length: Callable[[np.ndarray], np.ndarray], sigma: Callable[[np.ndarray], np.ndarray], lt: float) -> Kernel:
    """Lengths and standard deviations are functions of latitude."""

    def k(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        la, lb = length(a[:, 1])[:, None], length(b[:, 1])[None, :]
        mean = (la * la + lb * lb) / 2
        d2 = (a[:, None, 0] - b[None, :, 0]) ** 2 + (a[:, None, 1] - b[None, :, 1]) ** 2
        return sigma(a[:, 1])[:, None] * sigma(b[:, 1])[None, :] * (la * lb / mean) * np.exp(-d2 / mean) * np.exp(-(((a[:, None, 2] - b[None, :, 2]) / lt) ** 2))

    return k
