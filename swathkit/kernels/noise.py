"""Keyed randomness: every draw is a function of its identity, never of partitioning."""

from __future__ import annotations

import hashlib

import numpy as np

#: Coefficients of Acklam's rational approximation of the normal quantile.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def normal_quantile(p: np.ndarray) -> np.ndarray:
    p = np.asarray(p, float)
    out = np.empty_like(p)
    low, high = p < 0.02425, p > 1 - 0.02425
    mid = ~(low | high)
    q = p[mid] - 0.5
    r = q * q
    out[mid] = np.polyval(_A, r) * q / np.polyval((*_B, 1.0), r)
    for side, x, sign in ((low, p[low], 1), (high, 1 - p[high], -1)):
        t = np.sqrt(-2 * np.log(x))
        out[side] = sign * np.polyval(_C, t) / np.polyval((*_D, 1.0), t)
    return out


def derive_seed(method: str, params_key: str, window: str, member: int) -> int:
    """63 bits of a keyed digest of the unit's identity."""
    text = "\x1f".join((method, params_key, window, str(member)))
    return _eight(text) >> 1


def _eight(text: str) -> int:
    """The first eight bytes of a SHA-256 digest, which SQL engines know too."""
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def normals(identity: np.ndarray, member: int, root: int, kind: str = "obs") -> np.ndarray:
    """One standard normal for each 64-bit identity, member and kind of noise."""
    salt = _eight(f"{kind}\x1f{member}\x1f{root}")
    h = np.asarray(identity).astype(np.int64).view(np.uint64) ^ np.uint64(salt)
    for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(k)
    h ^= h >> np.uint64(31)
    return normal_quantile(((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53)


def scaled_noise(identity: np.ndarray, variance: np.ndarray, member: int, root: int, kind: str) -> np.ndarray:
    """N(0, variance) keyed by identity: of observations, coefficients or error modes, by ``kind``."""
    return np.sqrt(variance) * normals(identity, member, root, kind)


def lattice_identity(lon: np.ndarray, lat: np.ndarray, step: float) -> np.ndarray:
    """Number of the global lattice cell of each point, the same in every tile."""
    return np.rint(np.asarray(lon) / step).astype(np.int64) * (1 << 32) + np.rint(np.asarray(lat) / step).astype(np.int64)
