"""Map and along-track spectra."""

from __future__ import annotations

import numpy as np


def detrend(field: np.ndarray) -> np.ndarray:
    """The field without its least-squares plane."""
    j, i = np.mgrid[0 : field.shape[0], 0 : field.shape[1]]
    a = np.stack([np.ones(field.size), i.ravel(), j.ravel()], 1)
    return field - (a @ np.linalg.lstsq(a, field.ravel(), rcond=None)[0]).reshape(field.shape)


def radial_hann(ny: int, nx: int) -> np.ndarray:
    """Hann taper of the distance from the centre, 0 from the shorter half side on."""
    j, i = np.mgrid[0:ny, 0:nx]
    r = np.hypot((i - (nx - 1) / 2) / (nx / 2), (j - (ny - 1) / 2) / (ny / 2))
    return np.where(r < 1, 0.5 * (1 + np.cos(np.pi * r)), 0.0)


def power2d(field: np.ndarray, window: np.ndarray, dx: float, dy: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half-plane power (its sum is the windowed field's sum of squares), and wavenumbers."""
    ny, nx = field.shape
    power = np.abs(np.fft.rfft2(field * window)) ** 2 / field.size
    double = np.ones(power.shape[1])
    double[1 : (nx + 1) // 2] = 2  # columns whose mirror isn't there
    kx, ky = np.meshgrid(np.fft.rfftfreq(nx, dx), np.fft.fftfreq(ny, dy))
    return power * double, kx, ky


def wedge(kx: np.ndarray, ky: np.ndarray, angle: float, width: float, low: float, high: float) -> np.ndarray:
    """Modes within ``width`` degrees of an axis, and within a band."""
    k = np.hypot(kx, ky)
    off = np.abs((np.degrees(np.arctan2(ky, kx)) - angle + 90) % 180 - 90)
    return (off <= width) & (k >= low) & (k <= high)


def annulus(kx: np.ndarray, ky: np.ndarray, low: float, high: float) -> np.ndarray:
    k = np.hypot(kx, ky)
    return (k >= low) & (k <= high)


def rings(power: np.ndarray, kx: np.ndarray, ky: np.ndarray, dk: float, exclude: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Wavenumber, power and number of modes of each ring round(k / dk)."""
    ring = np.rint(np.hypot(kx, ky) / dk).astype(int)
    use = np.ones(power.shape, bool) if exclude is None else ~exclude
    n = np.bincount(ring[use])
    return np.arange(len(n)) * dk, np.bincount(ring[use], power[use]), n


def slope(k: np.ndarray, power: np.ndarray, n: np.ndarray, low: float, high: float) -> tuple[float, float]:
    """Weighted log-log slope in a band, and its standard error."""
    use = (k >= low) & (k <= high) & (n > 0) & (power > 0)
    x, y, w = np.log(k[use]), np.log(power[use] / n[use]), n[use].astype(float)
    if use.sum() < 3:
        return float("nan"), float("nan")
    x0, y0 = np.average(x, weights=w), np.average(y, weights=w)
    sxx = (w * (x - x0) ** 2).sum()
    b = (w * (x - x0) * (y - y0)).sum() / sxx
    r = y - y0 - b * (x - x0)
    return float(b), float(np.sqrt((w * r * r).sum() / ((use.sum() - 2) * sxx)))


def mainlobe_bins(window: np.ndarray, pad: int = 8) -> float:
    """First null of a window's transform along x, in unpadded bins."""
    row = np.abs(np.fft.rfft(window.sum(0), window.shape[1] * pad))
    falling = np.flatnonzero((row[1:-1] <= row[:-2]) & (row[1:-1] <= row[2:]))
    return float((falling[0] + 1) / pad) if len(falling) else float(len(row) / pad)


def resolved_wavelength(signal: list[np.ndarray], error: list[np.ndarray], dx_km: float, level: float = 0.5) -> float:
    """Wavelength at which the error's power reaches ``level`` of the signal's; infinite if the map
    never resolves, the shortest wavelength if it always does, NaN without segments."""
    if not signal:
        return float("nan")
    n = len(signal[0])
    taper = np.hanning(n)
    ps, pe = (np.mean([np.abs(np.fft.rfft((s - s.mean()) * taper)) ** 2 for s in x], axis=0)[1:] for x in (signal, error))
    k, ratio = np.fft.rfftfreq(n, dx_km)[1:], pe / np.maximum(ps, 1e-300)
    above = np.flatnonzero(ratio >= level)
    if not len(above):
        return float(1 / k[-1])
    i = int(above[0])
    if i == 0:
        return float("inf")
    f = (level - ratio[i - 1]) / (ratio[i] - ratio[i - 1])
    return float(1 / (k[i - 1] + f * (k[i] - k[i - 1])))
