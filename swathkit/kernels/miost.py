"""Multiscale wavelet-like basis, its conjugate-gradient solver and keyed ensembles.

An element is a plane wave of one wavelength, direction and phase under cosine tapers around a
centre in space and time; supports are compact, so that the design matrix is sparse and is
kept as triplets. The normal equations are solved matrix-free.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions.geo import ORBIT_KM_PER_DEGREE
from .noise import scaled_noise


@dataclass(frozen=True)
class Basis:
    """Geometry of the basis in a box of kilometres."""

    x_km: tuple[float, float]
    y_km: tuple[float, float]
    wavelengths: tuple[float, ...] = (800.0, 400.0, 200.0)
    n_dir: int = 4
    alpha: float = 1.5  # spacing of centres and half width of tapers, in wavelengths / 2 and wavelengths
    dt_days: float = 10.0

    def elements(self, start: float, stop: float) -> dict[str, np.ndarray]:
        """All elements of a window: wavelength, direction, phase, centre and slot."""
        rows = []
        slots = np.arange(start, stop + self.dt_days / 2, self.dt_days)
        for lam in self.wavelengths:
            step = lam * self.alpha / 2
            xs, ys = (np.arange(a - step / 2, b + step, step) for a, b in (self.x_km, self.y_km))
            for d in range(self.n_dir):
                for phase in (0.0, np.pi / 2):
                    x, y, t = (g.ravel() for g in np.meshgrid(xs, ys, slots, indexing="ij"))
                    rows.append(np.stack([np.full(len(x), lam), np.full(len(x), np.pi * d / self.n_dir), np.full(len(x), phase), x, y, t]))
        every = np.concatenate(rows, axis=1)
        return dict(zip(("lam", "angle", "phase", "x", "y", "t"), every, strict=True))

    def design(self, els: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, t: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Triplets (point, element, value); without times, the spatial part alone."""
        rows, columns, values = [], [], []
        for lam in np.unique(els["lam"]):
            own = np.flatnonzero(els["lam"] == lam)
            half = lam * self.alpha
            order = np.argsort(els["x"][own], kind="stable")
            own = own[order]
            first = np.searchsorted(els["x"][own], x - half)
            last = np.searchsorted(els["x"][own], x + half)
            point = np.repeat(np.arange(len(x)), last - first)
            at = np.arange(len(point)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + np.repeat(first, last - first)
            e = own[at]
            dy = y[point] - els["y"][e]
            keep = np.abs(dy) < half
            if t is not None:
                keep &= np.abs(t[point] - els["t"][e]) < self.dt_days
            point, e, dy = point[keep], e[keep], dy[keep]
            dx = x[point] - els["x"][e]
            wave = np.cos(2 * np.pi / lam * (dx * np.cos(els["angle"][e]) + dy * np.sin(els["angle"][e])) + els["phase"][e])
            value = wave * taper(dx / half) * taper(dy / half)
            if t is not None:
                value = value * taper((t[point] - els["t"][e]) / self.dt_days)
            rows.append(point)
            columns.append(e)
            values.append(value)
        return np.concatenate(rows), np.concatenate(columns), np.concatenate(values)


def taper(u: np.ndarray) -> np.ndarray:
    """Cosine taper on [-1, 1]."""
    return np.where(np.abs(u) < 1, np.cos(np.pi * u / 2) ** 2, 0.0)


def prior_variance(lam: np.ndarray, rho: float, slope: float, r_ref: float) -> np.ndarray:
    """rho R (lam / 300)^slope."""
    return rho * r_ref * (lam / 300.0) ** slope


def to_km(lon: np.ndarray, lat: np.ndarray, lon0: float, lat0: float) -> tuple[np.ndarray, np.ndarray]:
    return (lon - lon0) * ORBIT_KM_PER_DEGREE * np.cos(np.radians(lat0)), (lat - lat0) * ORBIT_KM_PER_DEGREE


class Normal:
    """G' R^-1 G + Q^-1, applied without being formed."""

    def __init__(self, triplets: tuple[np.ndarray, np.ndarray, np.ndarray], n_obs: int, r: np.ndarray, q: np.ndarray) -> None:
        self.row, self.column, self.value = triplets
        self.n_obs, self.r, self.q = n_obs, r, q
        self.diagonal = np.bincount(self.column, self.value**2 / r[self.row], len(q)) + 1 / q

    def forward(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.row, self.value * c[self.column], self.n_obs) for c in x.T], 1)

    def adjoint(self, y: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.column, self.value * c[self.row], len(self.q)) for c in y.T], 1)

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.adjoint(self.forward(x) / self.r[:, None]) + x / self.q[:, None]

    def right_side(self, y: np.ndarray) -> np.ndarray:
        return self.adjoint(y / self.r[:, None])


@dataclass
class Descent:
    """A conjugate-gradient run that can stop and go on: what it has, and how far it is."""

    x: np.ndarray
    r: np.ndarray
    p: np.ndarray
    rz: np.ndarray
    norm: np.ndarray
    iterations: int = 0

    @classmethod
    def begin(cls, system: Normal, b: np.ndarray) -> Descent:
        z = b / system.diagonal[:, None]
        return cls(np.zeros_like(b), b.copy(), z.copy(), (b * z).sum(0), np.maximum(np.linalg.norm(b, axis=0), 1e-300))

    @property
    def residuals(self) -> np.ndarray:
        """Relative residual of each right side."""
        return np.linalg.norm(self.r, axis=0) / self.norm

    def run(self, system: Normal, rtol: float, most: int) -> Descent:
        """Go on until every residual is below ``rtol``, or ``most`` iterations are done in all."""
        while self.iterations < most and self.residuals.max() > rtol:
            ap = system.apply(self.p)
            a = self.rz / np.maximum((self.p * ap).sum(0), 1e-300)
            self.x += a * self.p
            self.r -= a * ap
            z = self.r / system.diagonal[:, None]
            new = (self.r * z).sum(0)
            self.p = z + new / np.maximum(self.rz, 1e-300) * self.p
            self.rz = new
            self.iterations += 1
        return self


def conjugate_gradient(system: Normal, b: np.ndarray, rtol: float = 1e-6, most: int = 500) -> tuple[np.ndarray, int, float]:
    """Jacobi-preconditioned for several right sides at once: solution, iterations, worst relative residual."""
    run = Descent.begin(system, b).run(system, rtol, most)
    return run.x, run.iterations, float(run.residuals.max())


def solution(system: Normal, b: np.ndarray, rtol: float = 1e-6, most: int = 2000) -> np.ndarray:
    """The converged solution; a run that ends at its cap is refused, with its report."""
    x, iterations, residual = conjugate_gradient(system, b, rtol, most)
    if residual > rtol:
        raise ArithmeticError(f"not converged: residual {residual:.3g} after {iterations} iterations")
    return x


def pass_modes(s: np.ndarray, pass_no: np.ndarray, bias: float, tilt: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Triplets of the bias and tilt columns of each pass, and their prior variances."""
    passes, number = np.unique(pass_no, return_inverse=True)
    n = len(s)
    return np.tile(np.arange(n), 2), np.concatenate([2 * number, 2 * number + 1]), np.concatenate([np.ones(n), s]), np.tile([bias, tilt], len(passes))


def augmented(triplets: tuple[np.ndarray, np.ndarray, np.ndarray], q: np.ndarray, s: np.ndarray, pass_no: np.ndarray, bias: float, tilt: float) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Design and prior variances with the pass errors' columns behind the basis: what an observation
    error of R + B L B' comes to, when the fields are read off the basis' part alone."""
    row, column, value, lam = pass_modes(s, pass_no, bias, tilt)
    both = tuple(np.concatenate(x) for x in zip(triplets, (row, column + len(q), value), strict=True))
    return both, np.concatenate([q, lam])


def member_sides(system: Normal, y: np.ndarray, obs_id: np.ndarray, els_id: np.ndarray, members: int, root: int, err_id: np.ndarray | None = None) -> np.ndarray:
    """Right sides of the mean and of perturbed-observation members; ``err_id`` names the error modes
    that follow the elements in an augmented system."""
    sides, n = [system.right_side(y[:, None])[:, 0]], len(els_id)
    for m in range(members):
        noisy = y + scaled_noise(obs_id, system.r, m, root, "obs")
        prior = scaled_noise(els_id, system.q[:n], m, root, "coef")
        if err_id is not None:
            prior = np.concatenate([prior, scaled_noise(err_id, system.q[n:], m, root, "err")])
        sides.append(system.right_side(noisy[:, None])[:, 0] + prior / system.q)
    return np.stack(sides, 1)


@dataclass(frozen=True)
class Windows:
    """60-day windows every 45 days; the last one is moved to end with the span."""

    start: float
    stop: float
    width: float = 60.0
    stride: float = 45.0

    def all(self) -> list[tuple[float, float]]:
        out, a = [], self.start
        while a + self.width < self.stop:
            out.append((a, a + self.width))
            a += self.stride
        return [*out, (max(self.start, self.stop - self.width), self.stop)]

    def covering(self, day: float) -> list[tuple[int, float]]:
        """Windows that hold a day and their weights: linear across the overlap."""
        rows = [(k, a, b) for k, (a, b) in enumerate(self.all()) if a <= day <= b][:2]
        if len(rows) < 2:
            return [(rows[0][0], 1.0)] if rows else []
        (i, _, b), (j, a, _) = rows
        w = (day - a) / (b - a) if b > a else 1.0
        return [(i, 1 - w), (j, w)]


def n_coefficients(basis: Basis, start: float, stop: float) -> int:
    """Size of a window's basis from its geometry alone."""
    slots, total = len(np.arange(start, stop + basis.dt_days / 2, basis.dt_days)), 0
    for lam in basis.wavelengths:
        step = lam * basis.alpha / 2
        total += len(np.arange(basis.x_km[0] - step / 2, basis.x_km[1] + step, step)) * len(np.arange(basis.y_km[0] - step / 2, basis.y_km[1] + step, step)) * 2 * basis.n_dir * slots
    return total


def expected_nonzeros(basis: Basis, n_obs: int) -> float:
    """Elements over a point times points: centres per support, directions, phases, two slots."""
    return n_obs * len(basis.wavelengths) * basis.n_dir * 2 * (2 * basis.alpha / (basis.alpha / 2)) ** 2 / 1.0 * 2


def peak_bytes(basis: Basis, n_obs: int, start: float, stop: float, members: int, n_nodes: int) -> dict[str, float]:
    """Memory of one window's solve: triplets, right sides with work vectors, and node output."""
    columns = n_coefficients(basis, start, stop)
    parts = {"design": expected_nonzeros(basis, n_obs) * 24, "vectors": columns * (members + 1) * 8 * 5.0, "nodes": n_nodes * (members + 1) * 8.0}
    return parts | {"total": sum(parts.values())}


def gate(basis: Basis, n_obs: int, start: float, stop: float, members: int, n_nodes: int, most: float) -> None:
    """Refuse a window whose solve would need more than ``most`` bytes, before anything is built."""
    needed = peak_bytes(basis, n_obs, start, stop, members, n_nodes)["total"]
    if needed > most:
        raise MemoryError(f"a window needs {needed:.3g} bytes, above {most:.3g}")
