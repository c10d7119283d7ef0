"""Matern field on a lattice with a sparse precision, solved by block-tridiagonal Cholesky.

The precision couples lattice rows up to two apart, so that blocks of two rows make it block
tridiagonal; only these blocks are ever formed. One forward pass gives the factor and the mean, one
backward pass the exact diagonal and neighbouring-block covariances; observations couple
neighbouring rows only.
"""

from __future__ import annotations

import numpy as np

from ..functions.geo import KM_PER_DEGREE


def spacing(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, float]:
    """East-west spacing by row and north-south spacing, in kilometres."""
    return np.maximum((lon[1] - lon[0]) * KM_PER_DEGREE * np.cos(np.radians(lat)), 1e-3), (lat[1] - lat[0]) * KM_PER_DEGREE


class Sparse:
    """Symmetric block-tridiagonal matrix by its diagonal blocks and the blocks above them."""

    def __init__(self, diagonal: list[np.ndarray], above: list[np.ndarray]) -> None:
        self.diagonal, self.above = diagonal, above
        self.edges = np.concatenate([[0], np.cumsum([len(d) for d in diagonal])])

    @classmethod
    def zeros(cls, n: int, size: int) -> Sparse:
        sizes = [min(size, n - a) for a in range(0, n, size)]
        return cls([np.zeros((k, k)) for k in sizes], [np.zeros((j, k)) for j, k in zip(sizes[:-1], sizes[1:], strict=True)])

    def __len__(self) -> int:
        return int(self.edges[-1])

    def add(self, i: np.ndarray, j: np.ndarray, value: np.ndarray) -> None:
        """Add entries of the whole symmetric matrix, each of its two halves given."""
        i, j, value = (np.asarray(x).ravel() for x in (i, j, value))
        bi, bj = (np.searchsorted(self.edges, x, side="right") - 1 for x in (i, j))
        if len(i) and np.abs(bi - bj).max() > 1:
            raise ValueError("an entry lies outside the blocks of the pattern")
        for kind, blocks in ((0, self.diagonal), (1, self.above)):
            own = np.flatnonzero(bj - bi == kind)
            order = own[np.argsort(bi[own], kind="stable")]
            for k in np.unique(bi[own]):
                at = order[slice(*np.searchsorted(bi[order], [k, k + 1]))]
                np.add.at(blocks[k], (i[at] - self.edges[k], j[at] - self.edges[k + kind]), value[at])

    def scaled(self, by: float) -> Sparse:
        return Sparse([d * by for d in self.diagonal], [u * by for u in self.above])

    def paired(self) -> Sparse:
        """The same matrix with two blocks joined to one each."""
        d, u, n = self.diagonal, self.above, len(self.diagonal)
        diagonal = [np.block([[d[k], u[k]], [u[k].T, d[k + 1]]]) if k + 1 < n else d[k] for k in range(0, n, 2)]
        out = Sparse(diagonal, [np.zeros((len(a), len(b))) for a, b in zip(diagonal[:-1], diagonal[1:], strict=True)])
        for k in range(0, n - 2, 2):
            out.above[k // 2][len(d[k]) :, : len(d[k + 2])] = u[k + 1]
        return out

    def squared(self, weight: np.ndarray) -> Sparse:
        """A diag(weight) A, in blocks of two rows."""
        d, u, e, n = self.diagonal, self.above, self.edges, len(self.diagonal)
        w = [weight[a:b] for a, b in zip(e[:-1], e[1:], strict=True)]
        same, next_, far = [], [], []
        for k in range(n):
            q = (d[k] * w[k]) @ d[k]
            if k:
                q = q + (u[k - 1].T * w[k - 1]) @ u[k - 1]
            if k + 1 < n:
                q = q + (u[k] * w[k + 1]) @ u[k].T
                next_.append((d[k] * w[k]) @ u[k] + (u[k] * w[k + 1]) @ d[k + 1])
            if k + 2 < n:
                far.append((u[k] * w[k + 1]) @ u[k + 1])
            same.append(q)
        out = Sparse(same, next_).paired()
        for k, block in enumerate(far):  # rows k and k + 2 lie in neighbouring pairs
            a, b = (0 if k % 2 == 0 else len(d[k - 1])), (0 if k % 2 == 0 else len(d[k + 1]))
            out.above[k // 2][a : a + block.shape[0], b : b + block.shape[1]] += block
        return out

    def dense(self) -> np.ndarray:
        out = np.zeros((len(self), len(self)))
        for k, d in enumerate(self.diagonal):
            a, b = self.edges[k], self.edges[k + 1]
            out[a:b, a:b] = d
            if k + 1 < len(self.diagonal):
                c = self.edges[k + 2]
                out[a:b, b:c], out[b:c, a:b] = self.above[k], self.above[k].T
        return out


def laplacian(ny: int, nx: int, dx_km: np.ndarray, dy_km: float) -> Sparse:
    """Five-point Laplacian with Neumann edges, a block a row; dx may vary by row."""
    beside = np.zeros(nx)
    beside[: nx - 1] += 1
    beside[1:] += 1
    diagonal, above = [], []
    for j in range(ny):
        row = np.diag(-beside / dx_km[j] ** 2 - ((j > 0) + (j < ny - 1)) / dy_km**2)
        i = np.arange(nx - 1)
        row[i, i + 1] = row[i + 1, i] = 1 / dx_km[j] ** 2
        diagonal.append(row)
        if j < ny - 1:
            above.append(np.eye(nx) / dy_km**2)
    return Sparse(diagonal, above)


def precision(lon: np.ndarray, lat: np.ndarray, range_km: float, variance: float) -> Sparse:
    """(kappa^2 I - L)' (kappa^2 I - L), scaled so that the mean prior variance is ``variance``."""
    dx, dy = spacing(lon, lat)
    l = laplacian(len(lat), len(lon), dx, dy)  # noqa: E741
    a = Sparse([8.0 / range_km**2 * np.eye(len(d)) - d for d in l.diagonal], [-u for u in l.above])
    q = a.squared(np.ones(len(a)))
    return q.scaled(Blocks(q).variance().mean() / variance)


class Blocks:
    """Factor of a symmetric positive block-tridiagonal matrix."""

    def __init__(self, q: Sparse) -> None:
        self.edges = q.edges.tolist()
        self.low, self.up = [], []
        prev = None
        for k, own in enumerate(q.diagonal):
            s = own.copy()
            if k:
                half = np.linalg.solve(prev, q.above[k - 1])
                s -= half.T @ half
                self.up.append(half)  # L^-1 of the block before, times its coupling to this one
            prev = np.linalg.cholesky(s)
            self.low.append(prev)

    def _parts(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[a:b] for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)]

    def forward(self, b: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for k, part in enumerate(self._parts(b)):
            out.append(np.linalg.solve(self.low[k], part - self.up[k - 1].T @ out[-1] if k else part))
        return out

    def backward(self, y: list[np.ndarray]) -> np.ndarray:
        """L^-T y: of white noise, a draw with covariance Q^-1."""
        x: list[np.ndarray] = [np.zeros(0)] * len(y)
        for k in range(len(y) - 1, -1, -1):
            rest = y[k] - self.up[k] @ x[k + 1] if k + 1 < len(y) else y[k]
            x[k] = np.linalg.solve(self.low[k].T, rest)
        return np.concatenate(x)

    def solve(self, b: np.ndarray) -> np.ndarray:
        return self.backward(self.forward(b))

    def sample(self, z: np.ndarray) -> np.ndarray:
        return self.backward(self._parts(z))

    def selected(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Diagonal blocks of the inverse, and the blocks beside them."""
        diagonal: list[np.ndarray] = [np.zeros(0)] * len(self.low)
        beside: list[np.ndarray] = [np.zeros(0)] * len(self.up)
        for k in range(len(self.low) - 1, -1, -1):
            inv = np.linalg.inv(self.low[k])
            own = inv.T @ inv
            if k + 1 < len(self.low):
                g = inv.T @ self.up[k]  # S^-1 times the coupling
                beside[k] = -g @ diagonal[k + 1]
                own = own - beside[k] @ g.T
            diagonal[k] = own
        return diagonal, beside

    def variance(self) -> np.ndarray:
        return np.concatenate([np.diag(d) for d in self.selected()[0]])


def bilinear(lon: np.ndarray, lat: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node numbers (n, 4) and weights (n, 4) of points, moved to the edge if outside."""
    fx = np.clip((x - lon[0]) / (lon[1] - lon[0]), 0, len(lon) - 1)
    fy = np.clip((y - lat[0]) / (lat[1] - lat[0]), 0, len(lat) - 1)
    i, j = np.minimum(fx.astype(int), len(lon) - 2), np.minimum(fy.astype(int), len(lat) - 2)
    fx, fy = fx - i, fy - j
    nodes = np.stack([j * len(lon) + i, j * len(lon) + i + 1, (j + 1) * len(lon) + i, (j + 1) * len(lon) + i + 1], axis=1)
    return nodes, np.stack([(1 - fx) * (1 - fy), fx * (1 - fy), (1 - fx) * fy, fx * fy], axis=1)


class Field:
    """Posterior of a lattice field: Q_prior + A' R^-1 A, with R inflated by exp(|dt| / taper)."""

    def __init__(self, lon: np.ndarray, lat: np.ndarray, obs: np.ndarray, y: np.ndarray, noise: np.ndarray, t: float, range_km: float, variance: float, taper: float) -> None:
        self.lon, self.lat = lon, lat
        q = precision(lon, lat, range_km, variance)
        rhs = np.zeros(len(q))
        if len(obs):
            nodes, w = bilinear(lon, lat, obs[:, 0], obs[:, 1])
            r = noise * np.exp(np.abs(obs[:, 2] - t) / taper)
            for a in range(4):
                np.add.at(rhs, nodes[:, a], w[:, a] * y / r)
            q.add(nodes[:, :, None].repeat(4, 2), nodes[:, None, :].repeat(4, 1), w[:, :, None] * w[:, None, :] / r[:, None, None])
        self.q = q
        self.blocks = Blocks(q)
        self.mean = self.blocks.solve(rhs)

    def variance(self) -> np.ndarray:
        return self.blocks.variance()

    def sample(self, z: np.ndarray) -> np.ndarray:
        return self.mean + self.blocks.sample(z)
