"""Matern field on a triangle mesh with linear elements and lumped mass, in kilometres."""

from __future__ import annotations

import numpy as np

from ..functions.geo import KM_PER_DEGREE
from .gmrf import Blocks, Sparse


def structured_mesh(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a lattice and two triangles for each of its cells."""
    nodes = np.stack([a.ravel() for a in np.meshgrid(lon, lat)], axis=1)
    nx = len(lon)
    j, i = (a.ravel() for a in np.mgrid[0 : len(lat) - 1, 0 : nx - 1])
    k = j * nx + i
    return nodes, np.concatenate([np.stack([k, k + 1, k + nx], 1), np.stack([k + 1, k + nx + 1, k + nx], 1)])


def delaunay(points: np.ndarray) -> np.ndarray:
    """Bowyer-Watson triangulation of a scattered set: points are added one by one, and the
    triangles whose circumcircle holds the new one are replaced by a fan around their border."""
    points = np.asarray(points, float)
    centre, reach = points.mean(0), max(np.ptp(points, axis=0).max(), 1e-9) * 50
    far = centre + reach * np.array([[-1.7, -1.0], [1.7, -1.0], [0.0, 2.0]])
    every = np.concatenate([points, far])
    n = len(points)
    triangles = np.array([[n, n + 1, n + 2]])
    for k in range(n):
        a, b, c = (every[triangles[:, m]] - every[k] for m in range(3))
        det = (a**2).sum(1) * (b[:, 0] * c[:, 1] - c[:, 0] * b[:, 1]) - (b**2).sum(1) * (a[:, 0] * c[:, 1] - c[:, 0] * a[:, 1]) + (c**2).sum(1) * (a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1])
        bad = det > 0
        edges = np.concatenate([triangles[bad][:, [p, q]] for p, q in ((0, 1), (1, 2), (2, 0))])
        seen = {tuple(e) for e in edges.tolist()}
        border = np.array([e for e in edges.tolist() if (e[1], e[0]) not in seen]).reshape(-1, 2)
        triangles = np.concatenate([triangles[~bad], np.column_stack([border, np.full(len(border), k)])]).astype(int)
    return triangles[(triangles < n).all(1)]


def smallest_angle(nodes: np.ndarray, triangles: np.ndarray) -> float:
    """Degrees of the smallest angle of a mesh."""
    least = 180.0
    for p, q, r in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
        u, v = nodes[triangles[:, q]] - nodes[triangles[:, p]], nodes[triangles[:, r]] - nodes[triangles[:, p]]
        cos = (u * v).sum(1) / np.maximum(np.linalg.norm(u, axis=1) * np.linalg.norm(v, axis=1), 1e-300)
        least = min(least, float(np.degrees(np.arccos(np.clip(cos, -1, 1))).min()))
    return least


def elements(nodes_km: np.ndarray, triangles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lumped mass (n), and the stiffness of linear elements as entries (i, j, value), repeats to be added up."""
    mass = np.zeros(len(nodes_km))
    p = nodes_km[triangles]
    e = np.stack([p[:, 2] - p[:, 1], p[:, 0] - p[:, 2], p[:, 1] - p[:, 0]], axis=1)  # opposite edges
    area = np.abs(e[:, 0, 0] * e[:, 1, 1] - e[:, 0, 1] * e[:, 1, 0]) / 2
    for a in range(3):
        np.add.at(mass, triangles[:, a], area / 3)
    value = np.einsum("tac,tbc->tab", e, e) / (4 * area)[:, None, None]
    i, j = triangles[:, :, None].repeat(3, 2), triangles[:, None, :].repeat(3, 1)
    return mass, i.ravel(), j.ravel(), value.ravel()


def precision(nodes: np.ndarray, triangles: np.ndarray, range_km: float, variance: float, row: int | None = None) -> Sparse:
    """(k^2 C + G) C^-1 (k^2 C + G) over tau, the mesh projected to kilometres; the variance is the continuous field's.

    ``row`` is the number of nodes in a row of the mesh, beyond whose neighbours no element reaches (a
    structured mesh); without it all nodes are one block.
    """
    lat0 = np.radians(nodes[:, 1].mean())
    mass, i, j, value = elements(nodes * np.array([KM_PER_DEGREE * np.cos(lat0), KM_PER_DEGREE]), triangles)
    kappa2, every = 8.0 / range_km**2, np.arange(len(nodes))
    a = Sparse.zeros(len(nodes), row or len(nodes))
    a.add(i, j, value)
    a.add(every, every, kappa2 * mass)
    return a.squared(1 / mass).scaled(1 / (variance * 4 * np.pi * kappa2))


def barycentric(nodes: np.ndarray, triangles: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node numbers (n, 3) and weights (n, 3); a point outside the mesh takes its nearest node."""
    out, weights = np.zeros((len(points), 3), int), np.zeros((len(points), 3))
    a, b, c = (nodes[triangles[:, m]] for m in range(3))
    det = (b[:, 1] - c[:, 1]) * (a[:, 0] - c[:, 0]) + (c[:, 0] - b[:, 0]) * (a[:, 1] - c[:, 1])
    for k, p in enumerate(points):
        w0 = ((b[:, 1] - c[:, 1]) * (p[0] - c[:, 0]) + (c[:, 0] - b[:, 0]) * (p[1] - c[:, 1])) / det
        w1 = ((c[:, 1] - a[:, 1]) * (p[0] - c[:, 0]) + (a[:, 0] - c[:, 0]) * (p[1] - c[:, 1])) / det
        w = np.stack([w0, w1, 1 - w0 - w1], 1)
        t = int(w.min(1).argmax())
        if w[t].min() >= -1e-9:
            out[k], weights[k] = triangles[t], np.clip(w[t], 0, 1)
        else:
            out[k], weights[k] = int(((nodes - p) ** 2).sum(1).argmin()), (1, 0, 0)
    return out, weights


def solve(nodes: np.ndarray, triangles: np.ndarray, obs: np.ndarray, y: np.ndarray, noise: np.ndarray, t: float, range_km: float, variance: float, taper: float, row: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Posterior mean and variance at the mesh's nodes, by blocks of two rows."""
    q, rhs = precision(nodes, triangles, range_km, variance, row), np.zeros(len(nodes))
    if len(obs):
        at, w = barycentric(nodes, triangles, obs[:, :2])
        r = noise * np.exp(np.abs(obs[:, 2] - t) / taper)
        for a in range(3):
            np.add.at(rhs, at[:, a], w[:, a] * y / r)
        q.add(at[:, :, None].repeat(3, 2), at[:, None, :].repeat(3, 1), w[:, :, None] * w[:, None, :] / r[:, None, None])
    factor = Blocks(q)
    return factor.solve(rhs), factor.variance()
