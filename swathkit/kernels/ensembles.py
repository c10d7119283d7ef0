"""Low-rank products and ensembles: evaluation rows, regridding, resampling, nulls."""

from __future__ import annotations

import math

import numpy as np

from .fem import barycentric, delaunay
from .gmrf import Sparse, bilinear
from .noise import normals
from .oi import Posterior


def evaluation_rows(posterior: Posterior, points: np.ndarray, at: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factor rows and residual variances of further points in a grid's low-rank basis.

    The grid's factor F spans the basis; the rows are the least-squares images of the points'
    covariances with the grid, and what they leave of the exact variance is the residual.
    """
    cross = posterior.covariance(points, at)
    rows = np.linalg.lstsq(factor, cross.T, rcond=None)[0].T
    return rows, np.maximum(posterior.variance(points) - (rows**2).sum(1), 0)


def regrid(lon: np.ndarray, lat: np.ndarray, mean: np.ndarray, factor: np.ndarray, resid: np.ndarray, x: np.ndarray, y: np.ndarray, rank: int, members: int = 128, root: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, factor and residual at new points from interpolated draws; a variance map is never interpolated."""
    z = normals(np.arange(factor.shape[1] * members), 0, root, "factor").reshape(factor.shape[1], members)
    e = normals(np.arange(len(resid) * members), 1, root, "diagonal").reshape(len(resid), members)
    draws = mean[:, None] + factor @ z + np.sqrt(resid)[:, None] * e
    nodes, w = bilinear(lon, lat, x, y)
    moved = (draws[nodes] * w[:, :, None]).sum(1)
    centre = (mean[nodes] * w).sum(1)
    anomalies = (moved - moved.mean(1, keepdims=True)) / math.sqrt(members - 1)
    u, s, _ = np.linalg.svd(anomalies, full_matrices=False)
    new = u[:, :rank] * s[:rank]
    return centre, new, np.maximum((anomalies**2).sum(1) - (new**2).sum(1), 0)


def coo(precision: Sparse) -> list[tuple[int, int, float]]:
    """Non-zero entries of the lower triangle, the table form of a sparse precision."""
    out = []
    for k, start in enumerate(precision.edges[:-1].tolist()):
        blocks = [(start, np.tril(precision.diagonal[k]))] + ([(int(precision.edges[k + 1]), precision.above[k].T)] if k < len(precision.above) else [])
        for first, block in blocks:
            i, j = np.nonzero(block)
            out += zip((i + first).tolist(), (j + start).tolist(), block[i, j].tolist(), strict=True)
    return sorted(out)


def choose_members(m: int, k: int, seed: int) -> np.ndarray:
    """k of m members without replacement; more than there are is refused."""
    if k > m:
        raise ValueError(f"{k} draws from {m} members")
    return np.sort(np.random.default_rng(seed).permutation(m)[:k])


def disjoint_partitions(total: int, size: int, count: int, seed: int) -> np.ndarray:
    """``count`` distinct pairs of disjoint member sets (count, 2, size); a pair and its mirror are the same."""
    if 2 * size > total:
        raise ValueError("two sides don't fit")
    if count > math.comb(total, size) * math.comb(total - size, size) // 2:
        raise ValueError("there aren't that many partitions")
    rng, seen, out = np.random.default_rng(seed), set(), []
    while len(out) < count:
        order = rng.permutation(total)
        sides = sorted((tuple(sorted(order[:size].tolist())), tuple(sorted(order[size : 2 * size].tolist()))))
        if tuple(sides) not in seen:
            seen.add(tuple(sides))
            out.append(sides)
    return np.array(out)


def null_ratios(m: int, n: int, draws: int, seed: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Draws of the ratio of two independent m-member deviations' RMS difference to the floor, over n independent nodes."""
    if m < 2 or n < 1 or draws < 1:
        raise ValueError("needs two members, a node and a draw")
    w = np.full(n, 1 / n) if weights is None else np.asarray(weights, float) / np.sum(weights)
    rng, step = np.random.default_rng(seed), max(1, 2_000_000 // n)
    parts = []
    for lo in range(0, draws, step):
        a, b = (np.sqrt(rng.chisquare(m - 1, (min(step, draws - lo), n))) for _ in range(2))
        parts.append(np.sqrt(((a - b) ** 2) @ w))
    return np.concatenate(parts)


def independent_nodes(field: np.ndarray) -> float:
    """Effective number of independent nodes of a (time, lat, lon) field: nodes over the product of
    each axis' sum of squared lag correlations, weighted by the share of pairs at a lag."""
    good = np.isfinite(field)
    if field.ndim != 3 or not good.any():
        raise ValueError("needs a three-dimensional field with values")
    centred = np.where(good, field - field[good].mean(), 0.0)
    shrink = 1.0
    for axis in range(3):
        x, g = np.moveaxis(centred, axis, 0), np.moveaxis(good, axis, 0)
        share = 1.0
        for lag in range(1, len(x)):
            both = g[:-lag] & g[lag:]
            a, b = x[:-lag][both], x[lag:][both]
            scale = math.sqrt(float(a @ a) * float(b @ b))
            if scale:
                share += 2 * (1 - lag / len(x)) * (float(a @ b) / scale) ** 2
        shrink *= share
    count = int(good.sum())
    return float(min(max(count / shrink, 1.0), count))


#: Points that one triangulation aims at.
LOCAL_POINTS = 400


def _circles(points: np.ndarray, triangles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and radii of the triangles' circumcircles."""
    a, b, c = (points[triangles[:, k]] for k in range(3))
    u, v = b - a, c - a
    det = 2 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
    u2, v2 = (u**2).sum(1), (v**2).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        off = np.stack([v[:, 1] * u2 - u[:, 1] * v2, u[:, 0] * v2 - v[:, 0] * u2], 1) / det[:, None]
    return a + off, np.hypot(*off.T)


def scattered_to_grid(lon: np.ndarray, lat: np.ndarray, value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Linear interpolation of scattered values over their Delaunay triangulation, nearest value outside its hull.

    All points count, however many there are: the places ``at`` are dealt to cells, and a cell's
    surroundings are triangulated alone. A triangle found there belongs to the triangulation of all
    points if its circumcircle lies within these surroundings; places without such a triangle look
    again with twice the surroundings, until these hold all points.
    """
    points = np.column_stack([lon, lat])
    low, span = points.min(0), np.maximum(np.ptp(points, axis=0), 1e-9)
    cell = float(np.sqrt(span.prod() * LOCAL_POINTS / 9 / max(len(points), 1)))
    out, open_ = np.full(len(at), np.nan), np.arange(len(at))
    reach = cell
    while len(open_):
        key = np.floor((np.clip(at[open_], low, low + span) - low) / reach).astype(np.int64)
        order = np.lexsort(key.T)
        cuts = np.flatnonzero(np.concatenate([[True], (np.diff(key[order], axis=0) != 0).any(1)]))
        left = []
        for group in np.split(open_[order], cuts[1:]):
            box = np.floor((np.clip(at[group[0]], low, low + span) - low) / reach) * reach + low
            inside = np.flatnonzero(((points >= box - reach) & (points <= box + 2 * reach)).all(1))
            every = len(inside) == len(points)
            if len(inside) < 3 and not every:
                left.append(group)
                continue
            own = points[inside]
            triangles = delaunay(own)
            if not len(triangles):
                nearest = ((own[None] - at[group][:, None]) ** 2).sum(2).argmin(1)
                settled = np.full(len(group), every)
                found = value[inside][nearest]
            else:
                nodes, w = barycentric(own, triangles, at[group])
                found = (value[inside][nodes] * w).sum(1)
                centre, radius = _circles(own, triangles)
                whole = ((centre - radius[:, None] >= box - reach) & (centre + radius[:, None] <= box + 2 * reach)).all(1)
                known = {tuple(t) for t in np.sort(triangles[whole], axis=1).tolist()}
                settled = np.array([every or tuple(sorted(t)) in known for t in nodes.tolist()])
            out[group[settled]] = found[settled]
            left.append(group[~settled])
        open_ = np.concatenate(left) if left else np.zeros(0, np.int64)
        reach *= 2
    return out
