"""Members of tile products that agree across seams.

Four ways, by what a tile stores: low-rank factors share one latent vector in a common basis;
lattice posteriors are drawn tile after tile, each conditioned on the values that a neighbour in
a spanning tree has already fixed; or the owner of a core decides; or tiles draw alone, which is
recorded as degraded coherence.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..operators.blend import spanning_tree
from .gmrf import Field
from .noise import derive_seed, normals


@dataclass
class TileDraw:
    """A tile's nodes (positions rounded to 6 decimals) and its lattice posterior."""

    keys: list[tuple[float, float]]
    field: Field

    @classmethod
    def of(cls, field: Field) -> TileDraw:
        return cls([(round(float(x), 6), round(float(y), 6)) for y in field.lat for x in field.lon], field)

    def alone(self, number: int, member: int, params: str) -> np.ndarray:
        """An unconditional posterior draw, independent of every other tile's."""
        root = derive_seed("gmrf", params, f"tile:{number}", member)
        return self.field.sample(normals(np.arange(len(self.keys)), member, root, "white"))

    def conditioned(self, draw: np.ndarray, fixed: dict[tuple[float, float], float]) -> np.ndarray:
        """Move a draw by kriging so that it takes the fixed values at shared nodes."""
        at = np.array([i for i, k in enumerate(self.keys) if k in fixed], dtype=int)
        if not len(at):
            return draw
        unit = np.zeros((len(self.keys), len(at)))
        unit[at, np.arange(len(at))] = 1
        columns = self.field.blocks.solve(unit)
        gap = np.array([fixed[self.keys[i]] for i in at]) - draw[at]
        return draw + columns @ np.linalg.solve(columns[at], gap)


def overlaps(tiles: list[TileDraw]) -> list[tuple[int, int, int]]:
    """Pairs of tiles that share at least two rows and two columns of nodes, and how many nodes."""
    sets, out = [set(t.keys) for t in tiles], []
    for i in range(len(tiles)):
        for j in range(i + 1, len(tiles)):
            both = sets[i] & sets[j]
            if len({x for x, _ in both}) >= 2 and len({y for _, y in both}) >= 2:
                out.append((i, j, len(both)))
    return out


def tree_members(tiles: list[TileDraw], member: int, params: str) -> list[np.ndarray]:
    """Draws conditioned along the spanning tree of largest overlaps; exact along its edges."""
    parent, order = spanning_tree(overlaps(tiles), len(tiles))
    out: dict[int, np.ndarray] = {}
    for i in order:
        p = parent[i]
        fixed = {} if p is None else dict(zip(tiles[p].keys, out[p], strict=True))
        out[i] = tiles[i].conditioned(tiles[i].alone(i, member, params), fixed)
    return [out[i] for i in range(len(tiles))]


def chain_members(tiles: list[TileDraw], member: int, params: str) -> list[np.ndarray]:
    """The same along a chain of tiles from west to east."""
    order = sorted(range(len(tiles)), key=lambda i: float(np.mean(tiles[i].field.lon)))
    out: list[np.ndarray] = [np.zeros(0)] * len(tiles)
    fixed: dict[tuple[float, float], float] = {}
    for i in order:
        out[i] = tiles[i].conditioned(tiles[i].alone(i, member, params), fixed)
        fixed = dict(zip(tiles[i].keys, out[i], strict=True))
    return out


def owner_members(tiles: list[TileDraw], owner: dict[tuple[float, float], int], member: int, params: str) -> list[np.ndarray]:
    """Independent draws, every node taking the value of the tile whose core holds it."""
    draws = [t.alone(i, member, params) for i, t in enumerate(tiles)]
    decided = {k: v for i, t in enumerate(tiles) for k, v in zip(t.keys, draws[i], strict=True) if owner.get(k) == i}
    return [np.array([decided.get(k, v) for k, v in zip(t.keys, d, strict=True)]) for t, d in zip(tiles, draws, strict=True)]


def independent(tiles: list[TileDraw], member: int, params: str) -> list[np.ndarray]:
    """Every tile draws alone: members don't agree across seams, which ``degradation_transform`` records."""
    return [t.alone(i, member, params) for i, t in enumerate(tiles)]


def shared_basis_field(factors: list[np.ndarray], weights: np.ndarray, member: int, method: str, params: str) -> np.ndarray:
    """Structured part of a low-rank member over a support: each tile's factor is replaced by the
    symmetric root of its covariance in one basis for all tiles, so that a single latent vector
    moves all tiles alike and overlaps neither cancel nor steepen."""
    support = np.hstack(factors)
    if not support.size:
        return np.zeros(weights.shape[1])
    basis, spread, _ = np.linalg.svd(support, full_matrices=False)
    basis = basis[:, spread > spread[0] * 1e-12]
    z = normals(np.arange(basis.shape[1]), member, derive_seed(method, params, "structured-shared", member), "factor")
    out = np.zeros(len(basis))
    for f, w in zip(factors, weights, strict=True):
        values, vectors = np.linalg.eigh(basis.T @ f @ (f.T @ basis))
        out += w * (basis @ (vectors @ (np.sqrt(np.maximum(values, 0)) * (vectors.T @ z))))
    return out


DRIVERS = {"low_rank": "shared_basis_field", "precision": "tree_members", "precision_chain": "chain_members", "core": "owner_members", "none": "independent"}


def select_driver(kind: str) -> str:
    """Name of the driver for what a product stores; unknown kinds degrade to independent draws."""
    return DRIVERS.get(kind, DRIVERS["none"])
