"""A forest of random-projection trees, grown from a bounded sample, and the search of all its trees at once."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

TREES, LEAF, SEED = 8, 8, 11
#: Cosine to the query at which neighbours are sought; it weighs crossed planes against each other.
ALIKE = 0.45
#: Rows whose leaves are weighed together, and the costs of the far and the near side of a plane by the distance to it, in steps of ``FINE``.
TOGETHER, FINE = 32, 1 / 512
_CHANCES = [0.5 * math.erfc(i * FINE) for i in range(8 * 512)]
FAR = np.array([-math.log(p + 1e-300) for p in _CHANCES], np.float32)
NEAR = np.array([-math.log(1 - p) for p in _CHANCES], np.float32)


@dataclass
class Tree:
    """Inner node ``i`` splits at ``x . planes[i] > cuts[i]``; children below 0 are leaves ``~child``; ``cells`` has each leaf's cell."""

    planes: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    cells: np.ndarray


@dataclass
class Forest:
    """All trees in one numbering of nodes, leaves and cells."""

    roots: np.ndarray
    planes: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    cells: np.ndarray
    spread: float  # of projections of vectors onto a plane's normal

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree, one column a tree."""
        at = np.repeat(self.roots[None, :], len(x), 0)
        while (inner := at >= 0).any():
            rows, trees = np.nonzero(inner)
            node = at[rows, trees]
            side = (np.einsum("ij,ij->i", x[rows], self.planes[node]) > self.cuts[node]).astype(int)
            at[rows, trees] = self.children[node, side]
        return ~at

    def levels(self) -> list[np.ndarray]:
        """The inner nodes of all trees by their depth, roots first."""
        out, at = [], self.roots
        while len(at):
            out.append(at)
            below = self.children[at].ravel()
            at = np.unique(below[below >= 0])
        return out

    def costs(self, x: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """For each leaf and row the sum of ``-log`` of the chances that a neighbour of the row lies on the leaf's side of each plane above it.

        Both planes that the way to the leaf crosses count and, by how near they were, those that it doesn't.
        """
        steep = ALIKE / math.sqrt(1 - ALIKE**2) / max(self.spread, 1e-12) / math.sqrt(2)
        margins = self.planes.astype(np.float32) @ x.T.astype(np.float32) - self.cuts.astype(np.float32)[:, None]
        step = np.minimum(np.abs(margins) * np.float32(steep / FINE), len(FAR) - 1).astype(np.int32)
        upper, far, near = margins > 0, FAR.take(step), NEAR.take(step)
        inner, leaves = np.zeros_like(margins), np.zeros((len(self.cells), len(x)), np.float32)
        for at in levels:
            for side in (1, 0):
                below = self.children[at, side]
                cost = inner[at] + np.where(upper[at] == bool(side), near[at], far[at])
                leaf = below < 0
                leaves[~below[leaf]] = cost[leaf]
                inner[below[~leaf]] = cost[~leaf]
        return leaves

    def search(self, x: np.ndarray, budget: float, sizes: list[int]) -> list[np.ndarray]:
        """For each row the leaves of all trees of least cost, until they hold ``budget`` entries by ``sizes``; all rows take the same steps at once."""
        sizes, levels, out = np.asarray(sizes), self.levels(), []
        full = len(sizes)
        most = min(full, int(2 * budget / max(1e-9, sizes.mean())) + 1)
        for first in range(0, len(x), TOGETHER):
            for cost in np.ascontiguousarray(self.costs(x[first : first + TOGETHER], levels).T):
                for taken in (most, full):
                    some = np.argpartition(cost, taken - 1)[:taken] if taken < full else np.arange(full)
                    some = some[np.argsort(cost[some], kind="stable")]
                    held = np.cumsum(sizes[some])
                    if held[-1] >= budget:
                        break
                out.append(some[: np.searchsorted(held, budget) + 1])
        return out


def grow(sample: np.ndarray, number: int, cell: int, leaf: int = LEAF, seed: int = SEED) -> Tree:
    """A tree that halves the sample at the median of a projection onto the line between two random points.

    Halving stops at ``leaf`` sample points; a subtree of at most ``cell`` of them is a cell.
    """
    rng = np.random.default_rng([seed, number])
    planes, cuts, children, cells = [], [], [], []
    last = -1

    def build(rows: np.ndarray, own: int) -> int:
        nonlocal last
        if own < 0 and len(rows) <= max(cell, leaf):
            last += 1
            own = last
        for _ in range(3 if len(rows) > leaf else 0):
            a, b = sample[rng.choice(rows, 2, replace=False)]
            plane = a - b
            if not (norm := np.linalg.norm(plane)):
                continue
            plane = plane / norm
            at = sample[rows] @ plane
            cut = float(np.median(at))
            upper = at > cut
            if not upper.any() or upper.all():
                continue
            node = len(planes)
            planes.append(plane)
            cuts.append(cut)
            children.append([0, 0])
            children[node] = [build(rows[~upper], own), build(rows[upper], own)]
            return node
        if own < 0:
            last += 1
            own = last
        cells.append(own)
        return -len(cells)  # ~(len(cells) - 1)

    root = build(np.arange(len(sample)), -1)
    width = sample.shape[1]
    if root < 0:  # one leaf: a node that sends everything to it
        return Tree(np.zeros((1, width)), np.array([math.inf]), np.array([[-1, -1]]), np.array(cells))
    return Tree(np.array(planes).reshape(-1, width), np.array(cuts), np.array(children, int).reshape(-1, 2), np.array(cells))


def joined(trees: list[Tree], sample: np.ndarray) -> Forest:
    """Trees (each with node 0 as its root) as one forest."""
    nodes = np.cumsum([0, *(len(t.planes) for t in trees)])
    leaves = np.cumsum([0, *(len(t.cells) for t in trees)])
    cells = np.cumsum([0, *(int(t.cells.max()) + 1 for t in trees)])
    children = [np.where(t.children < 0, t.children - leaf, t.children + node) for t, node, leaf in zip(trees, nodes, leaves)]
    roots = nodes[:-1]
    spread = float(np.mean([np.std(sample @ t.planes[0]) for t in trees]))
    return Forest(roots, np.concatenate([t.planes for t in trees]), np.concatenate([t.cuts for t in trees]), np.concatenate(children), np.concatenate([t.cells + c for t, c in zip(trees, cells)]), spread)
