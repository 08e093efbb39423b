"""Trees of set signatures, and their dual traversal for pairs that may be similar.

A set of ``n`` tokens has a bitmap of at least ``DENSITY * n`` bits. A node holds the OR of its
members' bitmaps, the range of their sizes, and the component that all of them belong to, if they do.
Tokens that two sets share lie on bits that both have, and a set has ``size - bits`` tokens more than
bits, so a pair below two nodes shares at most as many tokens as the nodes share bits, plus
that excess. A pair of nodes is left when this, or the sizes, can't reach the
wanted similarity, or when both hold a single component already.

Bitmaps of different length are compared at the shorter one, onto which the longer is folded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bits a token of a set, members of a leaf.
DENSITY, LEAF, LEAST = 4, 32, 64


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """The bitmap of a set of 64-bit hashes, as words of 64 bits, a power of two in number."""
    width = max(LEAST, 1 << (DENSITY * len(hashes) - 1).bit_length()) if len(hashes) else LEAST
    at = hashes & np.uint64(width - 1)
    out = np.zeros(width // 64, np.uint64)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (the last axis) at a shorter length."""
    if bits.shape[-1] == words:
        return bits
    return np.bitwise_or.reduce(bits.reshape(*bits.shape[:-1], -1, words), axis=-2)


def count(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(-1, dtype=np.int64)


@dataclass
class Node:
    members: np.ndarray  # of a leaf: their places
    sizes: np.ndarray
    roots: np.ndarray
    bits: np.ndarray  # of a leaf: a row a member
    union: np.ndarray
    least: int
    most: int
    excess: int
    root: int | None
    children: tuple[Node, Node] | None = None


def leaf(members: np.ndarray, sizes: np.ndarray, roots: np.ndarray, maps: list[np.ndarray]) -> Node:
    words = min(len(maps[m]) for m in members)
    bits = np.stack([folded(maps[m], words) for m in members])
    own = roots[members]
    return Node(members, sizes[members], own, bits, np.bitwise_or.reduce(bits), int(sizes[members].min()), int(sizes[members].max()), int((sizes[members] - count(bits)).max()), int(own[0]) if (own == own[0]).all() else None)


def parent(a: Node, b: Node) -> Node:
    words = min(len(a.union), len(b.union))
    # folding a wider union loses bits of its members, so its excess at the shorter length is bounded by the bits lost in all
    lost = max(int(count(n.union)) - int(count(folded(n.union, words))) for n in (a, b))
    nothing = np.zeros(0, np.int64)
    return Node(nothing, nothing, nothing, nothing, folded(a.union, words) | folded(b.union, words), min(a.least, b.least), max(a.most, b.most), max(a.excess, b.excess) + lost, a.root if a.root == b.root else None, (a, b))


def band_width(percent: int) -> float:
    """The width, as a logarithm, of bands of sizes in which similar sets lie next to each other at most."""
    return float(np.log(100 / min(percent, 99)))


def tree(sizes: np.ndarray, roots: np.ndarray, maps: list[np.ndarray], percent: int) -> Node:
    """A tree over sets of about one size and component next to each other; ``maps`` holds their bitmaps."""
    band = np.floor(np.log(np.maximum(sizes, 1)) / band_width(percent))
    order = np.lexsort((sizes, roots, band))
    nodes = [leaf(order[at : at + LEAF], sizes, roots, maps) for at in range(0, len(order), LEAF)]
    while len(nodes) > 1:
        nodes = [parent(*nodes[at : at + 2]) if at + 1 < len(nodes) else nodes[at] for at in range(0, len(nodes), 2)]
    return nodes[0]


def possible(x: Node, y: Node, percent: int) -> bool:
    """Whether a pair of different components below the nodes may be similar."""
    if x.root is not None and x.root == y.root:
        return False
    if 100 * x.most < percent * y.least or 100 * y.most < percent * x.least:
        return False
    words = min(len(x.union), len(y.union))
    excess = min(n.excess for n in (x, y) if len(n.union) == words)
    shared = int(count(folded(x.union, words) & folded(y.union, words))) + excess
    return (100 + percent) * shared >= percent * (x.least + y.least)


def compared(x: Node, y: Node, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of members of two leaves that may be similar, and the most tokens that they may share."""
    words = min(len(x.union), len(y.union))
    a, b = folded(x.bits, words), folded(y.bits, words)
    shared = count(a[:, None] & b[None]) + np.minimum((x.sizes - count(a))[:, None], (y.sizes - count(b))[None])
    both, least, most = x.sizes[:, None] + y.sizes[None], np.minimum(x.sizes[:, None], y.sizes[None]), np.maximum(x.sizes[:, None], y.sizes[None])
    fine = ((100 + percent) * np.minimum(shared, least) >= percent * both) & (100 * least >= percent * most) & (x.roots[:, None] != y.roots[None])
    if x is y:
        fine &= np.triu(np.ones(fine.shape, bool), 1)
    i, j = np.nonzero(fine)
    return x.members[i], y.members[j], shared[i, j]


def may_be_alike(a: np.ndarray, size_a: int, b: np.ndarray, size_b: int, percent: int) -> bool:
    """Whether two sets may be similar, by their bitmaps."""
    words = min(len(a), len(b))
    a, b = folded(a, words), folded(b, words)
    shared = int(count(a & b)) + min(size_a - int(count(a)), size_b - int(count(b)))
    return (100 + percent) * min(shared, size_a, size_b) >= percent * (size_a + size_b)


def pairs(x: Node, y: Node, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of all pairs below ``x`` and ``y`` (of one tree if ``x is y``) that may be similar, and the bound of each."""
    found, stack = [], [(x, y)]
    while stack:
        x, y = stack.pop()
        if not possible(x, y, percent):
            continue
        if x is y and x.children:
            a, b = x.children
            stack += [(a, a), (a, b), (b, b)]
        elif x.children and (not y.children or x.most - x.least >= y.most - y.least):
            stack += [(c, y) for c in x.children]
        elif y.children:
            stack += [(x, c) for c in y.children]
        else:
            found.append(compared(x, y, percent))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
