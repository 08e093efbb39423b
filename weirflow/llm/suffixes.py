"""Anchored suffixes: which are kept, their sorted front-coded runs, and the merge of runs.

A suffix is kept at a position whose ``GRAM``-byte hash is the least among those of some
``LENGTH``-byte string around it. Equal strings of that length have their anchor at
the same place, so repeats are found from anchors alone.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import zstandard

LENGTH, GRAM = 200, 64
#: How far back of its anchor such a string can begin.
BACK = LENGTH - GRAM
BLOCK, PLACE_BITS = 1 << 18, 20
_M = 0xD6E8FEB86659FD93
_rng = np.random.default_rng(7)
_LETTERS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = powers(_M, BLOCK + LENGTH), powers(pow(_M, -1, 1 << 64), BLOCK + LENGTH)


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a text's anchors, ascending, and the hash of the ``GRAM`` bytes there."""
    raw = np.frombuffer(text, np.uint8)
    places, hashes = [], []
    for at in range(0, len(raw) - LENGTH + 1, BLOCK):
        part = raw[at : at + BLOCK + LENGTH - 1]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_LETTERS[part] * _UP[: len(part)], dtype=np.uint64)])
        grams = (sums[GRAM:] - sums[:-GRAM]) * _DOWN[: len(part) - GRAM + 1]
        grams ^= grams >> np.uint64(32)
        grams *= np.uint64(0x9FB21C651E98DF25)
        grams ^= grams >> np.uint64(29)
        low = np.uint64((1 << PLACE_BITS) - 1)
        least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        span = 1
        while span * 2 <= BACK + 1:
            least = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        rest = BACK + 1 - span
        least = np.minimum(least[: len(least) - rest], least[rest:])
        chosen = np.unique((least & low).astype(np.int64))
        places.append(chosen + at)
        hashes.append(grams[chosen])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, first = np.unique(np.concatenate(places), return_index=True)
    return places, np.concatenate(hashes)[first]


def context(text: bytes, at: int) -> tuple[bytes, bytes]:
    """What a string through an anchor can hold: the suffix from it, and the bytes before it, backwards."""
    return text[at : at + LENGTH], text[max(0, at - BACK) : at][::-1]


def name(suffix: bytes, before: bytes) -> bytes:
    return hashlib.blake2b(bytes([len(suffix)]) + suffix + before, digest_size=16).digest()


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    while True:
        x, y = a[known : known + 16], b[known : known + 16]
        if x != y:
            m = min(len(x), len(y))
            differ = int.from_bytes(x[:m]) ^ int.from_bytes(y[:m])
            return known + (m - (differ.bit_length() + 7) // 8)
        known += 16


def pack(entries: dict[tuple[bytes, bytes], int]) -> bytes:
    """A sorted run, front-coded (each suffix as the length shared with the one before and the rest) and compressed."""
    out, last = [], b""
    for (suffix, before), times in sorted(entries.items()):
        shared = common(last, suffix)
        out.append(struct.pack("<BBBI", shared, len(suffix) - shared, len(before), times))
        out += (suffix[shared:], before)
        last = suffix
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def unpack(run: bytes) -> Iterator[tuple[bytes, bytes, int, int]]:
    """Suffix, bytes before, times, and the prefix shared with the entry before."""
    at, last, head = 0, b"", struct.Struct("<BBBI")
    run = zstandard.ZstdDecompressor().decompress(run)
    while at < len(run):
        shared, rest, back, times = head.unpack_from(run, at)
        at += head.size
        last = last[:shared] + run[at : at + rest]
        yield last, run[at + rest : at + rest + back], times, shared
        at += rest + back


def merge(runs: list[bytes]) -> Iterator[tuple[bytes, bytes, int, int]]:
    """All runs in one order, by a loser tree that never compares a known common prefix again.

    Each waiting entry knows its common prefix with the entry given out last. Of two
    such entries the one with the longer prefix comes first; only on equal prefixes
    are bytes compared, from there on, and the loser keeps the prefix that was found.
    """
    sources = [unpack(r) for r in runs]
    k = 1
    while k < len(sources):
        k *= 2
    done = (None, None, 0, 0)
    heads = [list(next(s, done)) for s in sources] + [list(done) for _ in range(k - len(sources))]
    for h in heads:
        h[3] = 0

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix becomes that with the winner."""
        x, y = heads[a], heads[b]
        if x[0] is None or y[0] is None:
            return (b, a) if x[0] is None else (a, b)
        if x[3] != y[3]:
            return (a, b) if x[3] > y[3] else (b, a)
        n = common(x[0], y[0], x[3])
        first = (x[0][n : n + 1], x[1]) <= (y[0][n : n + 1], y[1]) if n == len(x[0]) == len(y[0]) else x[0][n : n + 1] < y[0][n : n + 1]
        (y if first else x)[3] = n
        return (a, b) if first else (b, a)

    losers = [0] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1)
    while heads[winner][0] is not None:
        given = heads[winner]
        yield tuple(given)
        heads[winner] = list(next(sources[winner], done))  # its shared prefix is with the entry just given
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def repeats(runs: list[bytes]) -> Iterator[tuple[bytes, int, int]]:
    """For each distinct context with a repeated string through its anchor: its name, and how far the
    union of those strings reaches back of the anchor and on from it."""
    suffixes, befores, times, shared = [], [], [], []
    for suffix, before, n, lcp in merge(runs):
        if suffixes and suffix == suffixes[-1] and before == befores[-1]:
            times[-1] += n
            continue
        suffixes.append(suffix)
        befores.append(before)
        times.append(n)
        shared.append(lcp)
    if not suffixes:
        return
    n = len(suffixes)
    lcp, times = np.array(shared), np.array(times)
    ahead, behind = np.fromiter(map(len, suffixes), np.int64, n), np.fromiter(map(len, befores), np.int64, n)
    order = sorted(range(n), key=befores.__getitem__)
    left = np.array([0, *(common(befores[a], befores[b]) for a, b in zip(order, order[1:]))])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    low, high = np.full(n, LENGTH), np.full(n, -1)
    for back in range(BACK + 1):
        fits = np.nonzero((behind >= back) & (ahead >= LENGTH - back))[0]
        if not len(fits):
            continue
        right_class = np.cumsum(lcp < LENGTH - back)[fits]
        left_class = np.cumsum(left < back)[place[fits]]
        _, of = np.unique(right_class * (n + 1) + left_class, return_inverse=True)
        found = fits[np.bincount(of, times[fits])[of] > 1]
        low[found] = np.minimum(low[found], back)
        high[found] = back
    for i in np.nonzero(high >= 0)[0].tolist():
        yield name(suffixes[i], befores[i]), int(high[i]), int(LENGTH - low[i])
