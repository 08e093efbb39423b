r"""Gap-weighted subsequence kernel on windows of sentences, and a linear SVM on Nyström features of it.

A window is ``WINDOW`` places of a sentence and what follows them within reach. Its
feature for three characters is the sum, over their places in order within ``SPAN``
places of a first one in the window, of ``DECAY`` to the number of characters skipped.
The kernel is the product of these features divided by the norm of a whole window
(squared), so shorter windows weigh less. Nyström features of a window for a set of
landmark windows are ``K^-1/2 k(landmarks, w)``, linear in its subsequence features; so
a linear machine on them folds into one table by hashed subsequence, and sums over all
windows of a text come from one pass over its characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import regex

SPAN, DECAY, BITS, WINDOW = 5, 0.6, 20, 10
#: Places of the second and third character after the first.
STEPS = [(a, b) for b in range(2, SPAN + 1) for a in range(1, b)]
REACH = WINDOW + SPAN
NORM = float(np.sqrt(WINDOW * sum(DECAY ** (2 * (b - 2)) for _, b in STEPS)))
#: Characters scored at once; longer texts are scored in parts that overlap by a window.
PART = 200_000
NONE = -1e9
APART = regex.compile(r"(?<!\S)\S(?:[^\S\n]+\S(?!\S)){2,}")
END = regex.compile(r"[.!?]+\s+|\s*\n\s*")
SIGNS, SPACE = regex.compile(r"[^\p{L}\p{M}\s]+"), regex.compile(r"[^\S\n]+")


def sentences(text: str) -> str:
    """Sentences of a text as lines: lower case, letters and single blanks only; letters written apart are joined."""
    text = APART.sub(lambda m: SPACE.sub("", m.group()), text.lower())
    return SPACE.sub(" ", SIGNS.sub("", END.sub("\n", text))) + "\n"


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def subsequences(chars: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each step: its reach, the hashed subsequence at each first place, and its weight (0 where it leaves its sentence)."""
    first, second, third = (chars * np.uint32(k) for k in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))
    n = len(chars)
    for a, b in STEPS:
        if b < n:
            mixed = first[: n - b] ^ second[a : n - b + a] ^ third[b:]
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x27D4EB2F)
            yield b, (mixed >> np.uint32(32 - BITS)).astype(np.int64), np.where(left[: n - b] > b, np.float32(DECAY ** (b - 2)), np.float32(0))


def window_values(chars: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each place the product of the window that begins there with ``table``; ``NONE`` at line ends."""
    n = len(chars)
    ends = np.where(chars == 10, np.arange(n), n)
    ends = np.minimum.accumulate(ends[::-1])[::-1]
    own = np.zeros(n, np.float32)
    for b, at, weight in subsequences(chars, ends - np.arange(n)):
        own[: n - b] += weight * table.take(at)
    total = np.concatenate([[0.0], np.cumsum(own, dtype=np.float64)])
    values = (total[np.minimum(np.arange(n) + WINDOW, ends)] - total[:-1]) / NORM
    values[chars == 10] = NONE
    return values


def strongest(texts: list[str], table: np.ndarray) -> list[float]:
    """The value of each text's strongest window, ``NONE`` without letters."""
    out, held, size = [], [], 0

    def flush() -> None:
        if held:
            values = window_values(codes("".join(held)), table)
            starts = np.cumsum([0, *(len(t) for t in held[:-1])])
            out.extend(np.maximum.reduceat(values, starts).tolist())
            held.clear()

    for text in texts:
        lines = sentences(text)
        if len(lines) > PART:
            flush()
            size, best, chars = 0, NONE, codes(lines)
            for at in range(0, len(chars), PART):
                best = max(best, float(window_values(chars[at : at + PART + REACH], table)[:PART].max()))
            out.append(best)
            continue
        held.append(lines)
        size += len(lines)
        if size > PART:
            flush()
            size = 0
    flush()
    return out


def best_windows(text: str, table: np.ndarray) -> list[tuple[float, str]]:
    """The strongest window of each sentence of a text and its value, strongest sentences first."""
    lines = sentences(text)
    values = window_values(codes(lines), table)
    out, at = [], 0
    for line in lines.split("\n"):
        if len(line) > 2:
            first = at + int(values[at : at + len(line)].argmax())
            out.append((float(values[first]), lines[first : min(at + len(line), first + REACH)]))
        at += len(line) + 1
    return sorted(out, key=lambda x: (-x[0], x[1]))


class Prepared:
    """Windows (none empty) whose normed features are multiplied with several tables."""

    def __init__(self, windows: list[str]) -> None:
        chars = codes("".join(windows))
        sizes = np.fromiter(map(len, windows), np.int64, len(windows))
        self.by = np.cumsum(sizes) - sizes
        place = np.arange(len(chars)) - np.repeat(self.by, sizes)
        left = np.where(place < WINDOW, np.repeat(sizes, sizes) - place, 0)
        self.parts = [(at, weight) for _, at, weight in subsequences(chars, left)]
        self.n = len(chars)

    def times(self, table: np.ndarray) -> np.ndarray:
        own = np.zeros(self.n)
        for at, weight in self.parts:
            own[: len(at)] += weight * table.take(at)
        return np.add.reduceat(own, self.by) / NORM if len(self.by) else np.zeros(0)

    def table(self, shares: np.ndarray) -> np.ndarray:
        """The sum of all windows' normed features, each times its share, as one table."""
        by_place = np.repeat(shares, np.diff(np.append(self.by, self.n))) / NORM
        table = np.zeros(1 << BITS)
        for at, weight in self.parts:
            np.add.at(table, at, weight * by_place[: len(at)])
        return table


def feature(window: str) -> np.ndarray:
    """The normed features of one window as a table."""
    return Prepared([window]).table(np.ones(1))


def landmarks(windows: list[str], most: int, tried: int = 400, seed: int = 6) -> list[str]:
    """Of ``tried`` distinct windows the ``most`` that, one after another, add most to the likeness of all windows to their nearest landmark."""
    distinct = sorted(set(windows))
    if len(distinct) > tried:
        distinct = [distinct[i] for i in np.sort(np.random.default_rng(seed).choice(len(distinct), tried, replace=False))]
    if not distinct:
        return []
    every = Prepared(windows)
    alike = np.stack([every.times(feature(w)).astype(np.float32) for w in distinct])
    nearest, taken = np.zeros(len(windows), np.float32), []
    for _ in range(min(most, len(distinct))):
        gain = np.maximum(alike - nearest, 0).sum(1)
        at = int(gain.argmax())
        if gain[at] <= 0:
            break
        taken.append(distinct[at])
        nearest = np.maximum(nearest, alike[at])
    return taken


class Nystroem:
    """Features of windows for a set of landmarks."""

    def __init__(self, marks: list[str]) -> None:
        self.marks, made = marks, Prepared(marks)
        rows = np.unique(np.concatenate([at[weight > 0] for at, weight in made.parts] or [np.zeros(0, np.int64)]))
        self.place = np.full(1 << BITS, len(rows), np.int32)  # the last row is zero
        self.place[rows] = np.arange(len(rows))
        owner = np.repeat(np.arange(len(marks)), np.diff(np.append(made.by, made.n)))
        features = np.zeros((len(rows) + 1, len(marks)))  # only the subsequences that landmarks hold
        for at, weight in made.parts:
            np.add.at(features, (self.place[at], owner[: len(at)]), weight / NORM)
        features[-1] = 0
        values, vectors = np.linalg.eigh(features.T @ features)
        keep = values > 1e-6 * values.max()
        self.root = vectors[:, keep] / np.sqrt(values[keep])  # K^-1/2, up to a rotation
        self.rows = (features @ self.root).astype(np.float32)

    def of(self, windows: list[str]) -> np.ndarray:
        """One row a window."""
        made = Prepared(windows)
        own = np.zeros((made.n, self.root.shape[1]), np.float32)
        for at, weight in made.parts:
            own[: len(at)] += weight[:, None] * self.rows[self.place[at]]
        return np.add.reduceat(own, made.by) / NORM

    def table(self, weights: np.ndarray) -> np.ndarray:
        """The table of the linear machine with ``weights`` on these features."""
        return Prepared(self.marks).table(self.root @ weights).astype(np.float32)
