"""A hashed maximum-entropy language model with a class-factored softmax.

Classes are nested: all words form one class, a class falls into two classes of about
equal count until single words are left. A token's probability is the product of the
choices on the way to its word, and each choice is a two-way softmax over hashed
feature weights of its own: of the last word, the last two, and the word two back
(skipping one). The bias of a choice is fixed by the counts, so the model without
features is the unigram model.

Words seen fewer than ``SEEN`` times, those beyond a bounded head of the vocabulary and
unknown ones are leaves by the hash of their last letters; within such a leaf a word has
the share of its smoothed count, which stays in a distributed table.

Weights are trained by full gradients: each round adds ``gradient / (curvature + PRIOR)``
of all training tokens, so the result depends on no order and no split of the input; the curvature is that of the first round.
Tokens equal in leaf and both leaves before add the same, so they are added once, times their number.
Their number grows with the training tokens, up to 2^``MOST_BITS``, since they are sent to all tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: Feature templates: how many tokens back the words lie that make a feature.
TEMPLATES = ((1,), (1, 2), (2,))
SEEN, TAILS, ENDING = 3, 64, 3
LEAST_BITS, MOST_BITS, TOKENS_A_WEIGHT = 16, 21, 2
PRIOR, RATE = 2.0, 0.6
#: Tokens whose choices are held at once.
BATCH = 16_384
BEFORE = 0x51ED270B


def weight_bits(tokens: int) -> int:
    """Bits of the number of weights for so many training tokens."""
    return min(MOST_BITS, max(LEAST_BITS, (max(1, tokens) // TOKENS_A_WEIGHT).bit_length()))


def tail_of(word: bytes) -> int:
    """The leaf of a word outside the head."""
    return zlib.crc32(word[-ENDING:]) % TAILS


def nested(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes over leaves in their order: where each leaf's path begins in ``nodes`` and ``sides``, and the bias of each node."""
    n = len(weights)
    total = np.concatenate([[0.0], np.cumsum(weights)])
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    node = 0
    leaves, nodes, sides, biases = [], [], [], []
    while True:
        open_ = high - low > 1
        low, high = low[open_], high[open_]
        if not len(low):
            break
        half = np.clip(np.searchsorted(total, (total[low] + total[high]) / 2), low + 1, high - 1)
        left, right = total[half] - total[low], total[high] - total[half]
        biases.append(np.log(right / left))
        sizes = high - low
        first = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) - np.repeat(first - low, sizes)
        leaves.append(at)
        nodes.append(np.repeat(node + np.arange(len(low)), sizes))
        sides.append(at >= np.repeat(half, sizes))
        node += len(low)
        low, high = np.stack([low, half], 1).ravel(), np.stack([half, high], 1).ravel()
    if not leaves:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint32), np.zeros(0, bool), np.zeros(0, np.float32)
    leaf = np.concatenate(leaves)
    order = np.argsort(leaf, kind="stable")  # of one leaf the outer classes first
    starts = np.concatenate([[0], np.cumsum(np.bincount(leaf, minlength=n))])
    return starts, np.concatenate(nodes)[order].astype(np.uint32), np.concatenate(sides)[order], np.concatenate(biases).astype(np.float32)


class Leaves(dict):
    """Leaf numbers of the head's words, and of any other word by its tail leaf; other words aren't kept."""

    def __missing__(self, word: bytes) -> int:
        return len(self) + tail_of(word)


@dataclass
class Vocabulary:
    """The head of the vocabulary (``b""`` is the end of a text), with what scoring needs of it; leaf numbers are the ids of tokens."""

    words: list[bytes]
    counts: np.ndarray
    tail_mass: np.ndarray  # by tail leaf: smoothed counts of its words and of one unknown word
    tokens: int  # N
    distinct: int  # V
    at: dict[bytes, int] = field(init=False)

    def __post_init__(self) -> None:
        self.at = Leaves((w, i) for i, w in enumerate(self.words))
        self.denominator = self.tokens + 0.5 * (self.distinct + 1)
        self.base = np.append(np.log10((self.counts + 0.5) / self.denominator), np.full(TAILS, -np.log10(self.denominator)))
        self.known = np.append(self.counts > 0, np.zeros(TAILS, bool))
        # an end without training texts still needs a share
        self.starts, nodes, self.sides, biases = nested(np.append(np.maximum(self.counts, 0.5), self.tail_mass))
        # of each choice on a leaf's path: what its node mixes into the hashes of features, and its bias
        self.salts, self.biases = (nodes + np.uint32(1)) * np.uint32(0x27D4EB2F), biases[nodes]
        self.bits = weight_bits(self.tokens)

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.at.__getitem__, words), np.int32, len(words))


def before(ids: np.ndarray, begins: np.ndarray) -> dict[int, np.ndarray]:
    """By how many tokens back, the leaves there, -1 before a text; ``begins`` holds each token's distance from its text's start."""
    out = {}
    for k in (1, 2):
        out[k] = np.full(len(ids), -1, np.int64)
        out[k][k:] = np.where(begins[k:] >= k, ids[: max(0, len(ids) - k)], -1)
    return out


def features(words: dict[int, np.ndarray]) -> list[np.ndarray]:
    """A hash for each template and token, of the leaves ``before`` it."""
    back = {k: np.where(w >= 0, w.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(1), np.uint32(BEFORE)) for k, w in words.items()}
    out = []
    for i, template in enumerate(TEMPLATES):
        mixed = np.full(len(words[1]), 0x85EBCA6B * (i + 1) & 0xFFFFFFFF, np.uint32)
        for k in template:
            mixed = (mixed ^ back[k]) * np.uint32(0xC2B2AE35)
            mixed ^= mixed >> np.uint32(15)
        out.append(mixed)
    return out


def distances(starts: np.ndarray, n: int) -> np.ndarray:
    """How far each of ``n`` tokens lies from its text's start."""
    return np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))


def choices(vocab: Vocabulary, leaves: np.ndarray, hashes: list[np.ndarray]) -> Iterator[tuple]:
    """First token, path lengths, sides, biases and weight places (an array for each of ``hashes``) in bounded batches."""
    shift = np.uint32(32 - vocab.bits)
    for at in range(0, len(leaves), BATCH):
        ids = leaves[at : at + BATCH]
        first, sizes = vocab.starts[ids], vocab.starts[ids + 1] - vocab.starts[ids]
        ends = np.cumsum(sizes)
        of = np.repeat(first - (ends - sizes), sizes)
        of += np.arange(len(of))
        salt, places = vocab.salts.take(of), []
        for h in hashes:
            mixed = np.repeat(h[at : at + BATCH], sizes)
            mixed ^= salt
            mixed *= np.uint32(0x9E3779B1)
            mixed >>= shift
            places.append(mixed.astype(np.int64))
        yield at, sizes, vocab.sides.take(of), vocab.biases.take(of), places


class Batches:
    """The choices of tokens in bounded batches; ``ids`` are whole texts one after another, ``starts`` where each begins."""

    def __init__(self, vocab: Vocabulary, ids: np.ndarray, starts: np.ndarray) -> None:
        self.vocab, self.ids = vocab, ids
        self.hashes = features(before(ids, distances(starts, len(ids))))

    def __iter__(self) -> Iterator[tuple]:
        return choices(self.vocab, self.ids, self.hashes)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``keys`` in order and how often each occurs; sorts in place."""
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.diff(np.append(first, len(keys)))


def distinct_triples(vocab: Vocabulary, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[tuple, np.ndarray]]:
    """The choices of the distinct triples of a leaf and the two before it, with how often each triple occurs."""
    bits = np.uint64(len(vocab.base).bit_length())  # 18 at most, with a head of 2 ** 17
    low = np.uint64((1 << int(bits)) - 1)
    words = before(ids, distances(starts, len(ids)))
    one, two = ((words[k] + 1).astype(np.uint64) for k in (1, 2))
    triples, times = counted((one << bits | two) << bits | ids.astype(np.uint64))
    back = {1: (triples >> bits + bits).astype(np.int64) - 1, 2: (triples >> bits & low).astype(np.int64) - 1}
    for batch in choices(vocab, (triples & low).astype(np.int64), features(back)):
        yield batch, times[batch[0] : batch[0] + len(batch[1])]


def chances(batch: tuple, weights: np.ndarray, sign: np.ndarray | None = None) -> np.ndarray:
    """For each choice of a batch the probability of its second class, or of the first where ``sign`` is -1."""
    _, _, _, z, places = batch
    z = z + weights.take(places[0], mode="clip")  # places are below 2 ** bits
    for p in places[1:]:
        z += weights.take(p, mode="clip")
    if sign is not None:
        z *= sign
    return logistic(z)


def logistic(z: np.ndarray) -> np.ndarray:
    np.clip(z, -15, 15, out=z)
    np.negative(z, out=z)
    np.exp(z, out=z)
    z += 1
    return np.reciprocal(z, out=z)


def add_slopes(batch: tuple, weights: np.ndarray, gradient: np.ndarray, times: np.ndarray | None = None) -> None:
    """Adds the gradient of the choices of a batch, each token's as often as ``times`` says."""
    step = (batch[2] - chances(batch, weights)).astype(np.float64)
    if times is not None:
        step *= np.repeat(times, batch[1])
    for p in batch[4]:
        np.add.at(gradient, p, step)


def add_first_slopes(batch: tuple, sums: np.ndarray, times: np.ndarray | None = None) -> None:
    """Adds the gradient, and the curvature as the imaginary part, of the choices of a batch where all weights are zero, each token's as often as ``times`` says."""
    chance = logistic(batch[3].copy())
    both = np.empty(len(chance), np.complex128)  # one place in memory for both sums of a weight
    both.real = batch[2] - chance
    both.imag = chance * (1 - chance)
    if times is not None:
        both *= np.repeat(times, batch[1])
    for p in batch[4]:
        np.add.at(sums, p, both)


def token_logs(batch: tuple, weights: np.ndarray) -> np.ndarray:
    """The natural log probability of each token's leaf."""
    _, sizes, sides, _, _ = batch
    taken = np.ones(len(sides) + 1)
    sign = sides.astype(np.float32)
    sign *= 2
    sign -= 1
    taken[:-1] = chances(batch, weights, sign)
    first = np.cumsum(sizes) - sizes
    return np.where(sizes > 0, np.log(np.multiply.reduceat(taken, first)), 0.0)


def stepped(weights: np.ndarray, gradient: np.ndarray, curvature: np.ndarray) -> np.ndarray:
    """The weights after one round; the curvature is that of the first round in all."""
    return (weights + RATE * gradient / (curvature + PRIOR)).astype(np.float32)
