"""Byte-level BPE: words in sorted order, last-token states carried along shared prefixes, exact decoding.

A prefix of a word has one encoding, and that encoding is fixed by its last token
together with the encoding of what stands before that token. So each prefix
needs one state, its last token, found from those of shorter prefixes. ``words_to_ids``
goes through the distinct words of a batch in sorted order and keeps the states of one word's prefixes, so
the encodings of prefixes that words share are computed once.

Whether token ``b`` may follow token ``a`` is decided from the merge table alone,
by ``Merges.apart``.

Edge cases: null text counts as empty, and an empty text has no tokens. Special
tokens written in a text are recognised, as the tokenizers library does. Texts of any length are read
whole; words over ``LONG_WORD`` bytes are walked alone.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from weirflow.llm.storage import for_python

#: The split pattern of byte-level BPE vocabularies of this kind.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_WORD = 2048
#: Bounds of the tables that a Python worker keeps between batches: bytes of words and their
#: encodings in each of two generations, and judged pairs of tokens.
KEPT_BYTES, KEPT_PAIRS = 3_000_000, 400_000
#: Characters of text encoded together.
SLICE = 1_000_000
NEVER = 1 << 60
#: A path's last TAIL bytes say how long a token that ends there can be.
TAIL, SHORT = 4, (3, 2, 1)

FIELDS = {
    "n_tokens": pa.int64(),
    "ids": pa.list_(pa.int32()),
    "ids_sha256": pa.string(),
    "decoded": pa.string(),
    "decoded_sha256": pa.string(),
}
DDL = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, to the byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The tables of one vocabulary file, and which tokens can stand side by side."""

    def __init__(self, spec: str) -> None:
        tokenizer = json.loads(spec)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab, merges = tokenizer["model"]["vocab"], tokenizer["model"]["merges"]
        self.bytes_of = {i: raw(s) for s, i in vocab.items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.made_at = dict.fromkeys(self.bytes_of, -1)
        self.halves: dict[int, tuple[int, int]] = {}
        self.merge_at: dict[int, int] = {}  # by both halves in one number
        for at, pair in enumerate(merges):
            left, right = (self.id_of[raw(s)] for s in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merge_at[left << 32 | right] = at
            token = self.id_of[self.bytes_of[left] + self.bytes_of[right]]
            if self.made_at[token] < 0:
                self.made_at[token], self.halves[token] = at, (left, right)
        sizes: dict[bytes, set[int]] = {}
        for raw_token in self.id_of:
            sizes.setdefault(raw_token[-TAIL:], set(SHORT)).add(len(raw_token))
        self.sizes = {k: tuple(sorted(v, reverse=True)) for k, v in sizes.items()}
        self.packed = {i: np.array([i], "<u4").tobytes() for i in self.bytes_of}
        odd = [t["content"] for t in tokenizer.get("added_tokens", []) if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")]
        shape = tokenizer.get("pre_tokenizer") or {}
        if odd or tokenizer.get("normalizer") or (shape.get("type"), shape.get("use_regex", True), shape.get("add_prefix_space")) != ("ByteLevel", True, False):
            raise ValueError("not a plain byte-level vocabulary file")
        self.special = {t["content"]: t["id"] for t in tokenizer.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.words = regex.compile(WORDS)
        longest_first = sorted(self.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.special else None
        self.known: dict[int, bool] = {}  # by both tokens in one number
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.kept_bytes = 0

    def apart(self, a: int, b: int) -> bool:
        """Whether ``a`` then ``b`` stay two tokens when their bytes are encoded together.

        Undo both tokens step by step, the later merge first. At each step the two
        pieces at the boundary existed side by side until one of them was merged
        inwards; a merge across the boundary that comes before that breaks the pair.
        Equal merges go leftmost first, so the right one must come strictly sooner.
        """
        if (found := self.known.get(a << 32 | b)) is not None:
            return found
        x, y, x_until, y_until, fine = a, b, NEVER, NEVER, True
        while fine:
            at = self.merge_at.get(x << 32 | y, NEVER)
            fine = at == NEVER or at >= x_until or at > y_until
            if self.made_at[x] > self.made_at[y]:
                x_until, x = self.made_at[x], self.halves[x][1]
            elif self.made_at[y] >= 0:
                y_until, y = self.made_at[y], self.halves[y][0]
            else:
                break
        if len(self.known) >= KEPT_PAIRS:
            self.known.clear()
        self.known[a << 32 | b] = fine
        return fine

    def words_to_ids(self, words: Iterable[str]) -> dict[str, bytes]:
        """Encodings of distinct words; in sorted order, where a word shares its longest known prefix with the one before."""
        found: dict[str, bytes] = {}
        last, ids = [0] * (LONG_WORD + 1), [b""] * (LONG_WORD + 1)  # last token and encoding of each prefix
        sizes, id_of, known, packed, apart = self.sizes.get, self.id_of.get, self.known.get, self.packed, self.apart
        before = b""
        for word in sorted(words):
            raw = word.encode()
            if len(raw) > LONG_WORD:
                found[word] = self.long_word(raw)
                continue
            same = 0
            for x, y in zip(before, raw):
                if x != y:
                    break
                same += 1
            for depth in range(same + 1, len(raw) + 1):
                for size in sizes(raw[max(0, depth - TAIL) : depth], SHORT):
                    if size <= depth and (token := id_of(raw[depth - size : depth])) is not None:
                        at = depth - size
                        if not at or known(last[at] << 32 | token) or apart(last[at], token):
                            last[depth], ids[depth] = token, ids[at] + packed[token]
                            break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            found[word], before = ids[len(raw)], raw
        return found

    def long_word(self, raw: bytes) -> bytes:
        """The same along a single word, keeping one id a byte."""
        last, ids = [0] * (len(raw) + 1), []
        for depth in range(1, len(raw) + 1):
            for size in self.sizes.get(raw[max(0, depth - TAIL) : depth], SHORT):
                token = self.id_of.get(raw[depth - size : depth]) if size <= depth else None
                if token is not None and (size == depth or self.apart(last[depth - size], token)):
                    last[depth] = token
                    break
        depth = len(raw)
        while depth:
            ids.append(self.packed[last[depth]])
            depth -= len(self.bytes_of[last[depth]])
        return b"".join(ids[::-1])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit integers."""
        parts = [self.split.split(t) if self.split else [t] for t in texts]  # odd places are special tokens
        pieces = [[self.words.findall(p) if not i % 2 else p for i, p in enumerate(of)] for of in parts]
        kept, older = self.kept, self.older
        fresh = {w for of in pieces for p in of[::2] for w in p}.difference(kept)
        got = {w: older[w] for w in fresh.intersection(older)}
        got |= self.words_to_ids(fresh.difference(older))
        kept |= got
        self.kept_bytes += sum(len(w) + len(e) for w, e in got.items())
        special = {s: np.array([i], "<u4").tobytes() for s, i in self.special.items()}
        out = [b"".join(b"".join([kept[w] for w in p]) if not i % 2 else special[p] for i, p in enumerate(of)) for of in pieces]
        if self.kept_bytes > KEPT_BYTES:  # two generations: words in use move to the new one
            self.kept, self.older, self.kept_bytes = {}, kept, 0
        return out

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_models: dict[str, Merges] = {}


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows holding about ``most`` characters (one row at least), with their first row; nulls as ''."""
    texts, start, total = [], 0, 0
    for at, value in enumerate(batch.column(column)):
        texts.append(value.as_py() or "")
        total += len(texts[-1])
        if total >= most:
            yield start, texts
            texts, start, total = [], at + 1, 0
    if texts:
        yield start, texts


def encoded(docs: DataFrame, tokenizer: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of ``docs`` with the ``outputs`` of encoding ``text`` and decoding it again.

    ``tokenizer`` is the path of a byte-level BPE file of the tokenizers library; the
    driver reads it and sends it out (its size doesn't depend on the data).
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    name = hashlib.sha256(spec.value.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _models:
            _models[name] = Merges(spec.value)
        model = _models[name]
        for batch in batches:
            for start, texts in slices(batch, "text"):
                got: dict[str, list] = {o: [] for o in outputs}
                for ids in model.encode(texts):
                    decoded = model.decode(ids)
                    for o in outputs:
                        got[o].append(
                            len(ids) // 4 if o == "n_tokens"
                            else np.frombuffer(ids, "<i4") if o == "ids"
                            else hashlib.sha256(ids).hexdigest() if o == "ids_sha256"
                            else decoded if o == "decoded"
                            else hashlib.sha256(decoded.encode()).hexdigest()
                        )
                columns = [batch.column(k).slice(start, len(texts)) for k in keep]
                columns += [pa.array(got[o], FIELDS[o]) for o in outputs]
                yield pa.RecordBatch.from_arrays(columns, [*keep, *outputs])

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + [f"{o} {DDL[o]}" for o in outputs])
    return for_python(docs.select(*keep, "text")).mapInArrow(run, schema)
