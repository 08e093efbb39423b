"""Training and scoring of the maximum-entropy model of ``maxent`` as Spark jobs.

1. Words of training texts are counted in each task, then summed by a shuffle.
2. The frequent head of the vocabulary (``HEAD`` words at most, by a count threshold
   found from a histogram) goes to the tasks; all other counts stay a table.
3. Every text is turned into token ids once, kept as a table.
4. In each of ``ROUNDS`` rounds all training texts give the sums of gradient and
   curvature of every weight; the sums are added up by blocks of weights and the
   weights take one step. No text is left out and no order matters.
5. All texts are scored in sparse numpy batches. Words outside the head are joined
   with their counts, so every count is exact.

Edge cases: a null text counts as empty, and an empty text is one end token; rows
without an id train; repeated rows train and score as rows of their own; without
training texts nothing is known and every base probability is 1; texts of any length are
read whole, in batches of tokens; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.maxent import ENDING, SEEN, TAILS, Batches, Vocabulary, add_first_slopes, add_slopes, counted, distinct_triples, stepped, tail_of, token_logs
from weirflow.llm.storage import located, row_key, written
from weirflow.llm.sums import array_sums

FOLDS, HELD, ROUNDS = 5, 1, 2
#: Words that all tasks know, tokens counted before they are passed on, tokens whose gradient one task sums (fewer tasks send fewer sums), tokens scored together.
HEAD, COUNTED, TASK_TOKENS, TOGETHER = 1 << 17, 3_000_000, 8_000_000, 200_000
#: Bytes of text whose tokens are found together, tokens of which equal ones add to the sums once.
SLICE, EQUAL = 4_000_000, 2_000_000


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) % FOLDS == HELD, F.lit(False))


def tokens(text: str) -> list[bytes]:
    """Words of a text, then the end as b""."""
    words = text.encode().lower().split()
    words.append(b"")
    return words


def token_lists(texts: pa.Array) -> pa.Array:
    """The ``tokens`` of each text (null: empty) as a list of binary; Arrow's kernels know the same six white spaces and change A-Z only."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    closed = pc.if_else(pc.equal(trimmed, ""), "", pc.binary_join_element_wise(trimmed, " ", ""))  # what follows the last space is the end
    return pc.ascii_split_whitespace(closed).cast(pa.list_(pa.binary()))


def runs(batch: pa.RecordBatch, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose texts hold about ``most`` bytes (one row at least)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)) + 1)
        yield batch.slice(at, to - at)
        at = to


def word_counts(texts: DataFrame) -> DataFrame:
    """``word`` (b"" is the end of a text) and ``n`` over all texts."""

    def totals(held: list[pa.Array]) -> pa.RecordBatch:
        found = pc.value_counts(pa.chunked_array(held, pa.binary()))
        return pa.RecordBatch.from_arrays(found.flatten(), ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        for batch in batches:
            for some in runs(batch):
                held.append(token_lists(some.column("text")).flatten())
                if sum(map(len, held)) >= COUNTED:
                    yield totals(held)
                    held.clear()
        if held:
            yield totals(held)

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The head of ``counts``, with the totals and the mass of the rest by tail leaf."""
    words = counts.where(F.octet_length("word") > 0)
    step = F.when(F.col("n") < 1000, F.col("n")).otherwise(F.lit(1000) + F.floor(F.log2(F.col("n").cast("double")) * 16)).cast("int")
    bins = sorted(words.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.sum("n").alias("n"), F.min("n").alias("least")).collect(), reverse=True)
    held, least = 0, None
    for b in bins:
        if held + b.words > HEAD or b.least < SEEN:
            break
        held, least = held + b.words, b.least
    head = words.where(F.col("n") >= least).toArrow() if least else None  # HEAD rows at most
    pairs = sorted(zip(head.column("word").to_pylist(), head.column("n").to_pylist())) if head else []
    texts = counts.where(F.octet_length("word") == 0).agg(F.sum("n")).first()[0] or 0
    tail = words.where(F.col("n") < least) if least else words
    leaf = (F.crc32(F.substring("word", -ENDING, ENDING)) % TAILS).cast("int")
    mass = np.full(TAILS, 0.5)
    for r in tail.groupBy(leaf.alias("leaf")).agg(F.sum(F.col("n") + 0.5).alias("mass")).collect():
        mass[r.leaf] += r.mass
    tokens, distinct = int(sum(b.n for b in bins)) + texts, sum(b.words for b in bins) + (texts > 0)
    return Vocabulary([b"", *(w for w, _ in pairs)], np.array([texts, *(n for _, n in pairs)], np.float64), mass, tokens, distinct)


def token_table(placed: DataFrame, vocab: Broadcast) -> DataFrame:
    """For each text its ids, what its head words give, and its other words with their counts."""
    names = ["doc_id", "file_key", "row_key", "held_out"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        head = pa.array(v.words, pa.binary())
        for batch in batches:
            for some in runs(batch):
                lists = token_lists(some.column("text"))
                words, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy())
                starts = np.append(0, ends[:-1])
                ids = pc.fill_null(pc.index_in(words, value_set=head), -1).to_numpy().astype("<i4")
                other = np.flatnonzero(ids < 0)
                rare = words.take(pa.array(other)).dictionary_encode()
                codes, distinct = rare.indices.to_numpy(), rare.dictionary
                ids[other] = (len(head) + np.fromiter(map(tail_of, distinct.to_pylist()), np.int32, len(distinct)))[codes]
                # a text's other words, each once with its count
                pairs, times = counted(np.searchsorted(ends, other, "right").astype(np.uint64) << np.uint64(32) | codes.astype(np.uint64))
                entries = pa.StructArray.from_arrays([distinct.take(pa.array(pairs & np.uint64(0xFFFFFFFF))), pa.array(times, pa.int64())], ["word", "n"])
                firsts = np.searchsorted(pairs >> np.uint64(32), np.arange(len(ends) + 1, dtype=np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(some.column(k) for k in names),
                        pa.array(ends - starts, pa.int64()),
                        pa.array(np.add.reduceat(v.known[ids].astype(np.int64), starts)),
                        pa.array(np.add.reduceat(v.base[ids], starts)),
                        pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends * 4).astype(np.int32)), pa.py_buffer(ids)]),
                        pa.ListArray.from_arrays(pa.array(firsts), entries),
                    ],
                    [*names, "n_tokens", "n_known", "base", "ids", "rare"],
                )

    kinds = dict(placed.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in names) + ", n_tokens long, n_known long, base double, ids binary, rare array<struct<word: binary, n: bigint>>"
    return placed.select(*names, "text").mapInArrow(run, schema)


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of at least ``TOGETHER`` tokens where there are as many: the rows, their ids one after another, where each begins."""
    for batch in batches:
        column, first, held = batch.column("ids"), 0, 0
        sizes = np.fromiter((len(x.as_buffer()) // 4 for x in column), np.int64, len(column))
        for at, size in enumerate(sizes.tolist()):
            held += size
            if held >= TOGETHER or at == len(sizes) - 1:
                some = column.slice(first, at + 1 - first)
                ids = np.frombuffer(b"".join(some.to_pylist()), "<i4")
                ends = np.cumsum(sizes[first : at + 1])
                yield batch.slice(first, at + 1 - first), ids, ends - sizes[first : at + 1]
                first, held = at + 1, 0


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids of whole texts one after another, ``EQUAL`` of them where there are as many, and where each text begins."""
    held, tokens = [], 0
    for _, ids, starts in together(batches):
        held.append((ids, starts + tokens))
        tokens += len(ids)
        if tokens >= EQUAL:
            yield tuple(map(np.concatenate, zip(*held)))
            held, tokens = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def summed(texts: DataFrame, vocab: Broadcast, weights: np.ndarray | None) -> np.ndarray:
    """The gradient of all weights over all ``texts``; without ``weights`` that at zero, and then the curvature."""
    first, width = weights is None, 1 << vocab.value.bits
    sent = None if first else texts.sparkSession.sparkContext.broadcast(weights)  # 2 ** MOST_BITS weights at most

    def slopes(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(width, np.complex128 if first else np.float64)
        for ids, starts in gathered(batches):
            for some, times in distinct_triples(vocab.value, ids, starts):
                if first:
                    add_first_slopes(some, out, times)
                else:
                    add_slopes(some, sent.value, out, times)
        return np.stack([out.real, out.imag]) if first else out[None]

    tasks = max(1, -(-vocab.value.tokens // TASK_TOKENS))
    return array_sums(texts.select("ids").coalesce(tasks), slopes, 1 + first, width)


def trained(texts: DataFrame, vocab: Broadcast, rounds: int = ROUNDS) -> np.ndarray:
    """The weights after ``rounds`` steps over all ``texts``."""
    weights, curvature = np.zeros(1 << vocab.value.bits, np.float32), None
    for turn in range(rounds):
        sums = summed(texts, vocab, weights if turn else None)
        curvature = sums[1] if turn == 0 else curvature
        weights = stepped(weights, sums[0], curvature)
    return weights


def scored(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    placed = located(docs, "doc_id", "text").select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"), *row_key())
    counts = written(word_counts(placed.where(~F.col("held_out"))), "lm-counts")
    made = vocabulary(counts)
    vocab = spark.sparkContext.broadcast(made)  # HEAD words at most
    table = written(token_table(placed, vocab), "lm-tokens")
    sent = spark.sparkContext.broadcast(trained(table.where(~F.col("held_out")), vocab))
    names = ["doc_id", "held_out", "file_key", "row_key", "n_tokens", "n_known", "base"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        share = np.append(np.zeros(len(v.words)), -np.log10(v.tail_mass))
        for batch, ids, starts in together(batches):
            logs = np.concatenate([token_logs(some, sent.value) for some in Batches(v, ids, starts)]) / np.log(10) + share[ids]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(np.add.reduceat(logs, starts))], [*names, "score"])

    kinds = dict(table.dtypes)
    whole = table.select(*names, "ids").mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in names) + ", score double")
    rare = table.select("file_key", "row_key", F.explode("rare").alias("x")).select("file_key", "row_key", "x.word", F.col("x.n").alias("times"))
    found = rare.join(counts, "word", "left").groupBy("file_key", "row_key").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more")
    )
    more = F.coalesce("more", F.lit(0.0))
    return whole.join(found, ["file_key", "row_key"], "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(made.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
