"""Toxicity of whole texts by a subsequence string-kernel SVM with Nyström landmarks.

Training takes at most ``TRAIN`` labelled texts of each class, those first in a seeded
order of ids, texts that repeat counted once. A sentence has the label of its text, but
a toxic text has clean sentences too; so the machine learns by rounds which windows
of sentences stand for them:

1. A first table weighs each hashed subsequence by how much more toxic texts hold it
   than clean ones (the statistic of two shares, less ``NOISE``).
2. In each of ``ROUNDS`` rounds the table picks the strongest window of every sentence;
   the ``TOXIC_SENTENCES`` strongest sentences of a toxic text and the
   ``CLEAN_SENTENCES`` strongest of a clean one are trained on. Landmarks are chosen among their
   windows, and a squared-hinge SVM on the Nyström features is fitted by Newton steps
   whose sums run over all of these sentences in Spark tasks. It folds into the next table.

A text scores by its strongest window; a logistic curve fitted on the same texts turns
that into a probability. Inserted letters and blanks are bridged by the kernel's gaps,
inserted signs vanish, and letters written apart (``x y z``) are joined.
Neither label, language, source nor id enters a score.

Edge cases: null and empty texts, and texts without letters, score by the curve's low
end; unlabelled, null-id and held-out rows are never trained on; of several labels of
one id the largest holds; if the training rows lack a class, every score is their rate
of label 1 (0 without any); an empty table gives no rows; texts of any length are read
whole, with or without white space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.storage import for_python, written
from weirflow.llm.string_kernel import BITS, NONE, Nystroem, best_windows, codes, landmarks, sentences, strongest, subsequences
from weirflow.llm.sums import array_sums

#: Labelled rows of each class that are trained on, and the tasks that read them.
TRAIN, LEARNERS = 3_000, 8
ROUNDS, NEWTON, MARKS = 3, 6, 192
TOXIC_SENTENCES, CLEAN_SENTENCES, NOISE, PENALTY = 2, 8, 4.0, 2e-3
FOLDS, HELD, THRESHOLD = 4, 2, 0.3
#: Strongest value of a text without letters.
LOW = -2.0


def held_out(doc_id: Column, folds: int = FOLDS, held: int = HELD) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == held, F.lit(False))


@dataclass
class Machine:
    """Scores texts; ``table`` is None where no machine could be trained and ``slope`` is 0."""

    table: np.ndarray | None = None
    offset: float = 0.0
    slope: float = 0.0
    shift: float = -30.0

    def values(self, texts: list[str]) -> list[float]:
        if self.table is None:
            return [LOW] * len(texts)
        return [LOW if v == NONE else max(LOW, v + self.offset) for v in strongest(texts, self.table)]

    def probability(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * values + self.shift, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, with a small penalty that bounds them where classes are apart."""
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(2)
        w = w - np.linalg.solve(h, a.T @ (p - y) + 0.05 * w)
    return float(w[0]), float(w[1])


def first_table(texts: DataFrame, toxic: int, clean: int) -> np.ndarray:
    """By hashed subsequence, how surely toxic texts hold it more often than clean ones."""

    def held(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((2, 1 << BITS))
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                lines = codes(sentences(text.as_py() or ""))
                ends = np.minimum.accumulate(np.where(lines == 10, np.arange(len(lines)), len(lines))[::-1])[::-1]
                seen = np.zeros(1 << BITS, bool)
                for _, at, weight in subsequences(lines, ends - np.arange(len(lines))):
                    seen[at[weight > 0]] = True
                out[label] += seen
        return out

    n0, n1 = array_sums(texts.select("text", "toxic"), held, 2, 1 << BITS)
    share = (n0 + n1) / (toxic + clean)
    spread = np.sqrt(np.maximum(share * (1 - share) * (1 / toxic + 1 / clean), 1e-12))
    return np.maximum((n1 / toxic - n0 / clean) / spread - NOISE, 0).astype(np.float32)


def picked(texts: DataFrame, table: np.ndarray) -> DataFrame:
    """``window`` and ``toxic`` of the sentences of ``texts`` that are trained on."""
    sent = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows, labels = [], []
            for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                found = best_windows(text.as_py() or "", sent.value)[: TOXIC_SENTENCES if label else CLEAN_SENTENCES]
                windows += [w for _, w in found]
                labels += [label] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(windows, pa.string()), pa.array(labels, pa.int32())], ["window", "toxic"])

    return texts.select("text", "toxic").mapInArrow(run, "window string, toxic int")


def fit(windows: DataFrame) -> tuple[np.ndarray, float]:
    """Table and offset of the SVM for ``windows``; both classes weigh the same."""
    every = windows.toArrow()  # the sentences of 2 * TRAIN texts at most, a window each
    labels = np.array(every.column("toxic").to_pylist())
    named = every.column("window").to_pylist()
    marks = [m for label in (1, 0) for m in landmarks([w for w, y in zip(named, labels) if y == label], MARKS)]
    features = Nystroem(list(dict.fromkeys(marks)))
    sent = windows.sparkSession.sparkContext.broadcast(features)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                x = sent.value.of(part.column("window").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array([r.tobytes() for r in x], pa.binary())], ["toxic", "x"])

    rows = written(windows.mapInArrow(made, "toxic int, x binary"), "toxic-features")
    weight = [1 / max(1, int((labels == y).sum())) for y in (0, 1)]
    size = features.root.shape[1] + 1
    w = np.zeros(size)
    for _ in range(NEWTON):
        now = windows.sparkSession.sparkContext.broadcast(w)

        def normal(batches: Iterator[pa.RecordBatch], now=now) -> np.ndarray:
            out = np.zeros((size, size + 1))
            for batch in batches:
                y = batch.column("toxic").to_numpy()
                x = np.frombuffer(b"".join(batch.column("x").to_pylist()), "<f4").reshape(len(y), size - 1)
                x, sign = np.hstack([x, np.ones((len(y), 1))]), 2.0 * y - 1
                share = np.where(sign * (x @ now.value) < 1, np.where(y == 1, weight[1], weight[0]), 0)
                out[:, :size] += (x * share[:, None]).T @ x
                out[:, size] += x.T @ (share * sign)
            return out.reshape(1, -1)

        sums = array_sums(rows, normal, 1, size * (size + 1)).reshape(size, size + 1)
        before, w = w, np.linalg.solve(sums[:, :size] + PENALTY * np.eye(size), sums[:, size])
        if np.abs(w - before).max() < 1e-6:
            break
    return features.table(w[:-1]), float(w[-1])


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """The machine for ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic)."""
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labels = written(labels, "toxic-labels")
    counts = {r.toxic: r.n for r in labels.groupBy((F.col("toxic") == 1).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    rate = counts.get(True, 0) / max(1, sum(counts.values()))
    plain = Machine(shift=float(np.log(rate / (1 - rate))) if 0 < rate < 1 else 30.0 if rate else -30.0)
    first = [labels.where((F.col("toxic") == 1) == flag).orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(TRAIN) for flag in (True, False)]
    chosen = F.broadcast(first[0].unionByName(first[1]))  # 2 * TRAIN rows at most
    texts = docs.select("doc_id", "text").join(chosen, "doc_id")
    texts = texts.groupBy("text").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    texts = written(texts.repartition(LEARNERS, "text"), "toxic-texts")
    every, toxic = texts.agg(F.count("*"), F.sum("toxic")).first()
    if not toxic or toxic == every:
        return plain
    table, offset = first_table(for_python(texts), toxic, every - toxic), 0.0
    if not table.any():
        return plain
    for _ in range(ROUNDS):
        table, offset = fit(written(picked(texts, table), "toxic-windows"))
    machine = Machine(table, offset, 1.0, 0.0)
    found = valued(texts, machine, ("toxic",)).select("value", "toxic").toArrow()  # a number a training text
    machine.slope, machine.shift = logistic(np.array(found.column("value").to_pylist()), np.array(found.column("toxic").to_pylist(), np.float64))
    return machine


def valued(docs: DataFrame, machine: Machine, keep: tuple[str, ...]) -> DataFrame:
    """Columns ``keep`` with ``value`` (of the strongest window) and ``score`` of each text."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array(sent.value.values([t or "" for t in batch.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(values, pa.float64()), pa.array(sent.value.probability(values), pa.float64())], [*keep, "value", "score"])

    kinds = dict(docs.dtypes)
    return for_python(docs.select(*keep, "text")).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "value double", "score double"]))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted."""
    found = valued(docs.select("doc_id", "text"), train(docs, labels), ("doc_id",))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array(sent.value.values([t or "" for t in batch.column("text").to_pylist()]))
            yield batch.filter(pa.array(sent.value.probability(values) < THRESHOLD, pa.bool_()))

    return for_python(docs).mapInArrow(run, docs.schema)
