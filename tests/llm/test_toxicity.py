"""Toxicity: held-out accuracy, gapped and padded insults, edge cases, and the kernel against its definition."""

import itertools

import numpy as np

from weirflow.llm import string_kernel as sk
from weirflow.llm import toxicity

KIND = "doc_id long, text string, score double"


def brute_features(window):
    out = {}
    for i, j, k in itertools.combinations(range(len(window)), 3):
        if k - i <= sk.SPAN and i < sk.WINDOW:
            out[window[i] + window[j] + window[k]] = out.get(window[i] + window[j] + window[k], 0) + sk.DECAY ** (k - i - 2)
    return out


def brute_kernel(s, t):
    norm = sk.WINDOW * sum(sk.DECAY ** (2 * (b - 2)) for b in range(2, sk.SPAN + 1) for a in range(1, b))
    a, b = brute_features(s), brute_features(t)
    return sum(v * b.get(u, 0) for u, v in a.items()) / norm


def test_kernel_equals_its_definition():
    windows = ["banana", "bandana ban", "xyz", "nabana", "aab", "a longer window"]
    for s in windows:
        got = sk.Prepared(windows).times(sk.feature(s))
        assert np.allclose(got, [brute_kernel(s, t) for t in windows])


def test_decision_equals_the_sum_over_landmarks():
    marks, rng = ["dumb cluck ab", "banana bread x", "hello there ok"], np.random.default_rng(1)
    features = sk.Nystroem(marks)
    w = rng.normal(size=features.root.shape[1])
    shares = features.root @ w
    texts = ["Hello, dumb-cluck! Banana\nbread there", "", "..!", "ok", "d u m b c l u c k " * 3, "Dumb. " * 500]
    want = []
    for text in texts:
        values = [sum(c * brute_kernel(m, line[i : i + sk.REACH]) for c, m in zip(shares, marks)) for line in sk.sentences(text).split("\n") for i in range(len(line))]
        want.append(max(values, default=sk.NONE))
    assert np.allclose(sk.strongest(texts, features.table(w)), want, atol=1e-5)


def test_long_texts_are_scored_in_parts(monkeypatch):
    table = np.random.default_rng(2).normal(size=1 << sk.BITS).astype(np.float32)
    text = " ".join("".join(np.random.default_rng(i).choice(list("abcdé"), 7)) for i in range(300))
    whole = sk.strongest([text, "ab cd"], table)
    monkeypatch.setattr(sk, "PART", 100)
    assert np.allclose(sk.strongest([text, "ab cd"], table), whole, atol=1e-5)


def corpus(spark):
    rng = np.random.default_rng(8)
    syllables = ["ba", "ko", "ri", "ten", "lum", "sa", "vor", "pli"]
    bad = ["dumbcluck", "fussbucket", "nitwitty"]
    rows, labels = [], []
    for i in range(600):
        words = ["".join(rng.choice(syllables, int(rng.integers(1, 5)))) for _ in range(60)]
        toxic = i % 3 == 0
        if toxic:
            words[int(rng.integers(60))] = bad[i // 3 % 3]
        rows.append((i, " ".join(words), 0.0))
        labels.append((i, int(toxic)))
    odd = ["d.u-m.b.c.l.u.c.k", "fussxbucket ko", "so n i t w i t t y ba", "ba ko ri", "", None, "ba " * 50_000 + "dumbcluck"]
    rows += [(1000 + i, t, 1.0) for i, t in enumerate(odd)]
    rows += [(None, "nitwitty", 0.0), (1006, "ba " * 50_000 + "dumbcluck", 0.0)]
    return spark.createDataFrame(rows, KIND), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_texts_and_disguises(spark):
    docs, labels = corpus(spark)
    rows = toxicity.scored(docs, labels).collect()
    assert len(rows) == 609 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 1000]
    assert len(held) > 100 and all(r.predicted == int(r.doc_id % 3 == 0) for r in held)
    assert [r.predicted for r in sorted((r for r in rows if r.doc_id and r.doc_id >= 1000), key=lambda r: r.doc_id)] == [1, 1, 1, 0, 0, 0, 1, 1]
    assert [r.predicted for r in rows if r.doc_id is None] == [1]
    kept = toxicity.kept(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in rows)


def test_without_labels_or_rows(spark):
    docs, labels = corpus(spark)
    some = docs.limit(5)
    assert all(r.score < 0.01 for r in toxicity.scored(some, labels.limit(0)).collect())
    assert all(r.score > 0.99 for r in toxicity.scored(some, labels.where("toxic = 1")).collect())
    assert toxicity.scored(docs.limit(0), labels).collect() == []
