"""Suffix deduplication against brute force; the merge of runs against sorting."""

import collections
import hashlib

import numpy as np

from weirflow.llm import queries, suffix_dedup, suffixes

KIND = "doc_id long, text string, spans string, anchors string"


def brute(texts):
    counts = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        hit = bytearray(len(t))
        for i in range(len(t) - 199):
            if counts[t[i : i + 200]] > 1:
                hit[i : i + 200] = b"\1" * 200
        runs = sum(1 for i in range(len(t)) if hit[i] and (i == 0 or not hit[i - 1]))
        out.append((len(t), sum(hit), runs, hashlib.sha256(bytes(x for x, y in zip(t, hit) if not y)).hexdigest()))
    return out


def digest(rows):
    return {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in rows}


def test_documents_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want = dict(zip([d.doc_id for d in docs], brute([(d.text or "").encode() for d in docs])))
    rows = queries.op8_suffix_dedup(spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want


def planted():
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdefghé "), n))
    a, b = word(300), word(199)
    texts = [
        word(90) + a + word(50), a[:250] + word(30), word(40) + a[40:240] + word(5), a[100:], b + "x", b + "y", word(20) + b, "z" * 900, "ab" * 400, word(500), "", None, "short",
        word(260), a + a, word(3) + "z" * 199, word(7) + "z" * 200, "é" * 150,
    ]
    return texts + [word(400)] * 2


def test_planted_repeats_and_edges(spark):
    texts = planted()
    df = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], KIND).repartition(3)
    assert digest(suffix_dedup.cut_out(df).collect()) == dict(enumerate(brute([(t or "").encode() for t in texts])))
    assert suffix_dedup.cut_out(df.limit(0)).collect() == []


def test_hot_grams_are_counted_to_the_same_end(spark, monkeypatch):
    line = "".join(np.random.default_rng(9).choice(list("abcdefgh "), 90))
    tails = ["".join(np.random.default_rng(100 + i).choice(list("ijklmnop "), 120)) for i in range(40)]
    texts = planted() + [t + line + tails[(7 * i) % 40] for i, t in enumerate(tails)] + [tails[3] + line + tails[21]] * 2
    df = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], KIND).repartition(3)
    want = dict(enumerate(brute([(t or "").encode() for t in texts])))
    for hot in (1, 10, 100_000):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        assert digest(suffix_dedup.cut_out(df).collect()) == want


def test_small_runs_and_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "RUN", 5)
    monkeypatch.setattr(suffix_dedup, "PART", 7)
    texts = planted()
    df = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], KIND).repartition(3)
    assert digest(suffix_dedup.cut_out(df).collect()) == dict(enumerate(brute([(t or "").encode() for t in texts])))


def test_anchors_do_not_depend_on_blocks(monkeypatch):
    text = np.random.default_rng(1).integers(97, 110, 3000, dtype=np.uint8).tobytes() + b"q" * 700
    whole = suffixes.anchors(text)
    monkeypatch.setattr(suffixes, "BLOCK", 256)
    cut = suffixes.anchors(text)
    assert all((x == y).all() for x, y in zip(whole, cut))


def test_merge_equals_sorting():
    rng = np.random.default_rng(2)
    for k in (1, 2, 3, 5, 8):
        runs = []
        for _ in range(k):
            entries = {(bytes(rng.integers(97, 99, int(rng.integers(1, 12)), dtype=np.uint8)), bytes(rng.integers(97, 99, 2, dtype=np.uint8))): 1 for _ in range(40)}
            runs.append(entries)
        got = list(suffixes.merge([suffixes.pack(r) for r in runs]))
        assert [(s, b) for s, b, _, _ in got] == sorted(e for r in runs for e in r)
        assert all(lcp == suffixes.common(x[0], s) for x, (s, _, _, lcp) in zip(got, got[1:]))
