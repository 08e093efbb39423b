"""Operators over documents against brute force, and their edge cases."""

import base64
import gzip
import hashlib
import itertools

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weirflow.llm import bpe, exact_dedup, mixing, queries, simhash, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, file string, size long"
ODD = [
    (1, None, "en", None, 0, "a", 1), (2, "", "en", "s", 0, "b", 2), (3, "same text", None, "s", 9, None, 3), (3, "same text", None, "s", 9, None, 3),
    (None, "same text", "en", "t", 9, "c", None), (5, "a b c d e " * 20_000, "en", "t", 1, "d", 5), (6, "é  ü \x0b x\t\n y", "fr", "", 3, "e", 6), (7, "<|endoftext|> x", "en", "u", 1, "", 7),
]


def frame(spark, rows=ODD):
    return spark.createDataFrame(rows, DOCS)


def test_exact_dedup_equals_grouping(spark):
    rows = queries.op10_exact_dedup(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    groups = {}
    for d in docs:
        groups.setdefault(d.text or "", []).append(d.doc_id)
    want = {(i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert {tuple(r) for r in rows} == want and len(rows) == len(docs)


def test_exact_dedup_tells_clashing_digests_apart(spark):
    rows = [(i, f"text {i % 3}", "", "", 0, "", 0) for i in range(12)]
    got = exact_dedup.deduplicate(frame(spark, rows), digest=lambda text: text.substr(1, 2).cast("binary"), files_per_batch=1)
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()} == {(i, 9 + i % 3, 4, i > 8) for i in range(12)}


def test_exact_dedup_edges(spark):
    got = exact_dedup.deduplicate(frame(spark)).collect()
    assert len(got) == len(ODD) and sum(r.kept for r in got) == 5
    assert {r.keep_id for r in got if r.group_size == 3} == {3} and {r.keep_id for r in got if r.group_size == 2} == {2}
    kept = exact_dedup.keep_first(frame(spark))
    assert kept.columns == frame(spark).columns and kept.count() == 5
    assert exact_dedup.deduplicate(frame(spark, [])).collect() == []


def brute_fingerprint(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", (text or "").translate(table)) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), 42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            root[find(j)] = find(i)
    return [find(i) for i in range(len(fps))]


def test_simhash_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    fps = [brute_fingerprint(d.text) for d in docs]
    parts = brute_components(fps)
    least = {p: min(d.doc_id for d, q in zip(docs, parts) if q == p) for p in set(parts)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op6_simhash(spark, SF).collect()}
    assert got == {d.doc_id: (f"{f:016x}", least[p]) for d, f, p in zip(docs, fps, parts)}


def test_simhash_links_chains_of_close_values(spark):
    rng = np.random.default_rng(5)
    fps = [0]
    for _ in range(300):
        base = fps[int(rng.integers(len(fps)))] if rng.random() < 0.8 else int(rng.integers(0, 1 << 63))
        fps.append(base ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    from weirflow.llm.components import components

    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    roots = {r.hi: r.lo for r in components(links).collect()}
    got = [roots.get(f, f) for f in signed]
    parts = brute_components(fps)
    assert {(a == b, c == d) for (a, c), (b, d) in itertools.combinations(zip(got, parts), 2)} <= {(True, True), (False, False)}


def test_simhash_edges(spark):
    got = simhash.near_duplicates(frame(spark)).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r.fp == 0} == {1}
    assert simhash.keep_one(frame(spark)).columns == frame(spark).columns
    assert simhash.near_duplicates(frame(spark, [])).collect() == []


def test_bpe_equals_the_library_and_round_trips(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file()
    library = Tokenizer.from_file(path)
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), frame(spark)):
        for (text,), r in zip(df.select("text").collect(), bpe.encoded(df, path).collect()):
            ids = library.encode(text or "", add_special_tokens=False).ids
            assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False) == (text or "")
    row = queries.op5_bpe(spark, SF).first()
    assert len(row.ids_sha256) == len(row.decoded_sha256) == 64


def test_bpe_words_go_in_sorted_order_without_a_trie():
    from tokenizers import Tokenizer

    path = queries.tokenizer_file()
    library, model = Tokenizer.from_file(path), bpe.Merges(open(path).read())
    words = [" in", " inter", " international", " internationally", " inteé", "é", "a", " ", " interx", " zq", "zqzqzq", "😀"]
    made = 0
    own = model.apart

    def counted(a, b):
        nonlocal made
        made += 1
        return own(a, b)

    model.apart = counted
    found = model.words_to_ids(words)
    assert {w: np.frombuffer(i, "<u4").tolist() for w, i in found.items()} == {w: library.encode(w, add_special_tokens=False).ids for w in words}
    before, made = made, 0
    model.words_to_ids([w for w in words for _ in range(3)])  # a word that repeats takes no step
    assert made <= before and not hasattr(model, "walk")


def test_bpe_long_words_take_the_same_tokens():
    from tokenizers import Tokenizer

    path = queries.tokenizer_file()
    library, model = Tokenizer.from_file(path), bpe.Merges(open(path).read())
    words = ["a" * 5000, "ab" * 3000, "thing" * 1000, "é" * 2500, "-" * 4000]
    assert [np.frombuffer(x, "<u4").tolist() for x in model.encode(words)] == [library.encode(w).ids for w in words]


def test_targets_stop_at_twice_a_source():
    got = mixing.targets({"a": 10, "b": 1000, None: 1000})
    assert got["a"] == 20 and got["b"] == pytest.approx((3015 - 20) * 2 / 3) and got[None] == pytest.approx((3015 - 20) / 3)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}


def test_subset_sum_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(200):
        items = [(int(s), int(c)) for s, c in zip(rng.choice(np.arange(1, 30), 4, replace=False), rng.integers(1, 4, 4))]
        goal = int(rng.integers(0, 120))
        best = min(abs(goal - sum(s * k for (s, _), k in zip(items, ks))) for ks in itertools.product(*(range(c + 1) for _, c in items)))
        taken = mixing.subset_sum(items, goal)
        assert abs(goal - sum(s * n for s, n in taken.items())) == best and all(n <= dict(items)[s] for s, n in taken.items())


def test_mixing_meets_targets_and_reruns_agree(spark):
    rows = queries.op3_mixing(spark, "/root/testdata/sf0.01").collect()
    docs = {d.doc_id: d for d in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    sums = {}
    for r in rows:
        assert r.size == len(__import__("re").findall("[^\x20\x09-\x0d]+", docs[r.doc_id].text or "")) and r.taken in (0, r.size, 2 * r.size)
        s = sums.setdefault(docs[r.doc_id].source, [r.target, r.source_size, 0, 0])
        s[2] += r.taken
        s[3] += r.size
    assert len(rows) == len(docs) and all(abs(t - taken) <= 1 and size == total for t, size, taken, total in sums.values())
    assert {s: v[0] for s, v in sums.items()} == pytest.approx(mixing.targets({s: v[1] for s, v in sums.items()}))
    assert sorted(rows) == sorted(queries.op3_mixing(spark, "/root/testdata/sf0.01").collect())


def test_fit_takes_very_long_documents():
    cases = [({300_000: 3}, 365_000, 300_000), ({1_000_000: 1}, 700_000, 1_000_000), ({300_000: 1, 200_000: 2}, 400_000, 400_000), ({300_000: 1}, 500_000, 600_000), ({900_000: 1}, 400_000, 0)]
    for counts, target, want in cases:
        whole, extra = mixing.fit(counts, target)
        assert sum(size * (whole * n + extra.get(size, 0)) for size, n in counts.items()) == want
    rng = np.random.default_rng(7)
    for _ in range(30):
        sizes = [int(x) for x in rng.integers(150_000, 2_000_000, 6)]
        target = int(rng.integers(1, sum(sizes)))
        best = min(abs(target - sum(some)) for k in range(7) for some in itertools.combinations(sizes, k))
        _, extra = mixing.fit(dict.fromkeys(sizes, 1), target)
        assert all(0 <= n <= 1 for n in extra.values())
        assert abs(target - sum(size * n for size, n in extra.items())) <= best + 0.0002 * sum(sizes)


def test_mixing_ranks_crowded_lengths_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 7)
    rows = [(i, "one two", "", "abc"[i % 3 and 1 + i % 2], 0, "", 0) for i in range(300)]
    got = mixing.mixture(frame(spark, rows)).collect()
    for s in "abc":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) < 2


def test_mixing_edges(spark):
    got = mixing.mixture(frame(spark)).collect()
    assert len(got) == len(ODD) and all(r.taken == r.copies * r.size for r in got)
    assert mixing.mixed(frame(spark)).columns == frame(spark).columns
    assert mixing.mixed(frame(spark)).count() == sum(r.copies for r in got)
    assert mixing.mixture(frame(spark, [])).collect() == []


def test_warc_round_trip(spark):
    pages = {p.page_id: p.html or "" for p in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    check_captures({i: (h, i) for i, h in pages.items()}, queries.op1_warc(spark, SF).collect())


def check_captures(pages, rows):
    first = {}
    for html, i in pages.values():
        first[html] = max(i, first.get(html, i))
    assert len(rows) == len(pages)
    for r in rows:
        raw = pages[r.page_id][0].encode()
        kept = first[raw.decode()] == r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if kept else ("revisit", first[raw.decode()]))


def test_archives_of_many_members():
    one = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:a:%d>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    members = [gzip.compress(one % i) for i in range(3000)]
    assert [r["record_id"] for r in warc.parse(b"".join(members))] == [f"<urn:a:{i}>" for i in range(3000)]
    with pytest.raises(ValueError):
        list(warc.parse(b"".join(members)[:-9]))


def test_warc_edges(spark, tmp_path):
    odd = ["", None, "x\r\n\r\nWARC/1.1\r\ny", "same", "same", "é \x00", "long " * 50_000, "same"]
    rows = [(i, None if i == 2 else f"http://h/{i}\r\nX: y", h, "") for i, h in enumerate(odd)]
    kinds = "page_id long, url string, html string, digest string"
    warc.write(spark.createDataFrame(rows, kinds), f"{tmp_path}/a")
    found = warc.transactions(warc.records(spark, f"{tmp_path}/a")).collect()
    assert sorted(r.response.payload.decode() for r in found if r.response.kind == "response") == sorted({h or "" for h in odd})
    assert all(r.request and r.metadata and r.request.concurrent_to == r.capture_id for r in found) and len(found) == len(odd)
    twice = [(None, "u", "same", ""), (1, "u", "same", ""), (1, "u", "same", ""), (None, "u", "other", "")]
    warc.write(spark.createDataFrame(twice, kinds), f"{tmp_path}/b")
    assert sorted(r.response.kind for r in warc.transactions(warc.records(spark, f"{tmp_path}/b")).collect()) == ["response"] * 3 + ["revisit"]
    warc.write(spark.createDataFrame([], kinds), f"{tmp_path}/c")
    assert warc.records(spark, f"{tmp_path}/c").collect() == []
    plain = b"".join(__import__("gzip").decompress(p.read_bytes()) for p in sorted((tmp_path / "a").glob("*.gz")))
    assert len(list(warc.parse(plain))) == len(odd) * 3


def test_columns_with_names_of_the_library(spark, tmp_path):
    rows = [(i, f"one two three four five {i % 3}", "s", 1, "f", 7, "m", "x") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __row long, __file string, __copies int, _metadata string, `a.b` string")
    df.write.parquet(f"{tmp_path}/docs")
    for docs in (df, spark.read.parquet(f"{tmp_path}/docs")):
        for got, n in ((exact_dedup.keep_first(docs), 3), (simhash.keep_one(docs), None), (mixing.mixed(docs), None)):
            found = got.collect()
            assert got.columns == docs.columns and (n is None or len(found) == n)
            assert {tuple(r) for r in found} <= set(rows)
        assert mixing.mixture(docs).agg(F.sum("size")).first()[0] == 54
        assert exact_dedup.deduplicate(docs).where("kept").count() == 3 and simhash.near_duplicates(docs).count() == 9
