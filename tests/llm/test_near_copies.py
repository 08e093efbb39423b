"""Near copies of the pipeline against all pairs by exact five-word similarity."""

import itertools

import numpy as np

import corpus_pipeline
from weirflow.llm import jaccard_join, near_copies, queries, simhash

DOCS = "doc_id long, text string, source string"


def brute_sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(texts):
    """The smallest place of each text's group, by all pairs."""
    found, part = [brute_sets(t) for t in texts], list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(found[a] & found[b])
        if found[a] == found[b] or 10 * both >= 8 * (len(found[a]) + len(found[b]) - both) > 0:
            low, high = sorted((part[a], part[b]))
            part = [low if p == high else p for p in part]
    return part


def kept(df):
    return sorted(r.doc_id for r in corpus_pipeline.without_near_copies(df.sparkSession, df, "").collect())


def edited(words, rng, edits):
    words = list(words)
    for at in rng.choice(len(words), edits, replace=False):
        words[at] = f"new{rng.integers(1 << 30)}"
    return words


def test_near_copies_of_many_bits_go(spark):
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(30):
        base = [f"w{x}" for x in rng.integers(0, 5_000, 200)]
        texts += [" ".join(base), " ".join(edited(base, rng, int(rng.integers(1, 9))))]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS)
    want = sorted(set(brute_groups(texts)))
    assert len(want) < 50 and kept(df) == want


def test_a_large_group_of_near_copies_is_one(spark):
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in range(300)]
    texts = [" ".join(edited(base, rng, 5)) for _ in range(150)] + [" ".join(f"v{x}" for x in rng.integers(0, 9_000, 100)) for _ in range(20)]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS)
    assert kept(df) == sorted(set(brute_groups(texts)))


def test_near_copies_of_the_test_table(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    texts = sorted({r.text or "" for r in docs.collect()})
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS)
    want = sorted(set(brute_groups(texts)))
    assert len(want) < len(texts) and kept(df) == want


def test_near_copies_of_odd_rows(spark):
    rows = [(1, None, "s"), (2, " \t", "s"), (3, "One two", "s"), (None, "one  TWO", "t"), (4, "one two three", None), (4, "one two three", None)]
    df = spark.createDataFrame(rows, DOCS)
    assert kept(df) == [1, 3, 4]
    assert kept(df.limit(0)) == [] and len(near_copies.near_duplicates(df).collect()) == len(rows)


def test_ball_hashing_makes_pairs_for_the_exact_check(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in range(4_000)]
    texts = [" ".join(base)] + [" ".join(edited(base, rng, 1)) for _ in range(12)] + [" ".join(f"v{x}" for x in rng.integers(0, 9_000, 60)) for _ in range(12)]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS)
    rows = jaccard_join.read(df, near_copies.SHINGLE, near_copies.ALIKE, near_copies.LOW, True)
    fps = {r.rid: r.fp % 2**64 for r in rows.select("rid", "fp").collect()}
    found = {(r.hi, r.lo) for r in near_copies.by_fingerprints(rows).collect()}
    assert found and all(a > b and (fps[a] ^ fps[b]).bit_count() <= 2 for a, b in found)
    met = {x for pair in found for x in pair}
    assert met == {a for a in fps for b in fps if a != b and (fps[a] ^ fps[b]).bit_count() <= 2}
    used, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda nodes: used.append(nodes) or links(nodes))
    assert kept(df) == sorted(set(brute_groups(texts))) and len(used) == 1


def test_stars_take_no_round(spark, monkeypatch):
    from weirflow.llm import components

    made, written = [], components.written
    monkeypatch.setattr(components, "written", lambda df, name: made.append(name) or written(df, name))
    links = spark.createDataFrame([(2, 1), (3, 1), (9, 7)], "hi long, lo long")
    assert sorted(map(tuple, components.components(links).collect())) == [(2, 1), (3, 1), (9, 7)] and len(made) == 1
    chain = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (5, 4), (6, 6)], "hi long, lo long")
    assert sorted(map(tuple, components.components(chain).collect())) == [(n, 1) for n in (2, 3, 4, 5)]


def test_stage_writes_few_tables_where_nothing_is_alike(spark):
    from weirflow.llm import storage

    df = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(20)), "s") for i in range(30)], DOCS)
    before = set(storage.made(spark))
    assert kept(df) == list(range(30))
    names = [f.rsplit("/", 1)[-1].rsplit("-", 1)[0] for f in set(storage.made(spark)) - before]
    # without pairs no ends are looked up and no round of components is run; only the first makes its empty table of links
    assert names.count("links") <= 2 and not {"jaccard-sets", "jaccard-places", "jaccard-hot"} & set(names)
