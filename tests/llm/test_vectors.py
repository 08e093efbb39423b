"""Whitening against numpy in plain steps, clustering against its SQL and a brute-force search."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import Row

from weirflow.llm import centroids, queries, whitening

SF = "/root/testdata/sf0.01"


def table(spark, rows):
    """Rows (vec_id, embedding) with columns that clash with the results'."""
    return spark.createDataFrame([(i, v, "x", 1.5) for i, v in rows], "vec_id long, embedding array<double>, n string, distance double")


def odd(length):
    """Rows that take no part."""
    one = [0.5] * (length - 1)
    return [(900, None), (901, []), (902, [None, *one]), (903, [float("nan"), *one]), (904, [float("inf"), *one]), (905, [-float("inf"), *one]), (906, [1e300, *one])]


def white(rows):
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows], object)
    n, sums = len(x), x.sum(0)
    away = ((n * x - sums) / n).astype(float)
    covariance = away.T @ away / n
    values, axes = np.linalg.eigh(covariance)
    deviation = ((n * x - sums) ** 2).sum(1).tolist()
    return n, deviation, away @ axes[:, ::-1] / np.sqrt(np.maximum(values[::-1], 1e-300)), values[::-1] / values.sum()


def matches(got, rows, components):
    n, deviation, plain, share = white(rows)
    for c in range(1, components + 1):
        own = sorted(((r.vec_id, r.deviation, r.whitened) for r in got if r.component == c))
        want = sorted(zip((i for i, _ in rows), deviation, plain[:, c - 1].tolist()))
        assert [r[:2] for r in own] == [r[:2] for r in want]
        a, b = np.array([r[2] for r in own]), np.array([r[2] for r in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7
    assert {r.n for r in got} == {n} and len(got) == n * components
    assert all(abs(r.explained - share[r.component - 1]) < 1e-10 for r in got)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-6


def test_whitening_query_equals_numpy(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    matches(queries.op11_whitening(spark, SF).collect(), rows, 32)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * [1, 2, 3, 5, 8, 13]).tolist()) for i in range(60)]
    rows += [rows[0], rows[0], (None, [1.0] * 6)]  # repeated, and without an id
    got = whitening.whitened(table(spark, rows + odd(6))).collect()
    named = [Row(**(r.asDict() | {"vec_id": -1 if r.vec_id is None else r.vec_id})) for r in got]
    matches(named, [(-1 if i is None else i, v) for i, v in rows], 6)


def test_whitening_without_variance(spark):
    assert whitening.whitened(table(spark, odd(4))).collect() == []
    one = whitening.whitened(table(spark, [(1, [0.1, 0.2])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = whitening.whitened(table(spark, [(i, [float(i), 3.0, -float(i)]) for i in range(9)])).collect()  # one direction only
    assert all((r.whitened is None) == (r.component > 1) for r in flat) and flat[0].identity_error < 1e-9
    # lengths are fits of their own
    both = whitening.whitened(table(spark, [(i, [float(i)] * (1 + i % 2)) for i in range(10)])).collect()
    assert {(r.vec_id % 2, r.n) for r in both} == {(0, 5), (1, 5)}


def test_whitening_of_large_numbers(spark):
    rows = [(i, [float(i * 2**36), float(i % 3)]) for i in range(8)]
    got = {r.vec_id: r.deviation for r in whitening.whitened(table(spark, rows)).collect()}
    x = [[64 * i * 2**36, 64 * (i % 3)] for i in range(8)]
    want = [sum((8 * v - sum(r[d] for r in x)) ** 2 for d, v in enumerate(row)) for row in x]
    assert got == {i: (w if w < 2**63 else None) for i, w in enumerate(want)} and None in got.values()


def clusters(rows, count, rounds, dims):
    """Every vector against every centroid."""
    kept = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows]
    hashed = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "~", x) for i, x in kept)
    cents = [x for _, x in hashed[:count]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        for k in range(len(cents)):
            mine = [x for (_, x), o in zip(kept, own) if o == k]
            cents[k] = [sum(v) // len(mine) for v in zip(*mine)] if mine else cents[k]
    found = [(i, near(x)) for i, x in kept]
    inertia = sum(d for _, (d, _) in found)
    by = {k: sum(d for _, (d, o) in found if o == k) for k in range(len(cents))}
    fits = lambda v: v if v < 2**63 else None
    name = lambda k: hashlib.sha256(",".join(map(str, cents[k])).encode()).hexdigest()
    return sorted(((i, k, fits(d), fits(by[k]), fits(inertia), name(k)) for i, (d, k) in found), key=repr)


@pytest.mark.parametrize("scale", [1.0, 2.0**34])
def test_clusters_equal_brute_force(spark, scale):
    rng = np.random.default_rng(6)
    rows = [(i, (np.round(rng.normal(size=4), 1) * scale).tolist()) for i in range(150)]
    rows += [rows[3], rows[3], (None, [0.0] * 4), (7, [9.0] * 4)] + [(1000 + i, rows[5][1]) for i in range(50)]  # copies, ids twice and missing
    df = table(spark, rows + odd(4) + [(950, [1.0] * 3), (951, [1.0] * 5)])
    for count in (1, 7, 40):
        got = sorted((tuple(r) for r in centroids.clustered(df, count=count, rounds=3, dimensions=4).collect()), key=repr)
        assert got == clusters(rows, count, 3, 4)


def test_few_and_no_vectors(spark):
    rows = [(i, [float(i)] * 4) for i in range(3)]
    got = sorted((tuple(r) for r in centroids.clustered(table(spark, rows), dimensions=4).collect()), key=repr)
    assert got == clusters(rows, 40, 5, 4) and [r[2] for r in got] == [0, 0, 0]
    assert centroids.clustered(table(spark, odd(4)), dimensions=4).collect() == []
    same = [(i, [0.25] * 4) for i in range(60)]  # all ties: the first centroid takes all
    assert {r.cluster for r in centroids.clustered(table(spark, same), dimensions=4).collect()} == {0}


def test_partial_distances_abandon_nothing_that_wins():
    rng = np.random.default_rng(7)
    x, c = rng.integers(-40, 40, (3000, 64)), rng.integers(-40, 40, (40, 64))
    c[9] = c[4]  # a tie
    names, distances = centroids.nearest(x, c, np.argsort(-x.var(0)))
    all_of_them = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (names == all_of_them.argmin(1)).all() and (distances == all_of_them.min(1)).all()


def test_cluster_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    got = queries.op13_centroids(spark, SF)
    result = con.execute(queries.SQL["op13_centroids"])
    assert [d[0] for d in result.description] == got.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(result.fetchall())
