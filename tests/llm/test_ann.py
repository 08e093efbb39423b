"""Neighbours against brute force: recall, exact scores, copies, ties and odd vectors."""

import numpy as np

from weirflow.llm import ann, queries

EVERY20 = "vec_id % 20 = 0"


def brute(vectors, asked, top=20):
    out = {}
    for q in asked:
        rows = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)[:top]
        out[q] = [i for _, i in rows]
    return out


def gathered(df, rows_an_id=1):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r)
    if rows_an_id == 1:
        assert all([r["rank"] for r in rows] == list(range(1, len(rows) + 1)) for rows in got.values())
    return got


def test_recall_and_scores_at_sf_small(spark):
    sf = "/root/testdata/sf0.01"
    vectors = {r.vec_id: [float(x) for x in r.embedding] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.embedding is not None}
    want = brute(vectors, [i for i in vectors if i % 20 == 0])
    got = gathered(queries.op2_ann(spark, sf))
    assert got.keys() == want.keys() and all(len(r) == 20 for r in got.values())
    assert np.mean([len({r.vec_id for r in got[q]} & set(want[q])) / 20 for q in want]) >= 0.9
    for q, rows in got.items():
        assert all(abs(r.score - np.dot(vectors[q], vectors[r.vec_id])) < 1e-12 for r in rows)
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)


def test_copies_and_lengths(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8)) * rng.uniform(0.2, 3, (40, 1))
    vectors = {i: base[0 if i % 3 else int(rng.integers(40))].tolist() for i in range(600)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = gathered(ann.neighbours(df, EVERY20, budget=1e9))
    assert {q: [r.vec_id for r in rows] for q, rows in got.items()} == brute(vectors, [i for i in vectors if i % 20 == 0])


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = {q: [r.vec_id for r in rows] for q, rows in gathered(ann.neighbours(df, EVERY20), 2).items()}
    assert got == {0: [20, 20, 1], 20: [0, 0, 20, 20, 1, 1]}  # each of the two rows of id 20 asks and answers
    assert ann.neighbours(df.limit(0), EVERY20).collect() == []
    assert ann.neighbours(df.where("vec_id = 0"), EVERY20).collect() == []


def test_few_distinct_vectors_are_searched_whole(spark):
    rng = np.random.default_rng(8)
    for n in (2, 9, 20, 21, 25, 100, 200):
        vectors = {i: rng.normal(size=64).tolist() for i in range(n)}
        df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
        got = {q: [r.vec_id for r in rows] for q, rows in gathered(ann.neighbours(df, "true")).items()}
        assert got == brute(vectors, list(vectors))


def passed_on(spark, n):
    """Rows that the cells pass on for a query, by the metrics of the written plan's input to the merge."""
    kind = type(spark.range(1))
    rng, seen, plain = np.random.default_rng(3), [], kind.groupBy

    def watched(df, *columns):
        if columns[:4] == ("key", "vec_id", "file_key", "row_key"):
            seen.append(df)
        return plain(df, *columns)

    rows = [(i, [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(n, 12)))]
    kind.groupBy = watched
    try:
        out = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 100 = 0")
        assert out.groupby("query_id").count().where("count <> 20").isEmpty()
    finally:
        kind.groupBy = plain
    return seen[0].count() / (n / 100)


def test_what_cells_pass_on_for_a_query_does_not_grow(spark, monkeypatch):
    monkeypatch.setattr(ann, "SCOUTS", 200)
    assert passed_on(spark, 8_000) < 1.5 * passed_on(spark, 2_000)


def test_leaves_are_those_that_one_queue_would_take():
    import heapq
    import math

    from weirflow.llm import forest

    rng = np.random.default_rng(5)
    x, asked = rng.normal(size=(700, 6)), rng.normal(size=(70, 6))
    grown = forest.joined([forest.grow(x, i, 50) for i in range(3)] + [forest.grow(x[:1], 3, 50)], x)
    sizes = np.bincount(grown.leaves(x).ravel(), minlength=len(grown.cells)).tolist()
    steep = forest.ALIKE / math.sqrt(1 - forest.ALIKE**2) / grown.spread / math.sqrt(2)
    costs = grown.costs(asked, grown.levels())
    for budget in (40, 900, 10**6):
        for i, found in enumerate(grown.search(asked, budget, sizes)):
            queue, want, left = [(0.0, int(r)) for r in grown.roots], {}, budget
            while queue and left > 0:
                cost, node = heapq.heappop(queue)
                if node < 0:
                    if ~node not in want:
                        want[~node] = cost
                        left -= sizes[~node]
                    continue
                m = float(asked[i] @ grown.planes[node] - grown.cuts[node])
                far = 0.5 * math.erfc(abs(m) * steep)
                sides = (-math.log(far + 1e-300), -math.log(1 - far))
                for side in (0, 1):
                    heapq.heappush(queue, (cost + sides[(m > 0) == bool(side)], int(grown.children[node, side])))
            assert abs(len(found) - len(want)) <= 2 and len(set(found.tolist()) ^ want.keys()) <= 4  # costs are in steps
            assert sum(sizes[w] for w in found) >= min(budget, sum(sizes))
            assert all(abs(costs[w, i] - c) < 0.05 or c > 20 for w, c in want.items())
