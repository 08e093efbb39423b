"""The pipeline, stage by stage, against plain versions."""

import hashlib

import numpy as np

import corpus_pipeline
from weirflow.llm import mixing, queries, toxicity
from weirflow.llm.storage import written

SF = "/root/testdata/sf0.001"


def firsts_of_near_copies(docs):
    """The smallest id of each group of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = []
    for d in docs:
        words = (d.text or "").encode().lower().split()
        sets.append({b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                low, high = sorted((top(i), top(j)))
                root[high] = low
    return sorted({docs[top(i)].doc_id for i in range(len(docs))})


def test_stages_and_run(spark):
    from tokenizers import Tokenizer

    docs = queries.table(spark, SF, "documents")
    columns, frames = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        frames[name] = docs = written(stage(spark, docs, SF), name)
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns

    rows = {n: d.collect() for n, d in frames.items()}
    every = queries.table(spark, SF, "documents").collect()
    toxic = {r.doc_id for r in toxicity.scored(queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels")).collect() if r.predicted}
    assert {r.doc_id for r in rows["toxicity"]} == {d.doc_id for d in every} - toxic

    last = {}
    for d in rows["toxicity"]:
        last[d.text or ""] = max(d.doc_id, last.get(d.text or "", d.doc_id))
    assert sorted(r.doc_id for r in rows["exact_dedup"]) == sorted(last.values())

    some = sorted(rows["exact_dedup"], key=lambda d: d.doc_id)
    assert sorted(r.doc_id for r in rows["near_copies"]) == firsts_of_near_copies(some)

    words = lambda t: len((t or "").encode().split())
    sizes, taken, seen = {}, {}, {}
    for d in rows["near_copies"]:
        sizes[d.source] = sizes.get(d.source, 0) + words(d.text)
    for d in rows["mixing"]:
        taken[d.source] = taken.get(d.source, 0) + words(d.text)
        seen[d.doc_id] = seen.get(d.doc_id, 0) + 1
    assert max(seen.values()) <= 2 and seen.keys() <= {d.doc_id for d in rows["near_copies"]}
    for s, t in mixing.targets(sizes).items():
        own = [words(d.text) for d in rows["near_copies"] if d.source == s]
        whole, sums = int(t >= sum(own)) * sum(own), {0}
        for x in own:
            sums |= {y + x for y in sums}
        assert abs(taken.get(s, 0) - t) <= min(abs(whole + x - t) for x in sums) + 1

    library = Tokenizer.from_file(queries.tokenizer_file())
    text = {d.doc_id: d.text or "" for d in every}
    assert len(rows["bpe"]) == len(rows["mixing"])
    for r in rows["bpe"]:
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "ids_sha256").collect())) == sorted((r.doc_id, r.ids_sha256) for r in rows["bpe"])


def test_odd_rows_pass_through(spark, tmp_path):
    kind = "doc_id long, text string, source string, __row long, __file string, _metadata string, extra array<int>"
    rows = [(i, " ".join(f"w{(i * i + j) % 50}" for j in range(8)), "s", 1, "f", "m", [i]) for i in range(6)]
    rows += [(10, None, None, 2, "f", "m", []), (11, "", "s", 2, "f", "m", None), (None, "a b c d e f", None, 3, "f", "m", None), (12, "a b c d e f", "t", 3, "f", "m", None), (12, "a b c d e f", "t", 3, "f", "m", None)]
    for name, some in (("odd", rows), ("none", [])):
        docs = spark.createDataFrame(some, kind)
        for step, stage in corpus_pipeline.STAGES:
            done = stage(spark, docs, SF)
            assert step == "bpe" or done.columns == docs.columns
            done.write.parquet(f"{tmp_path}/{name}-{step}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{step}")
        assert docs.count() <= 2 * len(some)
    left = spark.read.parquet(f"{tmp_path}/odd-near_copies").collect()
    assert sorted(str(r.doc_id) for r in left) == sorted(map(str, [0, 1, 2, 3, 4, 5, 11, 12]))
    assert {r.doc_id: r.extra for r in left}[3] == [3]


def test_tables_are_removed_when_asked(spark, tmp_path):
    from pathlib import Path
    from urllib.parse import urlsplit

    from weirflow.llm import storage

    table = written(spark.range(3).toDF("id"), "gone")
    place = Path(urlsplit(table.inputFiles()[0]).path).parent
    assert place.exists()
    storage.discard(spark)
    assert not place.exists()


def test_stages_leave_only_the_tables_of_the_last(spark, tmp_path):
    from weirflow.llm import storage

    kind = "doc_id long, text string, source string"
    docs = spark.createDataFrame([(i, f"w{i} b c d e f g", "s") for i in range(5)], kind)
    before = set(storage.made(spark))
    stages = dict(corpus_pipeline.STAGES)
    first = stages["exact_dedup"](spark, docs, SF)
    own = set(storage.made(spark)) - before
    second = stages["near_copies"](spark, first, SF)  # reads the tables of the first, which therefore stay
    assert sorted(r.doc_id for r in second.collect()) == list(range(5)) and own
    second.write.parquet(f"{tmp_path}/second")
    third = stages["exact_dedup"](spark, spark.read.parquet(f"{tmp_path}/second"), SF)
    assert not [f for f in set(storage.made(spark)) - before if "/jaccard" in f]
    assert sorted(r.doc_id for r in third.collect()) == list(range(5))
