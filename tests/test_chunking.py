"""Chunks keep every sign, their size and their overlap; documents take nested fields."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirflow.operators import chunking

WORDS = st.lists(st.sampled_from(["a", "bb", "ccc", "dddd", " ", "  ", "\n", "\n\n", "# H\n", "## h\n", "é"]), max_size=60).map("".join)


@settings(max_examples=300, deadline=None)
@given(WORDS, st.integers(1, 30), st.integers(0, 29), st.sampled_from(["text", "markdown", "python"]))
def test_chunks_cover_the_text_in_order(text, size, overlap, kind):
    overlap = min(overlap, size - 1)
    found = chunking.chunks_of(text, chunking.SEPARATORS[kind], size, overlap)
    assert all(len(c) <= size for c in found)  # single signs are the last resort
    if not overlap:
        assert "".join(found) == text
        return
    ends = {0}  # where the text that was covered may end: each chunk begins within the overlap or right after it, and goes on beyond it
    for chunk in found:
        ends = {at + len(chunk) for e in ends for at in range(max(0, e - overlap), e + 1) if text[at : at + len(chunk)] == chunk and at + len(chunk) > e}
    assert len(text) in ends


def test_coarse_separators_come_first():
    text = "# One\nalpha beta\n## Two\ngamma\n\ndelta\n# Three\nx"
    assert chunking.chunks_of(text, chunking.SEPARATORS["markdown"], 24) == ["# One\nalpha beta\n", "## Two\ngamma\n\ndelta\n", "# Three\nx"]
    code = "import x\nclass A:\n    def f(self):\n        pass\n    def g(self):\n        pass\ndef h():\n    pass\n"
    assert chunking.chunks_of(code, chunking.SEPARATORS["python"], 50)[-1] == "def h():\n    pass\n"
    assert chunking.chunks_of("one two three four", [" "], 2, 1, lambda t: len(t.split())) == ["one two ", "two three ", "three four"]
    assert chunking.chunks_of("abcdef gh", [" "], 3) == ["abcdef ", "gh"]


def test_chunks_of_a_table(spark):
    df = spark.createDataFrame([(1, "x", "one two three\n\nfour five"), (2, None, None), (3, "y", "  "), (4, "z", "word")], "chunk long, k string, body string")
    rows = chunking.hierarchy_chunks(df, "body", 3, kind="text", by="words", keep=["k"]).collect()
    assert [tuple(r) for r in rows] == [("x", 0, "one two three\n\n"), ("x", 1, "four five"), ("z", 0, "word")]
    with pytest.raises(ValueError):
        chunking.hierarchy_chunks(df, "body", 3, 3)


def test_chunks_by_tokens(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    known = tokenizers.Tokenizer.from_file(path)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").limit(20)
    rows = chunking.hierarchy_chunks(docs, "text", 64, by=path, keep=["doc_id"]).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for doc, text in texts.items():
        own = [r.content for r in sorted(rows, key=lambda r: r.chunk) if r.doc_id == doc]
        assert "".join(own) == text or not text.strip()
        assert all(len(known.encode(c, add_special_tokens=False).ids) <= 70 for c in own)  # parts put together have few tokens more than their sum


def test_documents_take_nested_fields(spark):
    kind = "id int, body struct<title: string, tags: array<struct<name: string>>, n: int>, lang string"
    df = spark.createDataFrame([(1, ("T", [("a",), ("b",)], 5), "en"), (None, (None, [("c",)], None), None)], kind)
    rows = chunking.record_documents(df, ["body.title", "body.tags.*.name"], ["lang", "body.n", "no.such"], "docs", ["id", "body.n"], "ns", {"body.title": "headline", "lang": "language"}).collect()
    assert [r.content for r in rows] == ['headline: T\nbody.tags.*.name: ["a","b"]', "body.tags.*.name: c"]
    assert [r.record_id for r in rows] == ["ns_docs_1_5", "ns_docs___not_found_____not_found__"]
    assert rows[0].metadata == {"language": "en", "body.n": "5", "_stream": "ns_docs", "_record_id": "ns_docs_1_5"}
    assert chunking.record_documents(df, ["body.tags.*.name"], [], "docs", ["id"], dedupe=False).first().metadata == {"_stream": "docs"}
    with pytest.raises(Exception, match="none of the text fields"):
        chunking.record_documents(df, ["body.title"], [], "docs").collect()
    renamed = chunking.renamed_fields(df.select("id", "lang", F.lit("x").alias("language")), {"lang": "language", "none": "y"})
    assert renamed.columns == ["id", "language"] and renamed.first().language == "en"
