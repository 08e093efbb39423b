"""Items of JSON documents piece by piece against the whole document, memory, and broken documents."""

import gzip
import io
import json
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weirflow.sources import json_items
from weirflow.sources.http import at_path

VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda v: st.lists(v, max_size=4) | st.dictionaries(st.sampled_from(["a", "b", "é\"\\", "1"]), v, max_size=3), max_leaves=12)


def slow(data, step):
    """Reads ``step`` bytes at a time, whatever is asked."""
    f = io.BytesIO(data)
    return lambda n: f.read(step)


def whole(value, steps):
    """What a path gives of a document in memory."""
    if not steps:
        return value if isinstance(value, list) else [value]
    pairs = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    return [x for k, v in pairs if steps[0] in ("*", str(k)) for x in whole(v, steps[1:])]


@settings(max_examples=300, deadline=None)
@given(VALUES, st.lists(st.sampled_from(["a", "b", "*", "1", "0"]), max_size=3), st.integers(1, 40), st.booleans(), st.sampled_from([None, 2]))
def test_pieces_give_what_the_whole_gives(value, steps, step, packed, indent):
    data = json.dumps(value, indent=indent, ensure_ascii=packed).encode()
    data = gzip.compress(data[: len(data) // 2]) + gzip.compress(data[len(data) // 2 :]) if packed else data
    assert [json.loads(x) for x in json_items.items(slow(data, step), ".".join(steps))] == whole(value, steps)


@pytest.mark.parametrize("text", ['{"a": [1, 2', '{"a": [1, 2}', '{"a" 1}', '{"a": [tru]}', '{"a": ["x]}', '{"a": []} {}', '{"a": [1,,2]}', '{"a": [{"b": }]}', '{"a": [1 2]}', '["\\'])
def test_broken_documents_fail(text):
    for step in (1, 1000):
        with pytest.raises(ValueError, match="at byte"):
            list(json_items.items(slow(text.encode(), step), "a"))


def test_memory_stays_bounded():
    """64 MB of which one item, and what is passed over, is never held whole."""
    filler, item = b'"skip": ["' + b"x\\n" * 5_000_000 + b'"], ', json.dumps({"id": 1, "text": "y" * 900}).encode() + b","
    parts = [b'{"head": {' + filler, b'"z": 0}, "data": {"rows": ['] + [item * 100] * 550 + [b"null]}}"]
    stream = iter(parts)

    class Source:
        left = b""

        def read(self, n):
            while len(self.left) < n and (more := next(stream, b"")):
                self.left += more
            out, self.left = self.left[:n], self.left[n:]
            return out

    source = Source()
    source.read(0)
    tracemalloc.start()
    n = sum(1 for _ in json_items.items(source.read, "data.rows"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 55_001 and peak < 60 << 20  # the source itself holds 15 MB, three times while it cuts


def test_files_and_bodies(spark, tmp_path):
    body = {"meta": {"n": 3}, "shops": {"x": {"rows": [{"id": 1}, {"id": 2}]}, "y": {"rows": [{"id": 3, "t": "é"}]}}}
    (tmp_path / "a.json").write_text(json.dumps(body))
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(b'{"shops": {"z": {"rows": []}, "w": {"rows": {"id": 9}}}}'))
    json_items.register(spark)
    read = lambda **o: spark.read.format("json_items").options(path=f"file://{tmp_path}", **o).load()
    rows = read(items="shops.*.rows").collect()
    assert sorted((r.position, json.loads(r["item"])["id"]) for r in rows) == [(0, 1), (0, 9), (1, 2), (2, 3)]
    assert [json.loads(r["item"]) for r in read(items="shops.*.rows", glob="a*").orderBy("position").collect()] == at_path(body, "shops.*.rows.*") and read(items="no.where").count() == 0
    df = spark.createDataFrame([(1, json.dumps(body)), (2, None), (3, "[5, 6]")], "k int, b string")
    assert sorted((r.k, r["item"]) for r in json_items.items_of(df, "b", "", ["k"]).where("k = 3").collect()) == [(3, "5"), (3, "6")]
    (tmp_path / "c.json").write_text('{"shops": {"x": {"rows": [1,')
    with pytest.raises(Exception, match="c.json"):
        read(items="shops.*.rows").collect()
