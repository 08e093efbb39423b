"""The chunk store: batches whole or not at all, deletes before inserts, repeats without effect."""

import os

import pytest
from pyspark.sql import functions as F

from weirflow.sources import index


def chunks(spark, rows):
    """Rows (stream, record, chunk, content)."""
    return spark.createDataFrame(rows, "stream string, record_id string, chunk int, content string").withColumn("embedding", F.array(F.lit(1.5), F.length("content").cast("double")))


def shown(spark, folder):
    return sorted(((r.stream, r.record_id, r.chunk, r.content) for r in index.live(spark, folder).collect()), key=repr)


def held(folder):
    return sorted(f for _, _, names in os.walk(folder) for f in names)


def test_batches_delete_before_they_insert_and_repeat_without_effect(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    first = chunks(spark, [("s", "a", 0, "a0"), ("s", "a", 1, "a1"), ("s", "b", 0, "b0"), ("t", "a", 0, "other"), (None, None, 0, "nameless")]).repartition(3)
    assert index.live(spark, folder).collect() == []
    index.write_batch(index.operations(first), folder, "1")
    second = chunks(spark, [("s", "a", 0, "A0"), (None, None, 0, "again")])
    deleted = spark.createDataFrame([("s", "b"), ("s", "unknown")], "stream string, record_id string")
    want = [("s", "a", 0, "A0"), ("t", "a", 0, "other"), (None, None, 0, "again")]
    for _ in range(2):  # the second time changes nothing
        index.write_batch(index.operations(second, deleted), folder, "2")
        assert shown(spark, folder) == sorted(want, key=repr)
        files = held(tmp_path)
    assert held(tmp_path) == files and [m["inserts"] for m in index.manifests(folder)] == [5, 2]
    assert index.live(spark, folder).where("record_id = 'a' and stream = 's'").first().embedding == [1.5, 2.0]
    index.compacted(spark, folder, f"{folder}-2")
    assert shown(spark, f"{folder}-2") == sorted(want, key=repr)


def test_streams_that_are_overwritten_start_empty(spark, tmp_path):
    folder = str(tmp_path / "store")
    index.write_batch(index.operations(chunks(spark, [("s", "a", 0, "old"), ("t", "a", 0, "stays")])), folder, "1")
    catalog = [{"name": "s", "mode": "overwrite"}, {"name": "t", "mode": "append"}]
    index.write_batch(index.operations(chunks(spark, [("s", "c", 0, "new")])), folder, "2", index.replaced(catalog))
    assert shown(spark, folder) == [("s", "c", 0, "new"), ("t", "a", 0, "stays")]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "store")
    index.write_batch(index.operations(chunks(spark, [("s", "a", 0, "old")])), folder, "1")
    files = held(tmp_path)
    many = chunks(spark, [("s", f"r{i}", 0, "x" * 100) for i in range(200)]).repartition(4)
    broken = index.operations(many).withColumn("content", F.when(F.col("record_id") == "r77", F.raise_error(F.lit("broken row")).cast("string")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken row"):
        index.write_batch(broken, folder, "2")
    assert held(tmp_path) == files and shown(spark, folder) == [("s", "a", 0, "old")]
    with pytest.raises(Exception, match="insert or delete"):
        index.write_batch(index.operations(many).withColumn("op", F.lit("upsert")), folder, "2")
    assert held(tmp_path) == files
    index.write_batch(index.operations(many), folder, "2")  # the same name, as it was never committed
    assert len(shown(spark, folder)) == 201


def test_keys_come_from_the_catalogue():
    catalog = [{"name": "s", "source_defined_primary_key": [["ID"], ["Shop Name"]], "primary_key": [["other"]]}, {"name": "t", "primary_key": [["k"]]}, {"name": "u"}, {"name": "v", "primary_key": [["a", "b"]]}]
    keys = lambda name: index.primary_key(index.stream_named(catalog, name))
    assert keys("s") == ["id", "shop_name"] and keys("t") == ["k"] and keys("u") is None
    for name in ("v", "missing"):
        with pytest.raises(ValueError):
            keys(name)
    with pytest.raises(ValueError, match="2 streams"):
        index.stream_named([*catalog, {"name": "t"}], "t")
