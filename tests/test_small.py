"""Small functions and operators that no query uses."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.functions import dates, http, text
from weirflow.operators import filters, joins, loading, records
from weirflow.plans import rates
from weirflow.sources import files
from weirflow.streaming import cursors


def values(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first().asDict()


def test_waits_from_headers(spark):
    lit = F.lit
    got = values(
        spark, plain=http.wait_from_header(lit("12")), words=http.wait_from_header(lit("wait 7 s")), none=http.wait_from_header(lit("soon")), much=http.wait_from_header(lit("90"), most=60),
        little=http.wait_from_header(lit("30"), most=60), until=http.wait_until(lit("1030"), lit(1000)), past=http.wait_until(lit("900"), lit(1000), 2.0),
    )
    assert got == {"plain": 12.0, "words": 7.0, "none": None, "much": None, "little": 30.0, "until": 30.0, "past": 2.0}


def test_dates_of_now_and_floors(spark):
    at = F.lit("2024-05-17 13:45:59").cast("timestamp")
    got = values(spark, month=dates.floor(at, "month"), week=dates.floor(at, "week"), today=dates.today_in("Pacific/Kiritimati"), utc=dates.today_in("UTC"), on=dates.day_delta(2, "%Y-%m-%d"), now=F.current_timestamp())
    assert (got["month"], got["week"]) == (dt.datetime(2024, 5, 1), dt.datetime(2024, 5, 13))
    assert got["today"] - got["utc"] in (dt.timedelta(0), dt.timedelta(1)) and got["utc"] == got["now"].date()
    assert got["on"] == (got["now"] + dt.timedelta(days=2)).strftime("%Y-%m-%d")


def test_quotes_selection_and_names(spark):
    df = spark.createDataFrame([(1, "x", [1])], "`Order ID` int, `2nd` string, l array<int>")
    assert df.select(text.quoted_json(F.col("l")).alias("q")).first().q == '"""[1]"""'
    assert filters.selected(df, ["l", "Order ID", "none"]).columns == ["Order ID", "l"]
    assert records.names_for_sql(df).columns == ["order_id", "_2nd", "l"]
    with pytest.raises(ValueError):
        records.names_for_sql(df.select(F.col("l").alias("!!")))


def test_slices_of_several_parents_and_order_of_writes(spark):
    one, two = spark.createDataFrame([(1,), (None,), (2,)], "a int"), spark.createDataFrame([("x",)], "b string")
    assert [r.p for r in joins.substreams([(one, "a"), (two, "b")], "p").collect()] == ["1", "2", "x"]
    deletes, inserts = loading.write_order([one, one.limit(1)], [two])
    assert deletes.count() == 4 and inserts.count() == 1
    assert values(spark, over=rates.over_limit(F.lit(5), 4), at=rates.over_limit(F.lit(4), 4)) == {"over": True, "at": False}


def test_schemas_merge_where_nested_types_agree():
    of = T.StructType.fromDDL
    a, b = of("x int, s struct<a: int>, n void, l array<string>"), of("s struct<a: int>, n string, y double, l array<string>")
    assert files.merged_schema(files.widened(a), files.widened(b)).simpleString() == "struct<x:bigint,s:struct<a:int>,n:string,l:array<string>,y:double>"
    for left, right in (("s struct<a: int>", "s struct<b: int>"), ("l array<int>", "l string")):
        with pytest.raises(ValueError, match="don't merge"):
            filters.merged_schema(of(left), of(right))


def test_batches_and_windows_of_a_stream(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, 0, s), s) for s in (1, 2, 11, 12, 13, 25)]
    spark.createDataFrame(rows, "at timestamp, k int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("at timestamp, k int").parquet(f"{tmp_path}/in")
    seen = []
    cursors.for_each_batch(stream, lambda batch, epoch: seen.append((epoch, batch.count())), f"{tmp_path}/cp").awaitTermination()
    assert seen == [(0, 6)]
    windows = cursors.rate_windows(stream, "at", "10 seconds", "1 minute").writeStream.outputMode("complete").format("memory").queryName("rate_windows_test").trigger(availableNow=True).start()
    windows.awaitTermination()
    assert sorted(r.calls for r in spark.table("rate_windows_test").collect()) == [1, 2, 3]
