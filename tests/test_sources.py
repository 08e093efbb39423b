"""Files written and read back, decoders, the paged HTTP source against a local server, streams."""

import gzip
import io
import json
import threading
import urllib.parse
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from weirflow.sources import decoders, files, http
from weirflow.streaming import cursors


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,b,t,\n1,true,x,\n2.5,no,NULL,\n,yes,y,\n")
    df = files.read_csv(spark, str(tmp_path / "a.csv"), nulls=["", "NULL"])
    assert df.columns[:3] == ["n", "b", "t"] and files.URL in df.columns
    schema = files.infer_csv(df.select("n", "b", "t"))
    assert schema.simpleString() == "struct<n:double,b:boolean,t:string>"
    got = files.cast_csv(df.withColumn("n", F.coalesce("n", F.lit("bad"))), schema).collect()
    assert [r.n for r in got] == [1.0, 2.5, None] and got[2]["_uncast"] == {"n": "bad"} and [r.b for r in got] == [True, False, True]


def test_csv_with_rows_to_skip(spark, tmp_path):
    (tmp_path / "s.csv").write_text("junk\nc1,c2\nunits\na,b\nc,d\n")
    got = files.read_csv_below(spark, str(tmp_path), before_header=1, after_header=1)
    assert {(r.c1, r.c2) for r in got.collect()} == {("a", "b"), ("c", "d")}


def test_jsonl_parquet_and_listing(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"c1":1,"c2":"x"}\nnot json\n\n{"c1":2}\n')
    assert [(r.c1, r.c2) for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "c1 bigint, c2 string").orderBy("c1").collect()] == [(1, "x"), (2, None)]
    assert files.read_jsonl(spark, str(tmp_path / "a.jsonl")).count() == 2
    spark.sql("select 1 as i, true as only").write.parquet(f"{tmp_path}/p1")
    spark.sql("select 2.5D as i, date'2024-01-02' as d, X'61' as x, 1.50BD as m, interval 1 day 2 hours as u").write.parquet(f"{tmp_path}/p2")
    both = files.read_parquet(spark, f"{tmp_path}/p1", f"{tmp_path}/p2")
    assert dict(both.dtypes)["i"] == "double" and {r.i for r in both.collect()} == {1.0, 2.5}
    row = files.json_values(both.where("i = 2.5")).first()
    assert (row.d, row.x, row.m, row.u) == ("2024-01-02", "a", "1.50", 93_600_000_000)
    found = files.listing(spark, str(tmp_path), "*.jsonl", since="2000-01-01")
    assert found.count() == 1 and files.duplicate_names(found).count() == 0


def test_decoders(spark):
    def body(b):
        return spark.createDataFrame([(b,)], "b string")

    read = lambda df: [r.record for r in df.collect()]
    assert [r.a for r in read(decoders.json_records(body('[{"a":1},{"a":2}]'), "b", "struct<a:int>"))] == [1, 2]
    assert [r.a for r in read(decoders.json_records(body("broken"), "b", "struct<a:int>"))] == [None]
    assert [r.a for r in read(decoders.json_lines(body('{"a":1}\nbad\n{"a":3}\n'), "b", "struct<a:int>"))] == [1, 3]
    assert [tuple(r) for r in read(decoders.csv_records(body("x,y\n1,NA\n2,3"), "b", ["x", "y"], nulls=["NA"]))] == [("1", None), ("2", "3")]
    assert read(decoders.xml_records(body("<r><a>5</a></r>"), "b", "a int"))[0].a == 5
    assert [r.record for r in read(decoders.lines(body("p\nq"), "b"))] == ["p", "q"]
    raw = spark.createDataFrame([(gzip.compress(b"hi\x00!"),), (b"plain",)], "b binary")
    assert [r.t for r in raw.select(decoders.text_of(F.col("b")).alias("t")).collect()] == ["hi!", "plain"]
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("one.txt", "1")
        z.writestr("two.txt", "2")
    zipped = spark.createDataFrame([("z", box.getvalue())], "path string, content binary")
    assert {(r.member, bytes(r.content)) for r in decoders.zip_members(zipped).collect()} == {("one.txt", b"1"), ("two.txt", b"2")}


class Api(BaseHTTPRequestHandler):
    failures = 1

    def do_GET(self):
        query = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query))
        if Api.failures:
            Api.failures -= 1
            self.send_response(503)
            self.end_headers()
            return
        shop, rows = query.get("shop", "a"), 7
        if "cursor" in self.path:
            at = int(query.get("cursor", 0))
            body = {"data": {"items": [{"shop": shop, "id": i} for i in range(at, min(at + 3, rows))]}, "next": str(at + 3) if at + 3 < rows else None}
        else:
            size, at = int(query.get("limit", 100)), int(query.get("offset", 0))
            at = at if "page" not in self.path else int(query.get("page", 0)) * size
            body = {"data": {"items": [{"shop": shop, "id": i} for i in range(at, min(at + size, rows))]}}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *args):
        pass


@pytest.mark.parametrize(("kind", "options"), [("offset", {"page_param": "offset"}), ("page", {"page_param": "page"}), ("cursor", {"page_param": "cursor", "cursor_path": "next"})])
def test_paged_http(spark, kind, options):
    server = HTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Api.failures = 1
    http.register(spark)
    settings = {"url": f"http://127.0.0.1:{server.server_port}/{kind}", "slices": '[{"shop":"a"},{"shop":"b"}]', "records": "data.items", "pagination": kind, "page_size": "3", "backoff": "0.01"}
    rows = spark.read.format("paged_http").options(**settings, **options).load().collect()
    server.shutdown()
    assert sorted((json.loads(r.record)["shop"], json.loads(r.record)["id"]) for r in rows) == [(s, i) for s in "ab" for i in range(7)]


class Echo(Api):
    def answer(self):
        size = int(self.headers.get("Content-Length") or 0)
        body = json.loads(self.rfile.read(size)) if size else {}
        query = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query))
        self.send_response(404 if query.get("shop") == "gone" else 200)
        self.end_headers()
        seen = {"method": self.command, "token": self.headers.get("Authorization"), "tag": self.headers.get("X-Tag"), "query": query, "body": body}
        at = int(query.get("offset", 0))
        days = [{"day": f"2024-01-{20 - i:02}"} for i in range(at, at + 2)]
        self.wfile.write(json.dumps({"groups": {"a": {"rows": [seen]}, "b": {"rows": []}}, "days": days}).encode())

    do_GET = do_POST = answer


def test_requests_carry_options_and_errors_have_rules(spark):
    server = HTTPServer(("127.0.0.1", 0), Echo)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    http.register(spark)
    read = lambda **o: [json.loads(r.record) for r in spark.read.format("paged_http").options(url=f"http://127.0.0.1:{server.server_port}/x", backoff="0.01", **o).load().collect()]
    inject = '{"day":["body","range.from"],"tag":["header","X-Tag"]}'
    slices = '[{"shop":"a","day":"d1","tag":"t"},{"shop":"gone","day":"d2","tag":"t"}]'
    got = read(method="POST", token="secret", params='{"v":"2"}', body='{"range":{"to":"z"}}', slices=slices, inject=inject, records="groups.*.rows.*", ignore="[404]")
    assert got == [{"method": "POST", "token": "Bearer secret", "tag": "t", "query": {"v": "2", "shop": "a"}, "body": {"range": {"to": "z", "from": "d1"}}}]
    days = read(records="days", pagination="offset", page_size="2", stop_field="day", stop_before="2024-01-17")
    assert [d["day"][-2:] for d in days] == ["20", "19", "18", "17", "16", "15"]
    days = read(records="days", pagination="offset", page_size="2", stop_field="day", stop_before="2024-01-17", drop_passed="true")
    assert [d["day"][-2:] for d in days] == ["20", "19", "18", "17"]
    names = {"url": f"http://127.0.0.1:{server.server_port}/x", "records": "days", "page_size": "2", "stop_field": "day", "stop_before": "2024-01-17", "pagination": "offset"}
    assert http.property_names(names, "day", ["2024-01-19", "2024-01-15"]) == ["2024-01-19", "2024-01-15"] and len(http.property_names(names, "day")) == 6
    for bad, what in (({"slices": '[{"shop":"gone"}]'}, "404"), ({"slices": '[{"v":1}]', "params": '{"v":2}'}, "twice")):
        with pytest.raises(Exception, match=what):
            read(**bad)
    server.shutdown()


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = cursors.merge_into(stream.select("user_id", "ts", "value"), f"{tmp_path}/out", ["user_id"], f"{tmp_path}/cp", "ts")
    query.awaitTermination()
    assert cursors.versions(spark, f"{tmp_path}/out") == [2, 3]
    newest = spark.read.parquet(f"{tmp_path}/out/v=3")
    want = events.groupBy("user_id").agg(F.max("ts").alias("ts"))
    assert newest.select("user_id", "ts").exceptAll(want).count() == 0 and newest.count() == want.count()

    got = cursors.partition_cursors(stream, ["user_id"], "ts").writeStream.outputMode("complete").format("memory").queryName("cursors").trigger(availableNow=True).start()
    got.awaitTermination()
    assert spark.table("cursors").agg(F.sum("n")).first()[0] == events.count()

    twice = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    once = cursors.without_repeats(twice.unionByName(twice), ["event_id"], "ts", "1 day").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    once.awaitTermination()
    assert spark.table("once").count() == events.count()


def test_merge_into_keeps_values_without_a_time_and_goes_on(spark, tmp_path):
    kind = "k int, v string, at int"
    for turn, rows in enumerate([[(1, "a", None), (2, "b", 5)], [(2, "old", 1), (3, "c", None)]]):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/in{turn}")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in{turn}")
        cursors.merge_into(stream, f"{tmp_path}/out", ["k"], f"{tmp_path}/cp{turn}", "at").awaitTermination()
    assert {tuple(r) for r in spark.read.schema(kind).parquet(f"{tmp_path}/out/v=1").collect()} == {(1, "a", None), (2, "b", 5), (3, "c", None)}


def test_records_and_errors_of_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"n": 1}\n{"n": 2}\n')
    (tmp_path / "b.jsonl").write_text('{"n": 3}\nbroken\n{"n": 4}\n')
    (tmp_path / "c.jsonl").write_text('{"n": 9}')
    raw = spark.read.format("binaryFile").load(f"{tmp_path}/*.jsonl")
    parse = lambda content: (json.loads(line) for line in content.decode().splitlines())
    rows = files.parsed_files(raw, parse, "n int", str(tmp_path / "parsed"))
    good, bad = files.records_of(rows), files.errors_of(rows)
    assert sorted((r[files.URL][-7:], r.n) for r in good.collect()) == [("a.jsonl", 1), ("a.jsonl", 2), ("b.jsonl", 3), ("c.jsonl", 9)]
    (error,) = bad.collect()
    assert error.path.endswith("b.jsonl") and error.position == 1 and "JSONDecodeError" in error.error
    with pytest.raises(ValueError, match="1 of 3 files"):
        files.fail_on_errors(rows, raw)
    files.fail_on_errors(files.parsed_files(raw.where("path not like '%b.jsonl'"), parse, "n int", str(tmp_path / "fine")), raw)


def test_merge_into_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    kind = "k int, v string, at int"
    batches = [[(i, "a", 1) for i in range(40)], [(7, "b", 2)], [(7, "old", 1), (8, "c", 3)], [(7, "d", 4)], [(None, "n", 1)]]
    for turn, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/in{turn}")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in{turn}")
        cursors.merge_into(stream, f"{tmp_path}/out", ["k"], f"{tmp_path}/cp{turn}", "at", buckets=8).awaitTermination()
        if turn == 1:
            assert len(cursors.buckets_of(spark, f"{tmp_path}/out")) == 8 and sum(len(v) for v in cursors.buckets_of(spark, f"{tmp_path}/out").values()) == 9
    want = {i: "a" for i in range(40)} | {7: "d", 8: "c", None: "n"}
    assert {r.k: r.v for r in cursors.newest(spark, f"{tmp_path}/out", kind).collect()} == want
    assert all(len(v) <= 2 for v in cursors.buckets_of(spark, f"{tmp_path}/out").values())
    assert cursors.newest(spark, f"{tmp_path}/none", kind).collect() == []
