"""Avro files: types by hand, round trips, splits, codecs and broken files."""

import datetime as dt
import decimal
import io
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from weirflow.sources import avro


def num(n):
    n, out = (n << 1) ^ (n >> 63), b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def text(s):
    return num(len(s.encode())) + s.encode()


def container(schema, blocks, codec="null", marker=b"0123456789abcdef"):
    """A file made by hand of blocks, lists of encoded records."""
    meta = {"avro.schema": json.dumps(schema).encode(), "avro.codec": codec.encode()}
    out = b"Obj\x01" + num(-len(meta)) + num(0) + b"".join(text(k) + num(len(v)) + v for k, v in meta.items()) + b"\x00" + marker
    for rows in blocks:
        body = b"".join(rows)
        if codec == "deflate":
            c = zlib.compressobj(wbits=-15)
            body = c.compress(body) + c.flush()
        out += num(len(rows)) + num(len(body)) + body + marker
    return out


def field(called, kind, **more):
    return {"name": called, "type": {"type": kind, **more} if more else kind}


ALL = {
    "type": "record", "name": "r", "namespace": "n",
    "fields": [
        field("nothing", "null"), field("yes", "boolean"), field("i", "int"), field("l", "long"), field("f", "float"), field("d", "double"), field("b", "bytes"), field("s", "string"),
        field("rec", "record", name="inner", fields=[field("x", "int"), field("again", ["null", "n.inner"])]), field("color", "enum", name="e", symbols=["RED", "BLUE"]),
        field("list", "array", items=["null", "long"]), field("map", "map", values="string"), field("four", "fixed", name="x4", size=4),
        field("money", "bytes", logicalType="decimal", precision=30, scale=3), field("cents", "fixed", name="x8", size=8, logicalType="decimal", precision=18, scale=2),
        field("id", "string", logicalType="uuid"), field("day", "int", logicalType="date"), field("tm", "int", logicalType="time-millis"), field("tu", "long", logicalType="time-micros"),
        field("ms", "long", logicalType="timestamp-millis"), field("us", "long", logicalType="timestamp-micros"), field("lms", "long", logicalType="local-timestamp-millis"),
        field("lus", "long", logicalType="local-timestamp-micros"), field("maybe", ["null", "string"]), field("either", ["null", "long", "string"]), field("color2", "n.e"),
    ],
}
BIG = -123456789012345678901234567
ONE = (
    b"\x01" + num(-7) + num(2**40) + struct.pack("<f", 1.5) + struct.pack("<d", -2.25) + num(2) + b"hi" + text("é") + num(5) + num(1) + num(6) + num(0) + num(1)
    + num(-2) + num(3) + num(1) + num(9) + num(0) + num(0) + num(1) + text("k") + text("v") + num(0) + b"\x01\x02\x03\xff"
    + num(12) + BIG.to_bytes(12, "big", signed=True) + (1234).to_bytes(8, "big", signed=True) + text("0-1") + num(19_000) + num(3_723_004) + num(3_723_000_005)
    + num(1_650_000_000_123) + num(1_650_000_000_123_456) + num(86_400_001) + num(86_400_000_001) + num(0) + num(2) + text("w") + num(0)
)


def test_all_types(spark, tmp_path):
    (tmp_path / "a.avro").write_bytes(container(ALL, [[ONE]]))
    r = avro.read_avro(spark, str(tmp_path)).first()
    assert (r.nothing, r.yes, r.i, r.l, r.f, r.d, bytes(r.b), r.s) == (None, True, -7, 2**40, 1.5, -2.25, b"hi", "é")
    assert r.rec.x == 5 and json.loads(r.rec.again) == {"x": 6, "again": None} and r.color == "BLUE" and r.list == [9, None] and r.map == {"k": "v"} and bytes(r.four) == b"\x01\x02\x03\xff"
    assert r.money == decimal.Decimal((1, tuple(map(int, str(-BIG))), -3)) and r.cents == decimal.Decimal("12.34") and (r.id, r.day, r.tm, r.tu) == ("0-1", dt.date(2022, 1, 8), "01:02:03.004000", "01:02:03.000005")
    spelled = avro.read_avro(spark, str(tmp_path)).select(*(F.col(c).cast("string") for c in ("ms", "us", "lms", "lus"))).first()
    assert tuple(spelled) == ("2022-04-15 05:20:00.123", "2022-04-15 05:20:00.123456", "1970-01-02 00:00:00.001", "1970-01-02 00:00:00.000001")
    assert (r.maybe, r.either, r.color2) == (None, '"w"', "RED")


def test_values_as_text(spark, tmp_path):
    (tmp_path / "a.avro").write_bytes(container(ALL, [[ONE]]))
    r = avro.read_avro(spark, str(tmp_path / "a.avro"), text=True, double_as_string=True).first()
    assert (r.d, r.b, r.four, r.cents, r.day) == ("-2.25", "hi", "010203ff", "12.34", "2022-01-08")
    assert (r.ms, r.us, r.lms) == ("2022-04-15T05:20:00.123+00:00", "2022-04-15T05:20:00.123456+00:00", "1970-01-02T00:00:00.001")


@pytest.mark.parametrize("codec", ["null", "deflate"])
def test_ranges_of_a_file_hold_each_record_once(spark, tmp_path, codec):
    schema = {"type": "record", "name": "r", "fields": [field("i", "long"), field("s", "string")]}
    blocks = [[num(i) + text(f"row {i} " * (i % 9)) for i in range(at, at + 7)] for at in range(0, 700, 7)]
    (tmp_path / "a.avro").write_bytes(container(schema, blocks, codec))
    for split in (37, 500, 4096, 1 << 20):
        df = avro.read_avro(spark, str(tmp_path), split=split)
        if split > 400:
            assert sorted(r.i for r in df.collect()) == list(range(700))
        assert df.rdd.getNumPartitions() == -(-(tmp_path / "a.avro").stat().st_size // split)
    size = (tmp_path / "a.avro").stat().st_size
    found = []
    for start in range(0, size, 37):  # ranges smaller than a marker and a block
        for b in avro.batches(io.BytesIO((tmp_path / "a.avro").read_bytes()), start, min(size, start + 37), "a", avro.Schema(schema).kind.spark, False, False):
            found += b.column("i").to_pylist()
    assert sorted(found) == list(range(700))


def test_round_trip_of_our_own_files(spark, tmp_path):
    df = spark.sql("""SELECT id, CAST(id AS INT) AS i, id / 3 AS d, CAST(id / 7 AS FLOAT) AS f, id % 2 = 0 AS b, IF(id % 3 = 0, NULL, CONCAT('é', id)) AS s, CAST(CONCAT('x', id) AS BINARY) AS raw,
        DATE '2020-02-01' + CAST(id AS INT) AS day, TIMESTAMP '2020-01-01 00:00:00.000001' + MAKE_INTERVAL(0,0,0,CAST(id AS INT)) AS at, TIMESTAMP_NTZ '1960-05-05 01:02:03' AS local,
        CAST(id * -1.01 AS DECIMAL(38, 10)) AS m, SEQUENCE(0, id % 4) AS list, MAP('k', IF(id % 2 = 0, NULL, id)) AS map, NAMED_STRUCT('a', id, 'b', NAMED_STRUCT('c', ARRAY(NULL, 'z'))) AS st FROM range(500)""")
    avro.register(spark)
    for codec in ("null", "deflate"):
        path = f"{tmp_path}/{codec}"
        df.repartition(3).write.format("avro_files").options(path=path, codec=codec, block="2000").mode("append").save()
        back = avro.read_avro(spark, path, split=10_000)
        plain = lambda d: sorted((str(r) for r in d.select(*df.columns).collect()))
        assert plain(back) == plain(df) and [t for _, t in back.dtypes] == [t for _, t in df.dtypes]
    with pytest.raises(Exception, match="broken"):
        df.withColumn("s", F.raise_error(F.lit("broken")).cast("string")).write.format("avro_files").options(path=f"{tmp_path}/null").mode("append").save()
    assert avro.read_avro(spark, f"{tmp_path}/null").count() == 500
    df.limit(5).write.format("avro_files").options(path=f"{tmp_path}/null").mode("overwrite").save()
    assert avro.read_avro(spark, f"{tmp_path}/null").count() == 5


def test_fields_go_by_name_and_stores_of_spark_alone_are_read(spark, tmp_path, monkeypatch):
    one = {"type": "record", "name": "r", "fields": [field("a", "long"), field("b", "string")]}
    two = {"type": "record", "name": "r", "fields": [field("c", "long"), field("a", "long")]}
    (tmp_path / "1.avro").write_bytes(container(one, [[num(1) + text("x")], []]))
    (tmp_path / "2.avro").write_bytes(container(two, [[num(5) + num(2)]]))
    want = {(1, "x"), (2, None)}
    assert {tuple(r) for r in avro.read_avro(spark, str(tmp_path)).collect()} == want
    monkeypatch.setattr(avro, "reachable", lambda path: False)
    assert {tuple(r) for r in avro.read_avro(spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize(("data", "what"), [(b"not avro", "isn't an Avro file"), (b"Obj\x01\x02", "ends within its header"), ("cut", "ends within a block"), ("codec", "compressed with"), ("list", "only files of records")])
def test_broken_files_fail_with_their_names(spark, tmp_path, data, what):
    schema = {"type": "record", "name": "r", "fields": [field("a", "long")]}
    whole = container(schema, [[num(i) for i in range(90)]])
    made = {"cut": whole[:-60], "codec": container(schema, [[num(1)]], "zstandard"), "list": container({"type": "array", "items": "long"}, [])}
    (tmp_path / "x.avro").write_bytes(made.get(data, data) if isinstance(data, str) else data)
    with pytest.raises(Exception, match=what):
        avro.read_avro(spark, str(tmp_path)).collect()
