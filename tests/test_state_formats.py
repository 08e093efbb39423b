"""States as text and as intervals."""

import json

import pytest
from pyspark.sql import functions as F

from weirflow.operators import state_formats


def intervals(spark, states, form="iso", start=None):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(states)], "k int, state string")
    low = F.lit(start).cast("timestamp") if start else None
    spelled = [F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS").alias(c) for c in ("start", "end", "most_recent")]
    return sorted(tuple(r) for r in state_formats.intervals_of(df, ["k"], "state", "at", form, low).select("k", *spelled).collect())


def test_states_are_read_in_all_forms(spark):
    moment = "2021-01-18 21:18:20.000"
    for form, value in (("iso", "2021-01-18T21:18:20.000Z"), ("iso", "2021-01-18T22:18:20+01:00"), ("seconds", 1611004700), ("millis", 1611004700000), ("%d.%m.%Y %H:%M:%S", "18.01.2021 21:18:20")):
        assert intervals(spark, [json.dumps({"at": value})], form) == [(0, moment, moment, moment)]
    assert intervals(spark, ['{"at": 10}', '{"at": 0}'], "seconds", "1970-01-01 00:00:05") == [(0, "1970-01-01 00:00:05.000", "1970-01-01 00:00:10.000", "1970-01-01 00:00:10.000"), (1, *["1970-01-01 00:00:05.000"] * 3)]
    ranges = {"state_type": "date-range", "slices": [{"start": 0, "end": 5}, {"start": 12, "end": 30, "most_recent_cursor_value": 20}]}
    assert [r[1:] for r in intervals(spark, [json.dumps(ranges)], "seconds")] == [("1970-01-01 00:00:00.000", "1970-01-01 00:00:05.000", None), ("1970-01-01 00:00:12.000", "1970-01-01 00:00:30.000", "1970-01-01 00:00:20.000")]
    assert intervals(spark, [None, "", "{}", "broken", '{"at": "no time"}', '{"other": 1}']) == []


@pytest.mark.parametrize(("form", "want"), [("seconds", [0, 10, 20, 30]), ("iso", ["1970-01-01T00:00:00.000Z", "1970-01-01T00:00:10.000Z", "1970-01-01T00:00:20.000Z", "1970-01-01T00:00:30.000Z"]), ("%H:%M:%S", ["00:00:00", "00:00:10", "00:00:20", "00:00:30"])])
def test_states_are_written_merged_and_low(spark, form, want):
    rows = spark.sql("SELECT * FROM VALUES (1, 20, 30, NULL), (1, 0, 5, 4), (1, 5, 10, NULL), (2, 0, 10, NULL) t(k, a, b, m)").select("k", *(F.timestamp_seconds(c).alias(n) for c, n in (("a", "start"), ("b", "end"), ("m", "most_recent"))))
    held = {r.k: json.loads(r.state) for r in state_formats.states_of(rows, ["k"], "at", form).collect()}
    assert held[1]["state_type"] == "date-range" and [(s["start"], s["end"]) for s in held[1]["slices"]] == [(want[0], want[1]), (want[2], want[3])]
    low = {r.k: json.loads(r.state)["at"] for r in state_formats.states_of(rows, ["k"], "at", "seconds", sequential=True).collect()}
    assert low == {1: 4, 2: 0}
