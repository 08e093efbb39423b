"""Cursors by partition against a plain version that reads the whole history anew after every batch."""

import json
import random
import time
import tracemalloc

import pandas as pd
import pytest

from weirflow.streaming import partitions


def plain(history):
    """The sync state of one stream after ``history`` (events as dicts), without caps."""
    opened, finished, closed, records, cursors, order, parents, parent = {}, set(), {}, {}, {}, [], [], None
    for e in history:
        p, s = e["partition"], e["slice"]
        if e["kind"] == "open":
            if p not in opened:
                opened[p], closed[p], records[p] = set(), set(), {}
                if not parents or parents[-1][1] != e["parent"]:
                    parents.append((len(order), e["parent"]))
                order.append(p)
            opened[p].add(s)
            finished |= {p} if e["last"] else set()
        elif e["kind"] == "record":
            records[p].setdefault(s, []).append(e["cursor"])
        elif e["kind"] == "close":
            closed[p].add(s)
            first = min(opened[p] - closed[p], default=10**9)
            known = [c for t, cs in records[p].items() if t < first for c in cs]
            cursors[p] = max(known, default=None)
            busy = [i for i, q in enumerate(order) if not (q in finished and opened[q] == closed[q])]
            passed = [v for i, v in parents if not busy or busy[0] > i]
            parent = passed[-1] if passed else parent
    out = {"use_global_cursor": False, "states": [{"partition": p, "cursor": cursors[p]} for p in order if cursors.get(p) is not None]}
    return out | ({"parent_state": parent} if parent is not None else {})


def scrambled(seed, names, slices):
    """Events of one read in which slices close in any order."""
    rng, out = random.Random(seed), []
    waiting = [(p, [("open", s) for s in range(slices)]) for p in names]
    live, parent = [], 0
    while waiting or live:
        if waiting and (not live or rng.random() < 0.5):
            p, steps = waiting[0]
            _, s = steps.pop(0)
            out.append({"kind": "open", "partition": p, "slice": s, "last": not steps, "cursor": None, "parent": str(parent)})
            live.append((p, s))
            if not steps:
                waiting.pop(0)
                parent += rng.random() < 0.5
        elif rng.random() < 0.5:
            p, s = rng.choice(live)
            out.append({"kind": "record", "partition": p, "slice": s, "last": None, "cursor": s * 100 + rng.randrange(100), "parent": None})
        else:
            p, s = live.pop(rng.randrange(len(live)))
            out.append({"kind": "close", "partition": p, "slice": s, "last": None, "cursor": None, "parent": None})
    return out


def rows(events, stream, start=0):
    return [(stream, start + i, e["kind"], e["partition"], e["slice"], e["last"], e["cursor"], e["parent"]) for i, e in enumerate(events)]


def run(spark, folder, batches, **options):
    """The states of all versions, after the batches in turn."""
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, partitions.EVENTS).coalesce(1).write.parquet(f"{folder}/in/{i}")
        stream = spark.readStream.schema(partitions.EVENTS).parquet(f"{folder}/in/*")
        partitions.states_after(spark, stream, f"{folder}/out", f"{folder}/checkpoint", **options)
    return {(r.stream, r.version): json.loads(r.state) for r in spark.read.parquet(f"{folder}/out").collect()}


def test_states_equal_the_plain_version_after_every_batch(spark, tmp_path):
    streams = {name: scrambled(seed, [f"p{i}" for i in range(6)], 4) for seed, name in enumerate("xyz")}
    cuts = [0, 9, 20, 21, 45, 10**6]
    batches = [[r for name, events in streams.items() for r in rows(events[a:b], name, a)] for a, b in zip(cuts, cuts[1:])]
    for batch in batches:
        random.Random(1).shuffle(batch)
    got = run(spark, str(tmp_path), batches)
    for name, events in streams.items():
        for version, end in enumerate(cuts[1:], 1):
            assert got[name, version] == plain(events[:end]), (name, version)


def read(name, cursors, last=True):
    """A partition read in one slice."""
    make = lambda kind, **e: {"kind": kind, "partition": name, "slice": 0, "last": None, "cursor": None, "parent": None, **e}
    return [make("open", last=last), *(make("record", cursor=c) for c in cursors), make("close")]


def end(parent=None):
    return {"kind": "end", "partition": None, "slice": None, "last": None, "cursor": None, "parent": parent}


def test_the_oldest_finished_partition_goes_at_the_cap(spark, tmp_path):
    first = read("a", [1], last=False)[:1] + read("b", [2]) + read("c", [3])  # a stays open
    more = read("d", [4]) + read("e", [5]) + [end("done")]
    got = run(spark, str(tmp_path), [rows(first, "s"), rows(more, "s", 100)], cap=3)
    names = lambda v: [s["partition"] for s in got["s", v]["states"]]
    assert names(1) == ["b", "c"] and names(2) == ["d", "e"]  # b and c were finished and older than d
    assert "state" not in got["s", 2] and "parent_state" not in got["s", 2]  # a is still open


def test_many_partitions_switch_to_one_cursor_and_new_ones_start_from_it(spark, tmp_path):
    first = [e for i in range(4) for e in read(f"p{i}", [10 * i])] + [end("parent")]
    second = read("new", [])
    third = [e for i in range(4) for e in read(f"q{i}", [100 + i])] + [end()]
    got = run(spark, str(tmp_path), [rows(first, "s"), rows(second, "s", 100), rows(third, "s", 200)], switch=5)
    assert got["s", 1] == {"use_global_cursor": False, "states": [{"partition": f"p{i}", "cursor": 10 * i} for i in range(4)], "state": 30, "parent_state": "parent"}
    assert got["s", 2]["states"][-1] == {"partition": "new", "cursor": 30}
    assert got["s", 3] == {"use_global_cursor": True, "state": 103, "parent_state": "parent"}


def test_null_cursors_repeats_and_unknown_closes(spark, tmp_path):
    odd = read("a", [None, 3]) + read("a", [9]) + [{**read("ghost", [])[1], "kind": "close"}] + [{**read("late", [5])[1]}]
    got = run(spark, str(tmp_path), [rows(odd, "s")])
    assert got["s", 1]["states"] == [{"partition": "a", "cursor": 9}]


def test_many_closed_slices_behind_an_open_one_cost_and_keep_little():
    n = 40_000
    held = partitions.Cursors(json.loads(json.dumps(partitions.EMPTY)), {}, partitions.CAP, partitions.SWITCH)
    started = time.perf_counter()
    for s in range(n):
        held.open("p", s, s == n - 1, None)
        held.record("p", s, (s * 7) % n)
        if s % 1000:
            held.close("p", s)
    assert time.perf_counter() - started < 20  # a search of all closed slices at each close took minutes
    entry = held.partitions["p"]
    assert entry["cursor"] is None and len(entry["ahead"]) == len(entry["open"]) == n // 1000 and entry["late"] is None
    held.close("p", 0)
    assert entry["cursor"] == max(s * 7 % n for s in range(1000)) and held.partitions["p"]["seq"] is not None
    for s in range(n - 1000, 0, -1000):
        held.close("p", s)
    assert entry["cursor"] == n - 1 and entry["seq"] is None and not entry["ahead"]


def test_a_state_with_a_cursor_for_each_closed_slice_is_read():
    entry = {"made": 0, "cursor": 3, "seq": 0, "open": [4, 1], "ahead": {"1": 5, "2": 9, "3": 7, "5": 11}, "finished": True}
    held = partitions.Cursors(json.loads(json.dumps(partitions.EMPTY)) | {"created": 1, "opened": 1}, {"p": entry}, 10, 10)
    assert entry["ahead"] == {1: 9, 4: 11}
    held.close("p", 1)
    assert entry["cursor"] == 9
    held.close("p", 4)
    assert entry["cursor"] == 11 and entry["seq"] is None


def test_a_slice_that_opens_late_never_lets_more_count():
    held = partitions.Cursors(json.loads(json.dumps(partitions.EMPTY)), {}, 10, 10)
    for s in (1, 5):
        held.open("p", s, False, None)
        held.record("p", s, s)
    held.close("p", 5)
    held.open("p", 3, False, None)
    held.close("p", 1)
    assert held.partitions["p"]["cursor"] is None
    held.close("p", 3)
    assert held.partitions["p"]["cursor"] == 5


class Held:
    """State of one key in memory, as the processor asks Spark for it."""

    def __init__(self):
        self.values = {}

    def getMapState(self, *_):
        return self

    getValueState = getMapState

    def exists(self):
        return bool(self.values)

    def iterator(self):
        return iter(self.values.items())

    def updateValue(self, key, value):
        self.values[key] = value

    def removeKey(self, key):
        del self.values[key]

    def get(self):
        return self.values[()]

    def update(self, value):
        self.values[()] = value


def processed(chunks, cap=partitions.CAP, switch=partitions.SWITCH):
    """One stream's state after one batch, without Spark."""
    processor = partitions.CursorProcessor(cap, switch)
    processor.init(Held())
    processor.whole = Held()
    return json.loads(next(processor.handleInputRows(("s",), iter(chunks), None))["state"][0])


def filled(events, start=0):
    """Events as the processor gets them."""
    table = pd.DataFrame([{"stream": "s", "n": start + i, **e} for i, e in enumerate(events)])
    return table.assign(**{c: [v if v is not None and v == v else d for v in table[c]] for c, d in (("slice", 0), ("last", False), ("cursor", 0))})


def test_a_task_holds_no_more_of_a_large_batch_than_of_a_small_one(monkeypatch):
    monkeypatch.setattr(partitions, "BLOCK", 2000)

    def chunks(n):
        for i in range(n):
            slices = range(i * 300, (i + 1) * 300)
            yield filled([{"kind": k, "partition": "p", "slice": s, "last": False, "cursor": s, "parent": None} for s in slices for k in ("open", "record", "close")], i * 900)

    def peak(n):
        tracemalloc.start()
        got = processed(chunks(n))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got["states"] == [{"partition": "p", "cursor": 300 * n - 1}]
        return most

    assert peak(90) < 1.3 * peak(15)  # a batch was held whole


@pytest.mark.parametrize("block", [1, 7, 10**6])
def test_states_are_the_same_for_any_size_of_block(monkeypatch, block):
    monkeypatch.setattr(partitions, "BLOCK", block)
    for seed in range(30):
        events = scrambled(seed, [f"p{i}" for i in range(6)], 4)
        table = filled(events)
        assert processed([table[i : i + 5] for i in range(0, len(table), 5)]) == plain(events), seed
        # evictions, ends and repeats: as event by event
        many = [e for i in (1, 2, 1, 3, 4, 2) for e in [*read(f"q{i}", [i, seed, 2 * i]), *([end(str(i))] if i % 2 else [])]]
        mixed = [many.pop(0) if many and random.Random(seed + i).random() < 0.4 else e for i, e in enumerate(events)] + many
        one, table = partitions.Cursors(json.loads(json.dumps(partitions.EMPTY)), {}, 4, 6), filled(mixed)
        for i in range(len(table)):
            one.apply(table[i : i + 1])
        assert processed([table[i : i + 5] for i in range(0, len(table), 5)], 4, 6) == json.loads(one.shown()), seed


def test_events_out_of_order_are_refused():
    table = filled(read("a", [1, 2]))
    with pytest.raises(ValueError, match="order"):
        processed([table[2:], table[:2]])


def test_evicted_partitions_leave_nothing_behind():
    held = partitions.Cursors(json.loads(json.dumps(partitions.EMPTY)), {}, 10, 10**9)
    for i in range(5000):
        held.open(f"p{i}", 0, True, None)
        held.close(f"p{i}", 0)
    assert len(held.partitions) == 10 and len(held.touched) <= 10 and not held.gone and len(held.live) < 200


def test_large_cursors_are_exact(spark, tmp_path):
    got = run(spark, str(tmp_path), [rows(read("a", [2**60 + 1, None]) + [end("x")], "s")])
    assert got["s", 1]["states"] == [{"partition": "a", "cursor": 2**60 + 1}]
